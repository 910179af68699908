"""The annotated matrix: lazily evaluated DataFrames for each slot and a small header."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat.errors import InvalidFormatError
from annomat.functions.casts import spark_type, to_dtype

#: Slots in the order in which they are described and written.
SLOTS = ("obs", "var", "obsm", "varm", "layers", "obsp", "varp", "uns", "X")


@dataclass(frozen=True)
class AnnotatedMatrix:
    """``n_obs`` rows by ``n_vars`` columns with aligned tables.

    x and each layer are (obs_idx, var_idx, value); obs and var are (obs_idx | var_idx, obs_id | var_id, columns ...); each
    obsm and varm entry is (idx, vec); each obsp and varp entry is an edge list (i, j, value); uns is a JSON tree. ``levels``
    holds the categories of categorical columns as {"obs": {column: [...]}, "var": {...}}; the columns hold the labels. ``in_order``
    says that the partitions of every slot are ranges of rows one after the other, as files are read; sinks check it.
    """

    spark: SparkSession
    n_obs: int
    n_vars: int
    dtype: str
    x: DataFrame
    obs: DataFrame
    var: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, Any] = field(default_factory=dict)
    levels: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    layer_dtypes: dict[str, str] = field(default_factory=dict)
    skipped: tuple[str, ...] = ()
    format: str = "memory"
    in_order: bool = False

    def __post_init__(self):
        spark_type(self.dtype)
        for need, df in ((("obs_idx", "var_idx", "value"), self.x), (("obs_idx", "obs_id"), self.obs), (("var_idx", "var_id"), self.var)):
            if missing := [c for c in need if c not in df.columns]:
                raise InvalidFormatError(f"columns {missing} are missing from {df.columns}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    def cast(self, dtype: str) -> AnnotatedMatrix:
        """X in another dtype; layers keep theirs."""
        if dtype == self.dtype:
            return self
        return replace(self, x=self.x.withColumn("value", to_dtype(F.col("value"), dtype)), dtype=dtype)

    def slice_obs(self, start: int, stop: int) -> AnnotatedMatrix:
        """Rows [start, stop) of every slot, counted from 0 again; graphs keep the edges inside."""
        if not 0 <= start <= stop <= self.n_obs:
            raise InvalidFormatError(f"rows {start} to {stop} are outside 0 to {self.n_obs}")

        def cut(df: DataFrame, *columns: str) -> DataFrame:
            inside = reduce(lambda a, c: a & (F.col(c) >= start) & (F.col(c) < stop), columns, F.lit(True))
            return df.where(inside).withColumns({c: F.col(c) - start for c in columns})

        return replace(
            self, n_obs=stop - start, x=cut(self.x, "obs_idx"), obs=cut(self.obs, "obs_idx"), layers={k: cut(d, "obs_idx") for k, d in self.layers.items()},
            obsm={k: cut(d, "idx") for k, d in self.obsm.items()}, obsp={k: cut(d, "i", "j") for k, d in self.obsp.items()},
        )

    def manifest(self) -> DataFrame:
        """(slot, key, n_rows, n_cols, nnz, dtype) of every matrix slot, in one pass over each."""
        n, m = self.n_obs, self.n_vars
        sparse = [("X", "", self.x, n, m, self.dtype)]
        sparse += [("layers", k, d, n, m, self.layer_dtypes.get(k, "f32")) for k, d in self.layers.items()]
        sparse += [("obsp", k, d, n, n, "f32") for k, d in self.obsp.items()] + [("varp", k, d, m, m, "f32") for k, d in self.varp.items()]
        rows = [d.agg(F.count("*").alias("nnz")).select(F.lit(s).alias("slot"), F.lit(k).alias("key"), F.lit(r).cast("long").alias("n_rows"), F.lit(c).cast("long").alias("n_cols"), "nnz", F.lit(t).alias("dtype")) for s, k, d, r, c, t in sparse]
        for s, slot, r in (("obsm", self.obsm, n), ("varm", self.varm, m)):
            rows += [d.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("long").alias("n_cols")).select(F.lit(s).alias("slot"), F.lit(k).alias("key"), F.lit(r).cast("long").alias("n_rows"), "n_cols", (F.col("n_cols") * r).cast("long").alias("nnz"), F.lit("f64").alias("dtype")) for k, d in slot.items()]
        return reduce(DataFrame.unionByName, rows)

    def register(self, name: str) -> None:
        """Temporary views ``{name}_x``, ``{name}_obs``, ``{name}_var`` and one for each keyed slot entry, for SQL."""
        self.x.createOrReplaceTempView(f"{name}_x")
        self.obs.createOrReplaceTempView(f"{name}_obs")
        self.var.createOrReplaceTempView(f"{name}_var")
        for slot in ("layers", "obsm", "varm", "obsp", "varp"):
            for key, df in getattr(self, slot).items():
                df.createOrReplaceTempView(f"{name}_{slot}_{key}")

    def write(self, path: str, format: str = "bundle", **options: Any) -> str:
        from annomat import sources

        return sources.write(self, path, format, **options)
