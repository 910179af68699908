"""Profiles of a dataset: what each slot holds, without loading any matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annomat.model import AnnotatedMatrix
from annomat.operators import columns, uns


def column_kinds(df: DataFrame, skip: tuple[str, ...], categories: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(column, kind): int, float, string, bool or categorical."""
    kinds = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "bool"}
    return [(c, "categorical" if c in (categories or {}) else kinds.get(t, "string")) for c, t in df.dtypes if c not in skip]


def column_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, n_null, n_distinct) of the columns, in one aggregation."""
    aggs = [x for c in names for x in (F.count(F.col(f"`{c}`")).alias(f"n_{c}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d_{c}"))]
    one = df.agg(F.count("*").alias("_all"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"`n_{c}`").alias("n"), (F.col("_all") - F.col(f"`n_{c}`")).alias("n_null"), F.col(f"`d_{c}`").alias("n_distinct")) for c in names]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def described(data: AnnotatedMatrix) -> DataFrame:
    """(slot, key, detail), keys sorted: the lines of ``inspect``. Only shapes of sparse and dense slots are computed."""
    spark = data.spark
    lines = [("shape", "", f"{data.n_obs} obs x {data.n_vars} vars"), ("X", "", f"dtype {data.dtype}")]
    for slot, df, ids in (("obs", data.obs, ("obs_idx", "obs_id")), ("var", data.var, ("var_idx", "var_id"))):
        known = data.levels.get(slot, {})
        for name, kind in column_kinds(df, ids, known):
            lines.append((slot, name, f"categorical: {columns.preview(known[name])}" if kind == "categorical" else kind))
    for key, value in sorted(data.uns.items()):
        lines.append(("uns", key, uns.summary(value)))
    fixed = spark.createDataFrame(lines, "slot string, key string, detail string")
    sizes = data.manifest().where("slot <> 'X'").select("slot", "key", F.format_string("%d x %d, %d stored, %s", "n_rows", "n_cols", "nnz", "dtype").alias("detail"))
    return fixed.unionByName(sizes)


def report(data: AnnotatedMatrix, path: str = "") -> str:
    """The lines of ``inspect`` as text."""
    order = {s: k for k, s in enumerate(("shape", "obs", "var", "obsm", "varm", "layers", "obsp", "varp", "uns", "X"))}
    rows = sorted(described(data).collect(), key=lambda r: (order[r["slot"]], r["key"]))
    head = [f"file:   {path}", f"format: {data.format}"] if path else []
    return "\n".join(head + [f"{r['slot']}{':' + r['key'] if r['key'] else ''}  {r['detail']}" for r in rows])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
