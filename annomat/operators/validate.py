"""Validation against a declarative schema: shapes, dtype, required names, unique ids, and checks of the values."""

from __future__ import annotations

import json
import operator
import re
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomat.errors import InvalidFormatError
from annomat.model import AnnotatedMatrix

_OPS = {"==": operator.eq, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


@dataclass(frozen=True)
class Qualifier:
    """A comparison with a count, such as ``>= 1000``; a bare number means equality."""

    op: str
    value: int

    @classmethod
    def parse(cls, text: int | str) -> Qualifier:
        if isinstance(text, int) and not isinstance(text, bool):
            return cls("==", max(0, text))
        m = re.fullmatch(r"\s*(==|>=|<=|>|<)?\s*(\d+)\s*", str(text))
        if not m:
            raise InvalidFormatError(f"not a comparison with a count: {text!r}")
        return cls(m[1] or "==", int(m[2]))

    def check(self, n: int) -> bool:
        return _OPS[self.op](n, self.value)

    def condition(self, n: Column) -> Column:
        return _OPS[self.op](n, F.lit(self.value))

    def __str__(self) -> str:
        return f"{self.op} {self.value}"


@dataclass(frozen=True)
class Schema:
    """What a dataset is expected to hold; whatever isn't given isn't checked."""

    obs: Qualifier | None = None
    vars: Qualifier | None = None
    x_dtype: str | None = None
    layers: list[str] = field(default_factory=list)
    obsm: list[str] = field(default_factory=list)
    obsp: list[str] = field(default_factory=list)
    var_columns: list[str] = field(default_factory=list)
    obs_columns: list[str] = field(default_factory=list)
    obs_index_unique: bool = False
    var_index_unique: bool = False
    check_finite: bool = False
    check_finite_layers: list[str] = field(default_factory=list)
    check_sorted_indices: bool = False

    @classmethod
    def of(cls, found: dict[str, Any]) -> Schema:
        names = {f.name for f in fields(cls)}
        if unknown := sorted(set(found) - names):
            raise InvalidFormatError(f"unknown keys in the schema: {', '.join(unknown)}")
        return cls(**{k: Qualifier.parse(v) if k in ("obs", "vars") else v for k, v in found.items() if v is not None})

    @classmethod
    def load(cls, path: str) -> Schema:
        """A schema from a YAML file (JSON is YAML too)."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml
        except ModuleNotFoundError:
            return cls.of(json.loads(text))
        return cls.of(yaml.safe_load(text) or {})


def missing(required: list[str], available: list[str] | set[str]) -> list[str]:
    """Required names that aren't available, in the order asked for."""
    return [x for x in required if x not in available]


def missing_rows(required: DataFrame, available: DataFrame, on: str) -> DataFrame:
    """The same as an anti join, for lists that are tables."""
    return required.join(available.select(on), on, "left_anti")


def unique(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row (name, ok, detail): whether a column's values are distinct. Grouping first lets Spark combine before the shuffle."""
    twice = df.groupBy(column).agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("d"))
    d = F.coalesce("d", F.lit(0)).cast("long")
    return twice.select(F.lit(name).alias("name"), (d == 0).alias("ok"), F.when(d == 0, "unique").otherwise(F.concat(d.cast("string"), F.lit(" duplicates"))).alias("detail"))


def finite(x: DataFrame, name: str) -> DataFrame:
    """One row: whether no stored value is NaN, infinite or null."""
    v = F.col("value").cast("double")
    bad = F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.agg(bad.alias("d")).select(F.lit(name).alias("name"), (F.col("d") == 0).alias("ok"), F.concat(F.col("d").cast("string"), F.lit(" values not finite")).alias("detail"))


def sorted_indices(rows: DataFrame, name: str = "sorted_indices") -> DataFrame:
    """One row: whether the indices of packed rows rise strictly; a cell stored twice fails."""
    rising = F.expr("forall(sequence(1, greatest(size(indices) - 1, 1)), k -> size(indices) < 2 or indices[k - 1] < indices[k])")
    return rows.agg(F.count_if(~rising).alias("d")).select(F.lit(name).alias("name"), (F.col("d") == 0).alias("ok"), F.concat(F.col("d").cast("string"), F.lit(" rows not sorted")).alias("detail"))


def repeated_cells(x: DataFrame, name: str = "sorted_indices") -> DataFrame:
    """One row: whether no cell of coordinate triples is stored twice."""
    w = Window.partitionBy("obs_idx").orderBy("var_idx")
    bad = x.withColumn("_p", F.lag("var_idx").over(w)).agg(F.count_if(F.col("_p") == F.col("var_idx")).alias("d"))
    return bad.select(F.lit(name).alias("name"), (F.col("d") == 0).alias("ok"), F.concat(F.col("d").cast("string"), F.lit(" cells stored twice")).alias("detail"))


@dataclass(frozen=True)
class Check:
    name: str
    ok: bool
    detail: str


@dataclass(frozen=True)
class Report:
    checks: list[Check]

    @property
    def passed(self) -> bool:
        return all(c.ok for c in self.checks)

    @property
    def n_passed(self) -> int:
        return sum(c.ok for c in self.checks)

    @property
    def n_failed(self) -> int:
        return len(self.checks) - self.n_passed

    def text(self) -> str:
        lines = [f"{'PASS' if c.ok else 'FAIL'}  {c.name}  {c.detail}" for c in self.checks]
        return "\n".join([*lines, f"{self.n_passed} passed, {self.n_failed} failed"])

    def json(self, file: str = "", schema: str = "") -> str:
        checks = [{"name": c.name, "status": "pass" if c.ok else "fail", "detail": c.detail} for c in self.checks]
        return json.dumps({"file": file, "schema": schema, "passed": self.passed, "n_passed": self.n_passed, "n_failed": self.n_failed, "checks": checks}, indent=2)


def run(data: AnnotatedMatrix, schema: Schema) -> Report:
    """All checks of the schema in a fixed order. Names and shapes cost no job; each check of values is one aggregation."""
    out: list[Check] = []
    for name, want, n in (("obs", schema.obs, data.n_obs), ("vars", schema.vars, data.n_vars)):
        if want is not None:
            out.append(Check(name, want.check(n), f"{n}, expected {want}"))
    if schema.x_dtype is not None:
        out.append(Check("x_dtype", schema.x_dtype == data.dtype, f"{data.dtype}, expected {schema.x_dtype}"))
    for name, want, there in (
        ("layers", schema.layers, data.layers), ("obsm", schema.obsm, data.obsm), ("obsp", schema.obsp, data.obsp),
        ("var_columns", schema.var_columns, data.var.columns), ("obs_columns", schema.obs_columns, data.obs.columns),
    ):
        if want:
            gone = missing(want, set(there))
            out.append(Check(name, not gone, f"missing: {', '.join(gone)}" if gone else f"all {len(want)} present"))
    frames = []
    if schema.obs_index_unique:
        frames.append(unique(data.obs, "obs_id", "obs_index_unique"))
    if schema.var_index_unique:
        frames.append(unique(data.var, "var_id", "var_index_unique"))
    if schema.check_finite:
        frames.append(finite(data.x, "check_finite"))
    for layer in schema.check_finite_layers:
        if layer in data.layers:
            frames.append(finite(data.layers[layer], f"check_finite:{layer}"))
        else:
            out.append(Check(f"check_finite:{layer}", False, "no such layer"))
    if schema.check_sorted_indices:
        frames.append(repeated_cells(data.x, "check_sorted_indices"))
    for frame in frames:
        out += [Check(r["name"], r["ok"], r["detail"]) for r in frame.collect()]
    return Report(out)
