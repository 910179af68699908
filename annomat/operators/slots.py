"""Slots and their names: include and exclude lists, the choice of X, key renaming."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annomat.model import AnnotatedMatrix


def specifiers(text: str) -> tuple[str, ...]:
    """A comma-separated list, each item trimmed, empty items dropped."""
    return tuple(x for part in text.split(",") if (x := part.strip()))


def matches(specifier: str, target: str) -> bool:
    """``obs`` matches ``obs`` and ``obs:column``; ``obs:column`` itself only."""
    return specifier == target or target.startswith(f"{specifier}:")


@dataclass(frozen=True)
class SlotFilter:
    """Which slots to keep: all, only the listed, or all but the listed. An exclusion wins over an inclusion."""

    only: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()

    @classmethod
    def parse(cls, only: str | None = None, exclude: str | None = None) -> SlotFilter:
        return cls(specifiers(only) if only is not None else None, specifiers(exclude) if exclude is not None else ())

    def includes(self, target: str) -> bool:
        if any(matches(s, target) for s in self.exclude):
            return False
        return self.only is None or any(matches(s, target) for s in self.only)

    def condition(self, target: Column) -> Column:
        """The same test on a column of slot names."""
        one = lambda s: (target == s) | target.startswith(f"{s}:")
        keep = F.lit(self.only is None)
        for s in self.only or ():
            keep = keep | one(s)
        for s in self.exclude:
            keep = keep & ~one(s)
        return keep

    def apply(self, data: AnnotatedMatrix) -> AnnotatedMatrix:
        """The dataset with unselected slots gone before anything is read: they never enter a plan.

        Targets are X, obs_index, var_index, uns, and slot:name for columns and keyed entries. Without its index a table has
        its row numbers as ids.
        """

        def table(name: str, df: DataFrame) -> DataFrame:
            idx, ident = f"{name}_idx", f"{name}_id"
            ids = F.col(ident) if self.includes(f"{name}_index") else F.col(idx).cast("string").alias(ident)
            return df.select(idx, ids, *[F.col(f"`{c}`") for c in df.columns if c not in (idx, ident) and self.includes(f"{name}:{c}")])

        keyed = {s: {k: d for k, d in getattr(data, s).items() if self.includes(f"{s}:{k}")} for s in ("layers", "obsm", "varm", "obsp", "varp")}
        x = data.x if self.includes("X") else data.x.limit(0)
        return replace(data, x=x, obs=table("obs", data.obs), var=table("var", data.var), uns=data.uns if self.includes("uns") else {}, **keyed)


def x_slot(asked: str, layer: str, layer_names: list[str] | set[str]) -> str:
    """Where X goes: ``auto`` is ``data`` if a layer is named ``counts``, else the ``layer`` argument; others as asked."""
    return ("data" if "counts" in layer_names else layer) if asked == "auto" else asked


def x_slot_column(asked: Column, layer: Column, has_counts: Column) -> Column:
    return F.when(asked == "auto", F.when(has_counts, F.lit("data")).otherwise(layer)).otherwise(asked)


def without_collision(layers: dict[str, DataFrame], slot: str) -> dict[str, DataFrame]:
    """Layers that don't share X's name."""
    return {k: d for k, d in layers.items() if k != slot}


def reduction_key(name: Column) -> Column:
    """The embedding key of a reduction: ``X_`` and the name in lower case."""
    return F.concat(F.lit("X_"), F.lower(name))


def reduction_name(key: Column) -> Column:
    return F.regexp_replace(key, "^X_", "")
