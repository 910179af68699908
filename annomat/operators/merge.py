"""Merging patches into a dataset: columns, layers, embeddings and graphs for the same or fewer observations and variables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annomat.errors import InvalidFormatError
from annomat.model import AnnotatedMatrix
from annomat.operators import uns
from annomat.operators.slots import SlotFilter

_POLICIES = ("error", "skip", "overwrite")


def _filled(value: Column, kind: str) -> Column:
    """Rows that a patch lacks: false for booleans, NaN for floats, null for the rest."""
    if kind == "boolean":
        return F.coalesce(value, F.lit(False))
    return F.coalesce(value, F.lit(float("nan")).cast(kind)) if kind in ("float", "double") else value


def merged_columns(base: DataFrame, patch: DataFrame, on: str, policy: str = "error", prefix: str = "") -> DataFrame:
    """``base`` with the patch's columns by key. Columns in both: an error, the base's (``skip``) or the patch's."""
    if policy not in _POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {', '.join(_POLICIES)}")
    new = {c: f"{prefix}{c}" for c in patch.columns if c != on}
    both = [n for n in new.values() if n in base.columns]
    if both and policy == "error":
        raise InvalidFormatError(f"columns in both: {', '.join(both)}")
    if policy == "skip":
        new = {c: n for c, n in new.items() if n not in both}
    kinds = dict(patch.dtypes)
    side = patch.select(F.col(f"`{on}`").alias("_on"), *[F.col(f"`{c}`").alias(f"_p{k}") for k, c in enumerate(new)])
    joined = base.join(side, base[f"`{on}`"] == side["_on"], "left")
    columns = {n: _filled(F.col(f"_p{k}"), kinds[c]) for k, (c, n) in enumerate(new.items())}
    kept = [columns.pop(c).alias(c) if c in columns else F.col(f"`{c}`") for c in base.columns]
    return joined.select(*kept, *[x.alias(n) for n, x in columns.items()])


def strangers(base: DataFrame, patch: DataFrame, on: str) -> DataFrame:
    """Keys of the patch that the base lacks."""
    return patch.join(base.select(on), on, "left_anti").select(on)


def _chosen(only: list[str] | None) -> SlotFilter:
    """Slots named as ``layers/normalized`` or ``layers:normalized``; all without names."""
    return SlotFilter.parse(",".join(x.strip().replace("/", ":", 1) for x in only) if only is not None else None)


def merge(base: AnnotatedMatrix, patch: AnnotatedMatrix, policy: str = "error", only: list[str] | None = None) -> AnnotatedMatrix:
    """``base`` with the obs and var columns, layers, embeddings, graphs and uns of ``patch``, or those that ``only`` names.

    The patch's ids must be a subset of the base's; what it holds is moved to the base's rows and columns. X is always the
    base's: a patch brings another matrix as a layer. A slot in both is an error, the base's (``skip``) or the patch's.
    """
    keep = _chosen(only)
    for slot in ("obs", "var"):
        if unknown := strangers(getattr(base, slot), getattr(patch, slot), f"{slot}_id").take(3):
            raise InvalidFormatError(f"ids of {slot} that the base lacks: {', '.join(str(r[0]) for r in unknown)}")

    def moved(slot: str, to: str) -> DataFrame:
        """(old, to): where each of the patch's rows or columns lies in the base."""
        idx, ident = f"{slot}_idx", f"{slot}_id"
        there = getattr(base, slot).select(F.col(idx).alias(to), ident)
        return getattr(patch, slot).select(F.col(idx).alias(f"{to}_old"), ident).join(there, ident).drop(ident)

    def at(df: DataFrame, slot: str, column: str) -> DataFrame:
        names = df.columns
        out = df.join(moved(slot, "_to"), df[column] == F.col("_to_old"))
        return out.select(*[F.col("_to").alias(c) if c == column else F.col(f"`{c}`") for c in names])

    def take(slot: str, *axes: tuple[str, str]) -> dict[str, DataFrame]:
        own = getattr(base, slot)
        new = {k: d for k, d in getattr(patch, slot).items() if keep.includes(f"{slot}:{k}")}
        both = sorted(set(own) & set(new))
        if both and policy == "error":
            raise InvalidFormatError(f"{slot} in both: {', '.join(both)}")
        found = {}
        for k, d in new.items():
            if policy != "skip" or k not in own:
                for which, column in axes:
                    d = at(d, which, column)
                found[k] = d
        return own | found

    def table(slot: str) -> DataFrame:
        df, ident = getattr(patch, slot).drop(f"{slot}_idx"), f"{slot}_id"
        return merged_columns(getattr(base, slot), df.select(ident, *[F.col(f"`{c}`") for c in df.columns if c != ident and keep.includes(f"{slot}:{c}")]), ident, policy)

    layers = take("layers", ("obs", "obs_idx"), ("var", "var_idx"))
    levels = {s: patch.levels.get(s, {}) | base.levels.get(s, {}) if policy == "skip" else base.levels.get(s, {}) | patch.levels.get(s, {}) for s in ("obs", "var")}
    columns = {"obs": table("obs"), "var": table("var")}
    return replace(
        base, in_order=False, **columns, layers=layers, obsm=take("obsm", ("obs", "idx")), varm=take("varm", ("var", "idx")), obsp=take("obsp", ("obs", "i"), ("obs", "j")), varp=take("varp", ("var", "i"), ("var", "j")),
        uns=uns.merged(base.uns, {k: v for k, v in patch.uns.items() if keep.includes(f"uns:{k}")}), levels={s: {c: x for c, x in own.items() if c in columns[s].columns} for s, own in levels.items()},
        layer_dtypes=base.layer_dtypes | {k: patch.layer_dtypes.get(k, "f32") for k in layers if layers[k] is not base.layers.get(k)},
    )


def taken(patch: AnnotatedMatrix, only: list[str] | None) -> list[str]:
    """The slots that a patch brings, as they are named in the record of a merge."""
    keep = _chosen(only)
    names = [(slot, c) for slot in ("obs", "var") for c in getattr(patch, slot).columns if c not in (f"{slot}_idx", f"{slot}_id")]
    names += [(slot, k) for slot in ("layers", "obsm", "varm", "obsp", "varp", "uns") for k in getattr(patch, slot)]
    return sorted(f"{slot}/{k}" for slot, k in names if keep.includes(f"{slot}:{k}"))
