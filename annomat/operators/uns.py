"""Unstructured metadata: JSON trees, their leaves, merging, and what stricter layouts keep of them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(tree: Any, path: str = "") -> list[tuple[str, str, str]]:
    """(path, type, JSON text) of every leaf in document order; an empty container is a leaf."""
    import json

    if isinstance(tree, dict) and tree:
        return [x for k, v in tree.items() for x in leaves(v, f"{path}/{k}")]
    if isinstance(tree, list) and tree:
        return [x for k, v in enumerate(tree) for x in leaves(v, f"{path}/{k}")]
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    return [(path or "/", kinds[type(tree)], json.dumps(tree))]


def merged(base: dict[str, Any], more: dict[str, Any]) -> dict[str, Any]:
    """Trees merged object by object; where both have another value, the second's."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def strict(tree: Any) -> Any:
    """What layouts without arrays, booleans and nulls keep: strings, numbers and objects."""
    return {k: strict(v) for k, v in tree.items() if isinstance(v, (dict, str, int, float)) and not isinstance(v, bool)} if isinstance(tree, dict) else tree


def summary(value: Any) -> str:
    """One line on a value: arrays and objects by size, long strings cut."""
    if isinstance(value, list):
        return f"array[{len(value)}]"
    if isinstance(value, dict):
        return f"dict({len(value)} keys)"
    if isinstance(value, str):
        return value if len(value.encode()) <= 60 else value.encode()[:57].decode(errors="ignore") + "..."
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return str(value)


def extracted(df: DataFrame, json: str, fields: dict[str, str]) -> DataFrame:
    """``df`` with a column for each JSON path, as text; null where the path or valid JSON is missing."""
    return df.withColumns({name: F.get_json_object(F.col(json), path) for name, path in fields.items()})


def exploded(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, field, value) of the top-level fields of JSON objects."""
    fields = F.from_json(F.col(json), "map<string,string>")
    return df.select(key, F.explode(fields).alias("field", "value"))
