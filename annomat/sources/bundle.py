"""The native store: one Parquet table for each slot and a manifest.

Sparse tables are range-partitioned and sorted by row, so row ranges prune row groups; keyed slots are partitioned by key,
so one layer or embedding is read without the others. All files are written by executors.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat.errors import NotFoundError
from annomat.model import AnnotatedMatrix

VERSION = 1


def _text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows:
        raise NotFoundError(path)
    return rows[0][0]


def write(data: AnnotatedMatrix, path: str, mode: str = "overwrite", **_: Any) -> str:
    def rows(df: DataFrame, at: str, sort: list[str], keys: tuple[str, ...] = ()) -> None:
        out = df.sortWithinPartitions(*keys, *sort).write.mode(mode)
        (out.partitionBy(*keys) if keys else out).parquet(f"{path}/{at}")

    rows(data.x.repartitionByRange("obs_idx"), "X", ["obs_idx", "var_idx"])
    rows(data.obs.repartitionByRange("obs_idx"), "obs", ["obs_idx"])
    rows(data.var.repartitionByRange("var_idx"), "var", ["var_idx"])
    dtypes: dict[str, dict[str, str]] = {}
    for slot, sort in (("layers", ["obs_idx", "var_idx"]), ("obsp", ["i", "j"]), ("varp", ["i", "j"]), ("obsm", ["idx"]), ("varm", ["idx"])):
        entries: dict[str, DataFrame] = getattr(data, slot)
        groups: dict[str, list[str]] = {}
        for key in sorted(entries):
            groups.setdefault(entries[key].select(*sort, entries[key].columns[-1]).schema.simpleString(), []).append(key)
        dtypes[slot] = {key: f"{slot}-{n}" for n, (_, keys) in enumerate(groups.items()) for key in keys}
        for n, keys in enumerate(groups.values()):
            if len(keys) == 1:  # ranges of rows alone cost far less than those of text and rows
                both = entries[keys[0]].repartitionByRange(sort[0]).withColumn("key", F.lit(keys[0]))
            else:
                both = reduce(DataFrame.unionByName, [entries[k].withColumn("key", F.lit(k)) for k in keys]).repartitionByRange("key", sort[0])
            rows(both, f"{slot}-{n}", sort, ("key",))
    head = {
        "version": VERSION, "n_obs": data.n_obs, "n_vars": data.n_vars, "dtype": data.dtype, "slots": dtypes, "layer_dtypes": data.layer_dtypes,
        "levels": data.levels, "uns": data.uns,
    }
    one = data.spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1)
    one.write.mode(mode).text(f"{path}/manifest.json")  # last: its presence marks a complete bundle
    return path


def read(spark: SparkSession, path: str, **_: Any) -> AnnotatedMatrix:
    head = json.loads(_text(spark, f"{path}/manifest.json"))
    slots = {slot: {k: spark.read.parquet(f"{path}/{table}").where(F.col("key") == k).drop("key") for k, table in keys.items()} for slot, keys in head["slots"].items()}
    return AnnotatedMatrix(
        spark, head["n_obs"], head["n_vars"], head["dtype"], *(spark.read.parquet(f"{path}/{t}") for t in ("X", "obs", "var")),
        uns=head["uns"], levels=head["levels"], layer_dtypes=head["layer_dtypes"], format="bundle", **slots,
    )
