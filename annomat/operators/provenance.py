"""Where a dataset came from: content hashes, records and sidecars."""

from __future__ import annotations

import datetime
import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat import __version__

UNS_KEY, MERGE_KEY = "annomat_provenance", "annomat_merge"


def sha256_file(path: str, block: int = 1 << 16) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(block):
            digest.update(chunk)
    return digest.hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files in any store, hashed where they are read; a file must fit one row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def utc_now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(source: str, n_obs: int, n_vars: int, sha: str | None = None, url: str | None = None) -> dict[str, Any]:
    """The part of the record that goes into the dataset: no time, so equal inputs give equal outputs."""
    out: dict[str, Any] = {"tool": f"annomat {__version__}", "source": source, "n_obs": n_obs, "n_vars": n_vars}
    if sha:
        out["source_sha256"] = sha
    if url:
        out["source_url"] = url
    return out


def record_column(source: Column, n_obs: Column, n_vars: Column, sha: Column) -> Column:
    """The same record as JSON text for each row of a DataFrame."""
    return F.to_json(F.struct(source.alias("source"), n_obs.alias("n_obs"), n_vars.alias("n_vars"), sha.alias("source_sha256")))


def write_sidecar(output: str, found: dict[str, Any]) -> str:
    """``<output>.prov.json`` with the record, the output and the time."""
    path = f"{output.rstrip('/')}.prov.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found | {"output": output, "converted_at": utc_now()}, f, indent=2, sort_keys=True)
    return path
