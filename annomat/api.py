"""Verbs: read, convert, inspect, validate, snapshot, merge."""

from __future__ import annotations

import os
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession

from annomat import sources
from annomat.errors import InvalidFormatError, NotFoundError
from annomat.functions.casts import spark_type
from annomat.model import AnnotatedMatrix
from annomat.operators import merge as merging
from annomat.operators import profile, provenance, slots, uns
from annomat.operators import validate as checks
from annomat.sources.chunks import CHUNK_SIZE

_EXTENSIONS = {".h5ad": "h5ad", ".h5seurat": "h5seurat", ".bundle": "bundle", ".bpcells": "bpcells"}


def read(spark: SparkSession, path: str, format: str | None = None, chunk_size: int = CHUNK_SIZE, assay: str = "RNA", layer: str = "counts") -> AnnotatedMatrix:
    """A dataset of any format; the slots are lazy."""
    return sources.read(spark, path, format, chunk_size=chunk_size, assay=assay, layer=layer)


def read_h5ad(spark: SparkSession, path: str, **options: Any) -> AnnotatedMatrix:
    return read(spark, path, "h5ad", **options)


def read_h5seurat(spark: SparkSession, path: str, assay: str = "RNA", layer: str = "counts", dtype: str = "f32", **options: Any) -> AnnotatedMatrix:
    return read(spark, path, "h5seurat", assay=assay, layer=layer, **options).cast(dtype)


def write_h5ad(data: AnnotatedMatrix, path: str, compression: str | None = "gzip") -> str:
    return data.write(path, "h5ad", compression=compression)


def write_h5seurat(data: AnnotatedMatrix, path: str, assay: str = "RNA", chunk_size: int = CHUNK_SIZE) -> str:
    """``chunk_size`` is the length of the chunks in which arrays are stored."""
    return data.write(path, "h5seurat", assay=assay, chunk_size=chunk_size)


def output_format(path: str, default: str = "bundle") -> str:
    """The format that an output's extension stands for."""
    return _EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower(), default)


def convert(
    spark: SparkSession, input: str, output: str, chunk_size: int = CHUNK_SIZE, dtype: str = "f32", assay: str = "RNA", layer: str = "counts", x_slot: str = "auto",
    project: str = "SeuratProject", compat: bool = False, source_url: str | None = None, format: str | None = None, packed: bool = True,
) -> str:
    """Rewrites a dataset in the output's format with X in ``dtype``, and records where it came from beside it."""
    spark_type(dtype)
    data = read(spark, input, chunk_size=chunk_size, assay=assay, layer=layer).cast(dtype)
    sha = provenance.sha256_file(input) if os.path.isfile(input) else None
    found = provenance.record(input, data.n_obs, data.n_vars, sha, source_url)
    target = format or output_format(output)
    slot = slots.x_slot(x_slot, layer, set(data.layers))
    layers = slots.without_collision(data.layers, slot) if target == "h5seurat" else data.layers
    data = replace(data, layers=layers, uns=uns.merged(data.uns, {provenance.UNS_KEY: found}))
    data.write(output, target, **({"assay": assay, "x_slot": slot, "project": project, "compat": compat, "packed": packed} if target == "h5seurat" else {}))
    if os.path.exists(output):  # not in stores that only Spark reaches
        provenance.write_sidecar(output, found | ({"output_sha256": provenance.sha256_file(output)} if os.path.isfile(output) else {}))
    return output


def inspect(spark: SparkSession, path: str, **options: Any) -> str:
    return profile.report(read(spark, path, **options), path)


def validate(spark: SparkSession, path: str, schema: str | dict[str, Any] | checks.Schema, **options: Any) -> checks.Report:
    if isinstance(schema, str):
        if not os.path.exists(schema):
            raise NotFoundError(schema)
        schema = checks.Schema.load(schema)
    elif isinstance(schema, dict):
        schema = checks.Schema.of(schema)
    return checks.run(read(spark, path, **options), schema)


def snapshot(spark: SparkSession, input: str, output: str, only: str | None = None, exclude: str | None = None, **options: Any) -> str:
    """The selected slots as a directory of arrays; others are never read."""
    if only is not None and exclude is not None:
        raise InvalidFormatError("only and exclude can't both be given")
    keep = slots.SlotFilter.parse(only, exclude)
    return sources.write(read(spark, input, **options), output, "npy", filter=keep)


def merge(spark: SparkSession, base: str, patches: list[str], output: str, policy: str = "error", tags: dict[str, str] | None = None, **options: Any) -> str:
    """``base`` with what the patches bring, in turn: a path, or ``path:slot,slot`` for some slots only, as in ``a.h5ad:obsm/X_pca``.

    The record of the base, of each patch with its hash and slots, and of the tags goes into uns and beside the output.
    """

    def described(path: str, **more: Any) -> dict[str, Any]:
        return {"path": path, **({"sha256": provenance.sha256_file(path)} if os.path.isfile(path) else {}), **more}

    data = read(spark, base, **options)
    found: dict[str, Any] = {"base": described(base, n_obs=data.n_obs, n_vars=data.n_vars), "patches": [], "tags": dict(tags or {})}
    for p in patches:
        path, _, names = (p, "", "") if os.path.exists(p) else p.rpartition(":")
        patch, only = read(spark, path or names, **options), names.split(",") if path and names else None
        data = merging.merge(data, patch, policy, only)
        found["patches"].append(described(path or names, slots=merging.taken(patch, only)))
    data = replace(data, uns=uns.merged(data.uns, {provenance.MERGE_KEY: found}))
    data.write(output, output_format(output))
    if os.path.exists(output):
        provenance.write_sidecar(output, found)
    return output
