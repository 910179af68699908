"""Formats: detection, readers and writers. ``read`` and ``write`` dispatch by format name."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from annomat.errors import InvalidFormatError, NotFoundError
from annomat.model import AnnotatedMatrix

FORMATS = ("bundle", "npy", "bpcells", "h5ad", "h5seurat", "h5")


def _module(format: str):
    from annomat.sources import bpcells, bundle, hdf5, npy

    found = {"bundle": bundle, "npy": npy, "bpcells": bpcells, "h5ad": hdf5, "h5seurat": hdf5, "h5": hdf5}
    if format not in found:
        raise InvalidFormatError(f"unknown format {format!r}; expected one of {', '.join(FORMATS)}")
    return found[format]


def register(spark: SparkSession) -> None:
    """Makes the formats known to ``spark.read.format``."""
    from annomat.sources import bpcells, npy

    spark.dataSource.register(bpcells.BpcellsSource)
    spark.dataSource.register(npy.NpySource)


def detect(path: str) -> str:
    """The format of a path: directories by their marker files, files by content, then by extension."""
    import os

    if os.path.isdir(path):
        there = set(os.listdir(path))
        if "manifest.json" in there:
            return "bundle"
        if "meta.json" in there:
            return "npy"
        if {"version", "storage_order"} <= there:
            return "bpcells"
        raise InvalidFormatError(f"{path} has none of the marker files of a known format")
    if not os.path.exists(path):
        raise NotFoundError(path)
    from annomat.sources import hdf5

    return hdf5.detect(path)


def read(spark: SparkSession, path: str, format: str | None = None, **options: Any) -> AnnotatedMatrix:
    format = format or detect(path)
    return _module(format).read(spark, path, **({"format": format} if format in ("h5ad", "h5seurat", "h5") else {}), **options)


def write(data: AnnotatedMatrix, path: str, format: str = "bundle", **options: Any) -> str:
    if format == "h5":
        raise InvalidFormatError("the internal HDF5 layout is read only")
    return _module(format).write(data, path, **({"format": format} if format in ("h5ad", "h5seurat") else {}), **options)
