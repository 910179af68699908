"""Adapters for HDF5 layouts: annotated-data files, Seurat-style files and the internal layout.

Files are read and written with the h5py package where it is installed, and else with :mod:`annomat.sources.h5file`. The driver
reads what tells where things lie, and levels; everything else is read by tasks, each its own rows. Executors write sorted pieces
that the driver adds to the file. Layouts are resolved by attributes and then by storage type.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import ExitStack, closing
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from annomat.errors import InvalidFormatError, MissingFieldError, NotFoundError
from annomat.functions import bitpack
from annomat.functions.casts import false_for_null, nan_for_null, spark_type, to_dtype
from annomat.model import AnnotatedMatrix
from annomat.operators.columns import code_width
from annomat.operators.layout import stored_transposed
from annomat.operators.profile import column_kinds
from annomat.operators.uns import strict
from annomat.sources import bpcells
from annomat.sources.chunks import CHUNK_SIZE, RangeReader, Rows, chosen, option, pushdown, triples
from annomat.sources.parts import Pieces, SparseRows, ahead, counted, numbers, offsets, vectors

#: Elements of a chunk of the arrays that are written.
CHUNK = 65_536


def _h5() -> Any:
    try:
        import h5py
    except ModuleNotFoundError:
        from annomat.sources import h5file

        return h5file
    return h5py


def _text(x: Any) -> Any:
    return x.decode() if isinstance(x, bytes) else x


def _strings(d: Any) -> list[str]:
    return [_text(x) for x in np.asarray(d[()]).tolist()]


def detect(path: str) -> str:
    """By content: the root's encoding, cell names with an active assay, or X/shape; else by extension."""
    try:
        with _h5().File(path, "r") as f:
            if _text(f.attrs.get("encoding-type", "")) == "anndata":
                return "h5ad"
            if "cell.names" in f and "active.assay" in f.attrs:
                return "h5seurat"
            if "X/shape" in f:
                return "h5"
    except OSError as e:
        raise InvalidFormatError(f"{path}: {e}") from e
    return {".h5ad": "h5ad", ".h5seurat": "h5seurat"}.get(os.path.splitext(path)[1].lower(), "h5")


def _dtype(kind: np.dtype) -> str:
    """The matrix dtype of a storage type; 64-bit integers are held as 32-bit ones."""
    return {"f4": "f32", "f8": "f64", "i4": "i32", "i8": "i32", "u4": "u32", "u8": "u32"}.get(kind.str[1:], "i32" if kind.kind in "iu" else "f64")


class _Spot:
    """Where a sparse or dense matrix lies: kind csr (pointers along rows that are read), dense, or packed."""

    def __init__(self, path: str, group: str, kind: str, shape: tuple[int, int], dtype: str, nnz: int | None = None):
        self.path, self.group, self.kind, self.shape, self.dtype, self.nnz = path, group, kind, shape, dtype, nnz

    def each(self) -> float:
        """Entries a row on average."""
        return self.shape[1] if self.nnz is None else self.nnz / max(1, self.shape[0])

    def rows(self, a: int, b: int, names: tuple[str, str]) -> pa.RecordBatch:
        with _h5().File(self.path, "r") as f:
            g = f[self.group]
            if self.kind == "dense":
                block = np.asarray(g[a:b])
                at, col = np.nonzero(block)
                ptr = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=b - a))])
                return triples(a, ptr, col, self._cast(block[at, col]), self.dtype, names)
            if self.kind == "packed":
                return self._packed(g, a, b, names)
            ptr = np.asarray(g["indptr"][a : b + 1]).astype(np.int64)
            cut = slice(int(ptr[0]), int(ptr[-1]))
            return triples(a, ptr, np.asarray(g["indices"][cut]), self._cast(np.asarray(g["data"][cut])), self.dtype, names)

    def _cast(self, v: np.ndarray) -> np.ndarray:
        if self.dtype in ("f32", "f64"):
            return v.astype("f4" if self.dtype == "f32" else "f8")
        low, high = ((-(1 << 31), (1 << 31) - 1) if self.dtype == "i32" else (0, (1 << 32) - 1))
        return np.clip(np.nan_to_num(np.trunc(v.astype(np.float64)), nan=0.0, posinf=high, neginf=low), low, high).astype(np.int64)

    def _packed(self, g: Any, a: int, b: int, names: tuple[str, str]) -> pa.RecordBatch:
        ptr = np.asarray(g["idxptr"][a : b + 1]).astype(np.int64)
        s, e = int(ptr[0]), int(ptr[-1])
        first, last = s // bitpack.CHUNK, -(-e // bitpack.CHUNK)
        cut = slice(s - first * bitpack.CHUNK, e - first * bitpack.CHUNK)
        if s == e:
            return triples(a, ptr, np.empty(0, np.int64), np.empty(0, np.int64), self.dtype, names)

        def words(stem: str) -> tuple[np.ndarray, np.ndarray]:
            begin = np.asarray(g[f"{stem}_idx"][first : last + 1]).astype(np.int64)
            return np.asarray(g[f"{stem}_data"][int(begin[0]) : int(begin[-1])]), begin - begin[0]

        index = bitpack.decode_d1z(*words("index"), np.asarray(g["index_starts"][first:last]))[cut] if "index_data" in g else np.asarray(g["index"][s:e])
        value = bitpack.decode_frame(*words("val"))[cut] if "val_data" in g else np.asarray(g["val"][s:e])
        return triples(a, ptr, index, value, self.dtype, names)


class _Table:
    """Where a metadata table lies: ids and columns, each a dataset of its own."""

    def __init__(self, path: str, prefix: str, n: int, ids: str | None, columns: list[dict[str, Any]]):
        self.path, self.prefix, self.shape, self.ids, self.columns = path, prefix, (n, len(columns)), ids, columns

    def schema(self) -> str:
        return ", ".join([f"{self.prefix}_idx bigint", f"{self.prefix}_id string", *(f"`{c['name']}` {c['type']}" for c in self.columns)])

    def rows(self, a: int, b: int) -> pa.RecordBatch:
        with _h5().File(self.path, "r") as f:
            ids = [_text(x) for x in f[self.ids][a:b].tolist()] if self.ids else [str(i) for i in range(a, b)]
            arrays = [pa.array(np.arange(a, b, dtype=np.int64)), pa.array(ids, pa.string()), *(self._column(f, c, a, b) for c in self.columns)]
        return pa.RecordBatch.from_arrays(arrays, names=[f"{self.prefix}_idx", f"{self.prefix}_id", *(c["name"] for c in self.columns)])

    @staticmethod
    def _column(f: Any, c: dict[str, Any], a: int, b: int) -> pa.Array:
        v = np.asarray(f[c["at"]][a:b])
        kind = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c["type"]]
        if c["how"] == "codes":
            levels, code = _strings(f[c["levels"]]), v.astype(np.int64) - c["base"]
            return pa.array([levels[k] if 0 <= k < len(levels) else None for k in code.tolist()], kind)
        if c["how"] == "logical":
            return pa.array([None if k == 2 else k == 1 for k in v.tolist()], kind)
        mask = np.asarray(f[c["mask"]][a:b]).astype(bool) if c["how"] == "masked" else None
        if c["type"] == "string":
            v = np.array([_text(x) for x in v.tolist()], object)
        elif c["type"] == "int":
            v = np.clip(v, -(1 << 31), (1 << 31) - 1).astype(np.int32)
        else:
            v = v.astype(bool if c["type"] == "boolean" else np.float64)
        return pa.array(v, kind, mask=mask)


class _Block:
    """Where a dense matrix of row vectors lies, perhaps stored the other way round."""

    def __init__(self, path: str, at: str, shape: tuple[int, int], turned: bool):
        self.path, self.at, self.shape, self.turned = path, at, shape, turned

    def rows(self, a: int, b: int) -> pa.RecordBatch:
        with _h5().File(self.path, "r") as f:
            d = f[self.at]
            block = np.asarray(d[:, a:b]).T if self.turned else np.asarray(d[a:b])
        flat = pa.array(np.ascontiguousarray(block, np.float64).ravel())
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]), flat)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int64)), vec], names=["idx", "vec"])


class Hdf5Source(DataSource):
    """One slot of a file; used through :func:`read`, which resolves where it lies."""

    @classmethod
    def name(cls) -> str:
        return "annomat_hdf5"

    def _spot(self) -> _Spot | _Table | _Block:
        found = json.loads(self.options["spot"])
        kind = {"matrix": _Spot, "table": _Table, "vectors": _Block}[found.pop("slot")]
        return kind(self.options["path"], **found)

    def schema(self) -> str:
        spot = self._spot()
        if isinstance(spot, _Table):
            return spot.schema()
        if isinstance(spot, _Block):
            return "idx bigint, vec array<double>"
        i, j = option(self.options, "names", "obs_idx,var_idx").split(",")
        return f"{i} bigint, {j} bigint, value {spark_type(spot.dtype)}"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return chosen(_Reader(self._spot(), option(o, "chunk_size", CHUNK_SIZE), tuple(option(o, "names", "obs_idx,var_idx").split(","))), o)


class _Reader(RangeReader):
    def __init__(self, spot: _Spot | _Table | _Block, chunk: int, names: tuple[str, str]):
        column = names[0] if isinstance(spot, _Spot) else f"{spot.prefix}_idx" if isinstance(spot, _Table) else "idx"
        super().__init__(spot.shape[0], chunk, column, spot.each() if isinstance(spot, _Spot) else spot.shape[1])
        self.spot, self.names = spot, names

    def rows_of(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        own = (self.names,) if isinstance(self.spot, _Spot) else ()
        yield self.spot.rows(partition.start, partition.stop, *own)


def _frame(spark: SparkSession, spot: _Spot | _Table | _Block, chunk: int, names: str = "obs_idx,var_idx") -> DataFrame:
    slot = {_Spot: "matrix", _Table: "table", _Block: "vectors"}[type(spot)]
    held = {k: v for k, v in vars(spot).items() if k != "path"}
    if slot == "table":
        held["n"] = held.pop("shape")[0]
    r = spark.read.format("annomat_hdf5").option("spot", json.dumps({"slot": slot, **held}))
    return r.option("chunk_size", chunk).option("pushdown", pushdown(spark)).option("names", names).load(spot.path)


def _block(path: str, at: str, d: Any, n: int) -> _Block:
    turned = stored_transposed(*d.shape, n)
    return _Block(path, at, d.shape[::-1] if turned else tuple(d.shape), turned)


def _tree(g: Any) -> Any:
    """A group as JSON; what can't be read is null."""
    if hasattr(g, "keys"):
        return {k: _tree(g[k]) for k in g}
    try:
        v = g[()]
        v = v.tolist() if hasattr(v, "tolist") else v
        return [_text(x) for x in v] if isinstance(v, list) else _text(v)
    except (OSError, TypeError, ValueError):
        return None


def _type(kind: np.dtype) -> str | None:
    """The engine's type for a stored column; None for types it doesn't know."""
    if kind.kind == "b" or kind == np.uint8:
        return "boolean"
    return "int" if kind.kind in "iu" else "double" if kind.kind == "f" else "string" if kind.kind in "OS" else None


def _plain(name: str, at: str, d: Any) -> dict[str, Any] | None:
    found = None if hasattr(d, "keys") or len(d.shape) != 1 else _type(d.dtype)
    return found and {"name": name, "type": found, "how": "plain", "at": at}


# Annotated-data files


def _h5ad_column(name: str, at: str, d: Any) -> dict[str, Any] | None:
    kind = _text(d.attrs.get("encoding-type", ""))
    if kind == "categorical" or hasattr(d, "keys") and "codes" in d:
        return {"name": name, "type": "string", "how": "codes", "at": f"{at}/codes", "levels": f"{at}/categories", "base": 0}
    if kind.startswith("nullable") or hasattr(d, "keys") and "mask" in d:
        found = _type(d["values"].dtype)
        return found and {"name": name, "type": found, "how": "masked", "at": f"{at}/values", "mask": f"{at}/mask"}
    return _plain(name, at, d)


def _h5ad_table(path: str, f: Any, prefix: str, skipped: list[str]) -> tuple[_Table, dict[str, list[str]]]:
    g = f[prefix]
    index = f"{prefix}/{_text(g.attrs.get('_index', 'index'))}"
    order = [_text(c) for c in np.asarray(g.attrs.get("column-order", [])).tolist()]
    found = {c: _h5ad_column(c, f"{prefix}/{c}", g[c]) if c in g else None for c in order}
    skipped += [f"{prefix}:{c}" for c, x in found.items() if x is None]
    columns = [x for x in found.values() if x is not None]
    return _Table(path, prefix, len(f[index]), index, columns), {x["name"]: _strings(f[x["levels"]]) for x in columns if x["how"] == "codes"}


def _sparse_spot(path: str, name: str, g: Any, dtype: str | None = None) -> _Spot:
    if not hasattr(g, "keys"):
        return _Spot(path, name, "dense", tuple(g.shape), dtype or _dtype(g.dtype))
    if _text(g.attrs.get("encoding-type", "csr_matrix")) == "csc_matrix":
        raise InvalidFormatError(f"{name} is stored by columns")
    n, m = (int(x) for x in g.attrs["shape"])
    if len(g["indptr"]) != n + 1:
        raise InvalidFormatError(f"{name} has {len(g['indptr'])} pointers for {n} rows")
    return _Spot(path, name, "csr", (n, m), dtype or _dtype(g["data"].dtype), len(g["data"]))


def _read_h5ad(spark: SparkSession, path: str, chunk: int) -> AnnotatedMatrix:
    skipped: list[str] = []
    with _h5().File(path, "r") as f:
        root = _text(f.attrs.get("encoding-type", "anndata"))
        if root != "anndata":
            raise InvalidFormatError(f"the root's encoding is {root!r}")
        for need in ("X", "obs", "var"):
            if need not in f:
                raise MissingFieldError(f"{path}: {need}")
        x = _sparse_spot(path, "X", f["X"])
        obs, obs_levels = _h5ad_table(path, f, "obs", skipped)
        var, var_levels = _h5ad_table(path, f, "var", skipped)
        n, m = x.shape
        layers = {k: _sparse_spot(path, f"layers/{k}", f["layers"][k]) for k in f.get("layers", {})}
        graphs = {slot: {k: _sparse_spot(path, f"{slot}/{k}", f[slot][k]) for k in f.get(slot, {})} for slot in ("obsp", "varp")}
        vectors = {slot: {k: _block(path, f"{slot}/{k}", f[slot][k], size) for k in f.get(slot, {}) if not hasattr(f[slot][k], "keys") and len(f[slot][k].shape) == 2} for slot, size in (("obsm", n), ("varm", m))}
        uns = _tree(f["uns"]) if "uns" in f else {}
    return AnnotatedMatrix(
        spark, n, m, x.dtype, _frame(spark, x, chunk), _frame(spark, obs, chunk), _frame(spark, var, chunk), layers={k: _frame(spark, s, chunk) for k, s in layers.items()}, layer_dtypes={k: s.dtype for k, s in layers.items()},
        **{slot: {k: _frame(spark, s, chunk, "i,j") for k, s in own.items()} for slot, own in graphs.items()}, **{slot: {k: _frame(spark, s, chunk) for k, s in own.items()} for slot, own in vectors.items()},
        uns=uns, levels={"obs": obs_levels, "var": var_levels}, skipped=tuple(skipped), format="h5ad", in_order=True,
    )


# Seurat-style files: matrices lie by columns of genes x cells, which are rows of cells x genes


def _seurat_spot(path: str, f: Any, name: str, n: int, m: int) -> _Spot | None:
    g = f[name]
    if not hasattr(g, "keys"):
        return None
    if "idxptr" in g:
        version = _text(np.asarray(g.attrs.get("version", b"packed-uint-matrix-v2")).ravel()[0])
        return _Spot(path, name, "packed", (n, m), "u32" if "uint" in version else "f32" if "float" in version else "f64", int(np.asarray(g["idxptr"][n:]).sum()))
    return _Spot(path, name, "csr", (n, m), _dtype(g["data"].dtype), len(g["data"])) if "indptr" in g else None


def _seurat_table(path: str, f: Any, at: str, prefix: str, ids: str, skipped: list[str]) -> tuple[_Table, dict[str, list[str]]]:
    g, columns, levels = f.get(at), [], {}
    logicals = {_text(x) for x in np.asarray(g.attrs.get("logicals", [])).ravel().tolist()} if g is not None else set()
    for c in (list(g) if g is not None else []):
        if c in ("_index", "index"):
            continue
        d, place = g[c], f"{at}/{c}"
        if hasattr(d, "keys") and "levels" in d:
            columns.append({"name": c, "type": "string", "how": "codes", "at": f"{place}/values", "levels": f"{place}/levels", "base": 1})
            levels[c] = _strings(d["levels"])
        elif not hasattr(d, "keys") and c in logicals:
            columns.append({"name": c, "type": "boolean", "how": "logical", "at": place})
        elif (found := _plain(c, place, d)) is not None:
            columns.append(found)
        else:
            skipped.append(f"{prefix}:{c}")
    return _Table(path, prefix, len(f[ids]), ids, columns), levels


def _read_h5seurat(spark: SparkSession, path: str, chunk: int, assay: str, layer: str) -> AnnotatedMatrix:
    skipped: list[str] = []
    with _h5().File(path, "r") as f:
        base = f"assays/{assay}"
        if base not in f:
            raise MissingFieldError(f"{path}: {base}")
        a = f[base]
        n, m = len(f["cell.names"]), len(a["features"])
        places = [p for p in (f"{base}/{layer}", f"{base}/layers/{layer}") if p in f]
        if not places or (x := _seurat_spot(path, f, places[0], n, m)) is None:
            raise MissingFieldError(f"{path}: layer {layer!r} of assay {assay!r}")
        obs, obs_levels = _seurat_table(path, f, "meta.data", "obs", "cell.names", skipped)
        var, var_levels = _seurat_table(path, f, f"{base}/meta.features", "var", f"{base}/features", skipped)
        layers = {}
        for at in (base, f"{base}/layers"):
            for k in f[at] if at in f else []:
                if f"{at}/{k}" != places[0] and k not in layers and hasattr(f[f"{at}/{k}"], "keys") and k not in ("layers", "meta.features", "misc"):
                    s = _seurat_spot(path, f, f"{at}/{k}", n, m)
                    if s is not None and len(f[f"{at}/{k}"]["idxptr" if s.kind == "packed" else "indptr"]) == n + 1:
                        layers[k] = s
        graphs = {k: s for k in f.get("graphs", {}) if (s := _seurat_spot(path, f, f"graphs/{k}", n, n)) is not None}
        obsm, varm = {}, {}
        for k in f.get("reductions", {}):
            r = f["reductions"][k]
            key = f"X_{k.lower()}"
            if "cell.embeddings" in r:
                obsm[key] = _block(path, f"reductions/{k}/cell.embeddings", r["cell.embeddings"], n)
            if "feature.loadings" in r and m in r["feature.loadings"].shape:
                varm[key] = _block(path, f"reductions/{k}/feature.loadings", r["feature.loadings"], m)
        uns = _tree(f["misc"]) if "misc" in f else {}
    return AnnotatedMatrix(
        spark, n, m, x.dtype, _frame(spark, x, chunk), _frame(spark, obs, chunk), _frame(spark, var, chunk), layers={k: _frame(spark, s, chunk) for k, s in layers.items()}, layer_dtypes={k: s.dtype for k, s in layers.items()},
        obsp={k: _frame(spark, s, chunk, "i,j") for k, s in graphs.items()}, obsm={k: _frame(spark, s, chunk) for k, s in obsm.items()}, varm={k: _frame(spark, s, chunk) for k, s in varm.items()},
        uns=uns, levels={"obs": obs_levels, "var": var_levels}, skipped=tuple(skipped), format="h5seurat", in_order=True,
    )


def _read_h5(spark: SparkSession, path: str, chunk: int) -> AnnotatedMatrix:
    """The internal layout, read only: X by columns of genes x cells, obs, var and obsm; other slots are empty."""
    with _h5().File(path, "r") as f:
        m, n = (int(x) for x in f["X/shape"][()])
        declared = {"float32": "f32", "float64": "f64", "int32": "i32", "uint32": "u32"}.get(_text(f["X/data"].attrs.get("dtype", "")))
        x = _Spot(path, "X", "csr", (n, m), declared or _dtype(f["X/data"].dtype), len(f["X/data"]))
        tables = []
        for prefix, size in (("obs", n), ("var", m)):
            g = f[prefix]
            columns = [found for c in g if c != "index" and (found := _plain(c, f"{prefix}/{c}", g[c])) is not None]
            tables.append(_Table(path, prefix, size, f"{prefix}/index" if "index" in g else None, columns))
        obsm = {k: _block(path, f"obsm/{k}", f["obsm"][k], n) for k in f.get("obsm", {})}
    return AnnotatedMatrix(spark, n, m, x.dtype, _frame(spark, x, chunk), *(_frame(spark, t, chunk) for t in tables), obsm={k: _frame(spark, s, chunk) for k, s in obsm.items()}, format="h5", in_order=True)


def read(spark: SparkSession, path: str, format: str | None = None, chunk_size: int = CHUNK_SIZE, assay: str = "RNA", layer: str = "counts", **_: Any) -> AnnotatedMatrix:
    if not os.path.exists(path):
        raise NotFoundError(path)
    spark.dataSource.register(Hdf5Source)
    format = format or detect(path)
    if format == "h5ad":
        return _read_h5ad(spark, path, chunk_size)
    if format == "h5seurat":
        return _read_h5seurat(spark, path, chunk_size, assay, layer)
    return _read_h5(spark, path, chunk_size)


# Writers: executors sort each slot and write its pieces, the driver adds them to the file a block at a time


class _Sink:
    """A file that is written, and how its growing arrays are stored."""

    def __init__(self, file: Any, chunk: int = CHUNK, compression: str | None = None):
        self.file, self.how = file, {"chunks": (chunk,), **({"compression": compression} if compression else {})}

    def append(self, g: Any, name: str, kind: Any, blocks: Iterator[Any]) -> None:
        d = g.create_dataset(name, shape=(0,), maxshape=(None,), dtype=kind, **self.how)
        for block in blocks:
            own = np.frombuffer(block, kind) if isinstance(block, bytes) else np.asarray(block, object if isinstance(block, list) else None)
            if len(own):
                at = d.shape[0]
                d.resize((at + len(own),))
                d[at:] = own

    def texts(self, g: Any, name: str, rows: Pieces, stream: str = "id") -> None:
        d = g.create_dataset(name, shape=(0,), maxshape=(None,), dtype=_h5().string_dtype(), **self.how)
        for size, raw in rows.texts(stream):
            at = d.shape[0]
            d.resize((at + len(size),))
            if hasattr(d, "add_texts"):
                d.add_texts(size, raw)
            else:
                d[at:] = np.asarray([raw[e - s : e].decode() for s, e in zip(size.tolist(), np.cumsum(size).tolist(), strict=True)], object)

    def sparse(self, g: Any, rows: SparseRows) -> None:
        with rows:
            self.append(g, "data", rows.kind, rows.stream("data"))
            self.append(g, "indices", "<i4", rows.stream("index"))
            self.append(g, "indptr", "<i8", rows.pointers())

    def packed(self, g: Any, rows: SparseRows, chunks: Pieces, m: int, ids: tuple[Pieces, Pieces]) -> None:
        """Rows as a packed group: one stream of 128-value chunks over all rows, as its readers expect."""
        n, kind, integers = rows.n, rows.kind, rows.kind == "<u4"
        with rows, chunks:
            self.append(g, "idxptr", "<u8", rows.pointers())
            if not integers:
                self.append(g, "val", kind, rows.stream("data"))
            self.append(g, "index_starts", "<u4", chunks.stream("starts"))
            for stem, widths in (("index", "widths"), *((("val", "val_widths"),) if integers else ())):
                self.append(g, f"{stem}_data", "<u4", chunks.stream(stem))
                begins, turns, _ = offsets(chunks, widths)
                self.append(g, f"{stem}_idx", "<u4", begins)
                g.create_dataset(f"{stem}_idx_offsets", data=turns)
        g.create_dataset("shape", data=np.asarray([m, n], "<u4"))
        g.create_dataset("storage_order", data=np.asarray(["col"], object))
        for name, own in zip(("row_names", "col_names"), ids, strict=True):
            self.texts(g, name, own)
        g.attrs["version"] = np.asarray([f"packed-{ {'<u4': 'uint', '<f4': 'float', '<f8': 'double'}[kind]}-matrix-v2"], object)


_KINDS = {"f32": "<f4", "f64": "<f8", "i32": "<i4", "u32": "<u4"}


def _packed(x: DataFrame, n: int, dtype: str, names: tuple[str, str], in_order: bool) -> tuple[SparseRows, Pieces]:
    """Pieces of a sparse matrix and of its packed chunks."""
    rows = SparseRows(x, n, bpcells.stored_dtype(dtype), _KINDS[bpcells.stored_dtype(dtype)], names, in_order)
    try:
        return rows, rows.packed(rows.kind == "<u4")
    except BaseException:
        rows.__exit__()
        raise


def _tables(data: AnnotatedMatrix) -> list[Any]:
    """Jobs that write the pieces of the metadata tables and of the row vectors by key."""
    jobs = [partial(_metadata, getattr(data, slot), slot, data.levels.get(slot, {}), data.in_order) for slot in ("obs", "var")]
    return jobs + [partial(vectors, getattr(data, slot)[key], data.in_order) for slot in ("obsm", "varm") for key in sorted(getattr(data, slot))]


def _component(rows: Pieces, width: int, k: int) -> np.ndarray:
    """One component of all vectors."""
    return np.concatenate([np.memmap(f"{p.stem}.vec", "<f8", "r").reshape(-1, width)[:, k] for p in rows.pieces]) if rows.pieces else np.empty(0)


def _put_json(g: Any, tree: dict[str, Any]) -> None:
    for k, v in tree.items():
        if isinstance(v, dict):
            _put_json(g.create_group(k), v)
        elif isinstance(v, list) and not all(isinstance(x, str) for x in v) and not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            _put_json(g.create_group(k), {str(i): x for i, x in enumerate(v)})
        elif isinstance(v, bool):
            g.create_dataset(k, data=np.int32(v))
        elif v is not None:
            g.create_dataset(k, data=np.asarray(v, object) if isinstance(v, list) and v and isinstance(v[0], str) else v)


def _metadata(df: DataFrame, slot: str, levels: dict[str, list[str]], in_order: bool) -> tuple[list[tuple[str, str]], Pieces]:
    """(column, kind) of a metadata table, and its pieces: streams ``id`` and a number for each column; categories as codes, -1 for none."""
    kinds = column_kinds(df, (f"{slot}_idx", f"{slot}_id"), levels)
    columns = [F.col(f"{slot}_idx").cast("long").alias("_idx"), F.col(f"{slot}_id").alias("_id")]
    for k, (c, kind) in enumerate(kinds):
        v = F.col(f"`{c}`")
        if kind == "categorical":
            codes = F.create_map(*[y for i, x in enumerate(levels[c]) for y in (F.lit(x), F.lit(i))]) if levels[c] else None
            v = F.coalesce(F.element_at(codes, v), F.lit(-1)) if codes is not None else F.lit(-1)
        else:
            v = {"int": lambda x: F.coalesce(to_dtype(x, "i32"), F.lit(0)), "float": nan_for_null, "bool": false_for_null}.get(kind, lambda x: F.coalesce(x.cast("string"), F.lit("")))(v)
        columns.append(v.alias(f"_{k}"))

    def encode(batch: pa.RecordBatch) -> dict[str, bytes]:
        own = {str(k): counted(batch.column(k + 2)) if kind == "string" else numbers(batch.column(k + 2), _STORED[kind]) for k, (_, kind) in enumerate(kinds)}
        return {"id": counted(batch.column(1)), **own}

    return kinds, Pieces(df.sparkSession).sorted(df.select(*columns), encode, in_order=in_order)


_STORED = {"int": "<i4", "float": "<f8", "bool": "u1", "categorical": "<i4"}


def _codes(rows: Pieces, k: int, kind: str, base: int = 0) -> Iterator[np.ndarray]:
    for block in rows.stream(str(k)):
        yield (np.frombuffer(block, "<i4") + base).astype(kind)


def _write_h5ad(data: AnnotatedMatrix, path: str, dtype: str, chunk: int, compression: str | None) -> None:
    entries = [("X", data.x, data.shape, dtype, ("obs_idx", "var_idx"))]
    entries += [(f"layers/{k}", d, data.shape, data.layer_dtypes.get(k, "f32"), ("obs_idx", "var_idx")) for k, d in data.layers.items()]
    entries += [(f"{slot}/{k}", d, (size, size), "f32", ("i", "j")) for slot, size in (("obsp", data.n_obs), ("varp", data.n_vars)) for k, d in getattr(data, slot).items()]
    jobs = _tables(data) + [partial(SparseRows, df, shape[0], kind, _KINDS[kind], names, data.in_order) for _, df, shape, kind, names in entries]
    with _h5().File(path, "w") as f, closing(ahead(jobs)) as found:
        sink = _Sink(f, chunk, compression)
        f.attrs["encoding-type"], f.attrs["encoding-version"] = "anndata", "0.1.0"
        for slot in ("obs", "var"):
            known = data.levels.get(slot, {})
            kinds, rows = next(found)
            with rows:
                g = f.create_group(slot)
                g.attrs["encoding-type"], g.attrs["encoding-version"], g.attrs["_index"] = "dataframe", "0.2.0", "index"
                g.attrs["column-order"] = np.asarray([c for c, _ in kinds], object)
                sink.texts(g, "index", rows)
                for k, (c, kind) in enumerate(kinds):
                    if kind == "categorical":
                        h = g.create_group(c)
                        h.attrs["encoding-type"], h.attrs["encoding-version"], h.attrs["ordered"] = "categorical", "0.2.0", False
                        width = {"tinyint": "i1", "smallint": "<i2", "int": "<i4"}[code_width(len(known[c]))]
                        sink.append(h, "codes", width, _codes(rows, k, width))
                        h.create_dataset("categories", data=np.asarray(known[c], object))
                    elif kind == "string":
                        sink.texts(g, c, rows, str(k))
                    else:
                        sink.append(g, c, _STORED[kind], rows.stream(str(k)))
        for slot in ("obsm", "varm"):
            g = f.create_group(slot)
            for key in sorted(getattr(data, slot)):
                rows, width = next(found)
                with rows:
                    d = g.create_dataset(key, shape=(0, width), maxshape=(None, width), dtype="<f8", chunks=(max(1, chunk // max(1, width)), max(1, width)))
                    for p in rows.pieces if width else ():
                        own = np.memmap(f"{p.stem}.vec", "<f8", "r").reshape(-1, width)
                        at = d.shape[0]
                        d.resize((at + len(own), width))
                        d[at:] = own
        _put_json(f.create_group("uns"), strict(data.uns))
        for name, _, shape, *_ in entries:
            g = f.create_group(name)
            g.attrs["encoding-type"], g.attrs["encoding-version"], g.attrs["shape"] = "csr_matrix", "0.1.0", np.asarray(shape, "<i8")
            sink.sparse(g, next(found))


def _write_h5seurat(data: AnnotatedMatrix, path: str, assay: str, x_slot: str, project: str, compat: bool, packed: bool, chunk: int) -> None:
    ids: dict[str, Pieces] = {}
    entries = [(f"assays/{assay}/{x_slot}", data.x, data.n_vars, ("obs_idx", "var_idx"), data.dtype)]
    entries += [(f"assays/{assay}/{k}", d, data.n_vars, ("obs_idx", "var_idx"), data.layer_dtypes.get(k, "f32")) for k, d in data.layers.items() if k != x_slot]
    entries += [(f"graphs/{k}", d, data.n_obs, ("i", "j"), "f32") for k, d in data.obsp.items()]
    jobs = _tables(data) + [partial(_packed, df, data.n_obs, kind, names, data.in_order) if packed else partial(SparseRows, df, data.n_obs, "f64", "<f8", names, data.in_order) for _, df, _, names, kind in entries]
    with _h5().File(path, "w") as f, ExitStack() as kept, closing(ahead(jobs)) as found:
        sink = _Sink(f, chunk)
        if compat:
            f.attrs["project"], f.attrs["version"] = project, "3.1.5.9900"
            for name in ("commands", "images", "neighbors", "tools"):
                f.create_group(name)
        f.attrs["active.assay"] = assay
        base = f.create_group(f"assays/{assay}")
        if compat:
            base.attrs["key"] = f"{assay.lower()}_"
        for slot, at in (("obs", "meta.data"), ("var", f"assays/{assay}/meta.features")):
            known = data.levels.get(slot, {})
            kinds, rows = next(found)
            ids[slot] = kept.enter_context(rows)
            sink.texts(f if slot == "obs" else base, "cell.names" if slot == "obs" else "features", rows)
            g = f.create_group(at)
            g.attrs["colnames"] = np.asarray([c for c, _ in kinds], object)
            g.attrs["logicals"] = np.asarray([c for c, k in kinds if k == "bool"], object)
            for k, (c, kind) in enumerate(kinds):
                if kind == "categorical":
                    h = g.create_group(c)
                    h.create_dataset("levels", data=np.asarray(known[c], object))
                    sink.append(h, "values", "<i4", _codes(rows, k, "<i4", 1))
                elif kind == "string":
                    sink.texts(g, c, rows, str(k))
                elif kind == "bool":
                    sink.append(g, c, "<i4", (np.frombuffer(x, "u1").astype("<i4") for x in rows.stream(str(k))))
                else:
                    sink.append(g, c, _STORED[kind], rows.stream(str(k)))
        for slot, name, size in (("obsm", "cell.embeddings", data.n_obs), ("varm", "feature.loadings", data.n_vars)):
            for key in sorted(getattr(data, slot)):
                rows, width = next(found)
                with rows:
                    g = f.require_group(f"reductions/{key.removeprefix('X_')}")
                    d = g.create_dataset(name, shape=(width, size), dtype="<f8")  # contiguous, so that any rows are read alone
                    for k in range(width):  # a component at a time, as they are stored one after the other
                        d[k : k + 1] = _component(rows, width, k)[None, :]
        _put_json(f.create_group("misc"), data.uns)
        for name, _, m, *_ in entries:
            g = f.create_group(name)
            if packed:
                sink.packed(g, *next(found), m, (ids["obs" if name.startswith("graphs/") else "var"], ids["obs"]))
                continue
            g.attrs["dims"] = np.asarray([m, data.n_obs], "<i8")
            sink.sparse(g, next(found))


def write(
    data: AnnotatedMatrix, path: str, format: str = "h5ad", dtype: str | None = None, assay: str = "RNA", x_slot: str = "counts", project: str = "SeuratProject", compat: bool = False, packed: bool = False,
    chunk_size: int = CHUNK, compression: str | None = None, **_: Any,
) -> str:
    """One file, with bit-packed matrices if ``packed`` (Seurat-style files only, which have no place for ``varp``).

    JSON that a layout can't hold is dropped. ``chunk_size`` is the length of stored chunks; ``compression`` is None or ``gzip``.
    """
    if compression not in (None, "gzip"):
        raise ValueError(f"unknown compression {compression!r}; expected gzip or None")
    if format == "h5ad":
        _write_h5ad(data, path, dtype or data.dtype, chunk_size, compression)
    else:
        _write_h5seurat(data, path, assay, x_slot, project, compat, packed, chunk_size)
    return path
