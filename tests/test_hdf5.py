"""The HDF5 adapters, on files of h5py where it is installed and of the repository's own writer elsewhere."""

import numpy as np
import pytest
from helpers import rows
from test_dataset import data, equal  # noqa: F401

from annomat import api, sources
from annomat.errors import InvalidFormatError, MissingFieldError
from annomat.functions import bitpack
from annomat.sources.hdf5 import _h5

h5py = _h5()


def test_h5ad(spark, data, tmp_path):  # noqa: F811
    path = api.write_h5ad(data, str(tmp_path / "a.h5ad"))
    assert sources.detect(path) == "h5ad"
    back = api.read(spark, path, chunk_size=2)
    assert back.shape == data.shape and rows(back.x, "obs_idx", "var_idx", "value") == rows(data.x, "obs_idx", "var_idx", "value")
    got = {r["obs_id"]: r for r in back.obs.collect()}
    assert got["c0"]["label"] == "A" and got["c1"]["active"] is False and got["c0"]["active"] is True and got["c2"]["count"] == 3 and got["c1"]["notes"] == "n1"
    assert back.levels["obs"]["label"] == ["A", "B"] and rows(back.layers["spliced"]) == rows(data.layers["spliced"]) and rows(back.obsp["knn"]) == rows(data.obsp["knn"])
    assert rows(back.obsm["X_pca"]) == rows(data.obsm["X_pca"]) and back.uns == {"title": "small", "nested": {"a": 1}}


@pytest.mark.parametrize(("compat", "packed"), [(True, False), (False, False), (False, True)])
def test_h5seurat(spark, data, tmp_path, compat, packed):  # noqa: F811
    path = data.write(str(tmp_path / "a.h5seurat"), "h5seurat", compat=compat, packed=packed)
    assert sources.detect(path) == "h5seurat"
    back = api.read(spark, path, layer="counts")
    assert rows(back.x, "obs_idx", "var_idx", "value") == rows(data.x, "obs_idx", "var_idx", "value") and set(back.layers) == {"spliced"}
    got = {r["obs_id"]: r for r in back.obs.collect()}
    assert got["c1"]["label"] == "B" and got["c0"]["active"] is True and got["c1"]["active"] is False
    assert rows(back.obsm["X_pca"]) == rows(data.obsm["X_pca"]) and rows(back.obsp["knn"], "i", "j", "value") == rows(data.obsp["knn"], "i", "j", "value")
    assert back.uns["nested"] == {"a": 1, "list": [1, 2]} and rows(back.var, "var_id") == rows(data.var, "var_id")


def test_conversion_between_files(spark, data, tmp_path):  # noqa: F811
    start = data.write(str(tmp_path / "a.bundle"))
    out = api.convert(spark, start, str(tmp_path / "b.h5seurat"))
    again = api.convert(spark, out, str(tmp_path / "c.h5ad"))
    assert rows(api.read(spark, again).x, "obs_idx", "var_idx", "value") == rows(data.x, "obs_idx", "var_idx", "value")


def test_hand_made_files(spark, tmp_path):
    path = str(tmp_path / "x.h5ad")
    with h5py.File(path, "w") as f:
        f.attrs["encoding-type"] = "anndata"
        f.create_dataset("X", data=np.array([[1.0, 0.0], [0.0, np.nan], [2.0, -0.0]], "<f4"))
        for slot, n in (("obs", 3), ("var", 2)):
            g = f.create_group(slot)
            g.attrs["_index"], g.attrs["column-order"] = "id", np.asarray(["q", "odd", "cat"], object)
            g.create_dataset("id", data=np.asarray([f"{slot}{i}" for i in range(n)], object))
            h = g.create_group("q")
            h.attrs["encoding-type"] = "nullable-integer"
            h.create_dataset("values", data=np.arange(n, dtype="<i4"))
            h.create_dataset("mask", data=np.arange(n) == 1)
            g.create_dataset("odd", data=np.zeros(n, "<c8"))
            c = g.create_group("cat")
            c.create_dataset("codes", data=np.array([0, -1, 1][:n], "i1"))
            c.create_dataset("categories", data=np.asarray(["u", "v"], object))
        f.create_group("obsm").create_dataset("X_t", data=np.arange(6.0).reshape(2, 3))  # stored the other way round
    back = sources.read(spark, path)
    assert sorted((r["obs_idx"], r["var_idx"]) for r in back.x.collect()) == [(0, 0), (1, 1), (2, 0)]
    assert rows(back.obs, "q", "cat") == sorted([[0, "u"], [None, None], [2, "v"]], key=repr) and "obs:odd" in back.skipped
    assert rows(back.obsm["X_t"], "idx", "vec") == [[0, [0.0, 3.0]], [1, [1.0, 4.0]], [2, [2.0, 5.0]]]
    with h5py.File(str(tmp_path / "csc.h5ad"), "w") as f:
        f.attrs["encoding-type"] = "anndata"
        f.create_group("X").attrs["encoding-type"] = "csc_matrix"
        f.create_group("obs").create_dataset("index", data=np.asarray([], object))
        f.create_group("var").create_dataset("index", data=np.asarray([], object))
    with pytest.raises(InvalidFormatError):
        sources.read(spark, str(tmp_path / "csc.h5ad"))


def test_internal_layout(spark, tmp_path):
    path = str(tmp_path / "x.h5")
    with h5py.File(path, "w") as f:
        f.create_dataset("X/data", data=np.array([1.0, 5.0, 2.0])).attrs["dtype"] = "float32"
        f.create_dataset("X/indices", data=np.array([0, 2, 1], "<i4"))
        f.create_dataset("X/indptr", data=np.array([0.0, 2.0, 3.0]))
        f.create_dataset("X/shape", data=np.array([3, 2]))
        f.create_dataset("obs/index", data=np.asarray(["a", "b"], object))
        f.create_dataset("var/index", data=np.asarray(["x", "y", "z"], object))
        f.create_dataset("obs/n", data=np.array([1.0, 2.0]))
        f.create_group("obsm")
    back = sources.read(spark, path)
    assert back.format == "h5" and back.dtype == "f32" and back.shape == (2, 3)
    assert rows(back.x, "obs_idx", "var_idx", "value") == [[0, 0, 1.0], [0, 2, 5.0], [1, 1, 2.0]]
    with pytest.raises(InvalidFormatError):
        back.write(str(tmp_path / "y.h5"), "h5")


def test_packed_layer(spark, tmp_path):
    """A v5-style file with a packed layer of more than 128 observations."""
    rng = np.random.default_rng(2)
    n, m = 200, 30
    dense = rng.integers(0, 5, (n, m)) * (rng.random((n, m)) < 0.3)
    at, col = np.nonzero(dense)
    path = str(tmp_path / "p.h5seurat")
    with h5py.File(path, "w") as f:
        f.attrs["active.assay"] = "RNA"
        f.create_dataset("cell.names", data=np.asarray([f"c{i}" for i in range(n)], object))
        f.create_dataset("assays/RNA/features", data=np.asarray([f"g{j}" for j in range(m)], object))
        g = f.create_group("assays/RNA/layers/counts")
        g.attrs["version"] = np.asarray([b"packed-uint-matrix-v2"], object)
        words, begin, starts = bitpack.encode_d1z(col)
        values, value_begin = bitpack.encode_frame(dense[at, col])
        for name, v in (("index_data", words), ("index_idx", begin), ("index_starts", starts), ("val_data", values), ("val_idx", value_begin), ("idxptr", np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]))):
            g.create_dataset(name, data=v)
    back = sources.read(spark, path, chunk_size=37)
    assert rows(back.x, "obs_idx", "var_idx", "value") == sorted([[int(i), int(j), int(dense[i, j])] for i, j in zip(at, col, strict=True)], key=repr)
    with pytest.raises(MissingFieldError):
        sources.read(spark, path, layer="absent")
