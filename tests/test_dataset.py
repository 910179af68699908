"""Formats, slots, validation, profiles, merging and the verbs on a small dataset with every kind of column."""

import json
import os

import numpy as np
import pytest
from helpers import rows

from annomat import api, cli, sources
from annomat.errors import DtypeMismatchError, InvalidFormatError, MissingFieldError, NotFoundError, UnsupportedVersionError
from annomat.model import AnnotatedMatrix
from annomat.operators import columns, merge, profile, provenance, slots, uns, validate
from annomat.sources import bpcells, npy


@pytest.fixture(scope="module")
def data(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (2, 0, 4.0), (2, 3, 5.0)], "obs_idx long, var_idx long, value float")
    obs = spark.createDataFrame([(0, "c0", 1, 0.5, True, "A", "n0"), (1, "c1", 2, None, None, "B", "n1"), (2, "c2", 3, 2.5, False, "A", "n2")], "obs_idx long, obs_id string, count int, score double, active boolean, label string, notes string")
    var = spark.createDataFrame([(j, f"g{j}", j % 2 == 0) for j in range(4)], "var_idx long, var_id string, highly_variable boolean")
    layer = spark.createDataFrame([(0, 1, 9.0), (1, 2, 8.0), (2, 3, 7.0)], "obs_idx long, var_idx long, value float")
    pca = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(3)], "idx long, vec array<double>")
    loadings = spark.createDataFrame([(j, [0.1 * j, 1.0]) for j in range(4)], "idx long, vec array<double>")
    knn = spark.createDataFrame([(0, 1, 21.0), (1, 2, 22.0), (2, 0, 23.0)], "i long, j long, value float")
    tree = {"title": "small", "nested": {"a": 1, "list": [1, 2]}, "flag": True}
    return AnnotatedMatrix(spark, 3, 4, "f32", x, obs, var, layers={"spliced": layer}, obsm={"X_pca": pca}, varm={"PCs": loadings}, obsp={"knn": knn}, uns=tree, levels={"obs": {"label": ["A", "B"]}, "var": {}}, layer_dtypes={"spliced": "f32"})


def equal(a, b, tables=True):
    assert a.shape == b.shape and a.dtype == b.dtype
    assert rows(a.x, "obs_idx", "var_idx", "value") == rows(b.x, "obs_idx", "var_idx", "value")
    if tables:
        for slot in ("obs", "var"):
            assert [c for c in getattr(a, slot).columns] == [c for c in getattr(b, slot).columns]
        for slot in ("layers", "obsm", "varm", "obsp"):
            assert set(getattr(a, slot)) == set(getattr(b, slot))
            for k in getattr(a, slot):
                assert rows(getattr(a, slot)[k]) == rows(getattr(b, slot)[k])
        assert a.uns == b.uns


def test_bundle(spark, data, tmp_path):
    path = data.write(str(tmp_path / "b"))
    back = api.read(spark, path)
    equal(data, back)
    assert rows(data.obs) == rows(back.obs) and back.levels["obs"]["label"] == ["A", "B"]


def test_snapshot_round_trip(spark, data, tmp_path):
    path = data.write(str(tmp_path / "s"), "npy")
    back = api.read(spark, path, chunk_size=2)
    equal(data, back)
    got = {r["obs_id"]: r for r in back.obs.collect()}
    assert got["c1"]["score"] != got["c1"]["score"] and got["c1"]["active"] is False and got["c1"]["label"] == "B" and got["c2"]["notes"] == "n2"
    assert np.load(f"{path}/X/indptr.npy").tolist() == [0, 2, 3, 5] and os.path.getsize(f"{path}/X/data.npy") % 4 == 0
    with open(f"{path}/X/data.npy", "rb") as f:
        head = f.read(128)
    assert head.endswith(b"\n") and head[:8] == b"\x93NUMPY\x01\x00"


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_chunk_size_changes_nothing(spark, data, tmp_path, chunk):
    path = data.write(str(tmp_path / "s"), "npy", only="X,obs_index,var_index")
    back = api.read(spark, path, chunk_size=chunk)
    assert rows(back.x) == rows(data.x) and back.x.rdd.getNumPartitions() == -(-3 // chunk)
    assert rows(back.x.where("obs_idx >= 1 and obs_idx < 2")) == rows(data.x.where("obs_idx = 1"))


def test_row_filter_reaches_the_source(spark, data, tmp_path):
    back = api.read(spark, data.write(str(tmp_path / "s"), "npy"), chunk_size=1)
    assert back.x.where("obs_idx >= 1 and obs_idx < 2").rdd.getNumPartitions() == 1


def test_snapshot_selection(spark, data, tmp_path):
    path = data.write(str(tmp_path / "s"), "npy", exclude="X, obs:notes, layers, obs_index")
    back = api.read(spark, path)
    assert back.x.count() == 0 and "notes" not in back.obs.columns and not back.layers and set(back.obsm) == {"X_pca"}
    assert rows(back.obs, "obs_id") == [["0"], ["1"], ["2"]]


def test_snapshot_errors(spark, data, tmp_path):
    path = data.write(str(tmp_path / "s"), "npy")
    with pytest.raises(MissingFieldError):
        npy.load(f"{path}/absent.npy")
    with pytest.raises(DtypeMismatchError):
        npy.load(f"{path}/X/data.npy", "<f8")
    (tmp_path / "bad.npy").write_bytes(b"not an array")
    with pytest.raises(InvalidFormatError):
        npy.load(str(tmp_path / "bad.npy"))
    (tmp_path / "v2.npy").write_bytes(b"\x93NUMPY\x02\x00")
    with pytest.raises(UnsupportedVersionError):
        npy.load(str(tmp_path / "v2.npy"))
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((20, 30))))
    with pytest.raises(InvalidFormatError):
        npy.load(str(tmp_path / "f.npy"), "<f8", 2)


CANONICAL = np.array([[1, 0, 3, 0, 0], [0, 2, 0, 4, 0], [5, 0, 0, 0, 6], [0, 0, 7, 0, 8]])


def matrix(spark, dense, dtype="u32"):
    """obs = columns of ``dense``."""
    n, m = dense.shape[1], dense.shape[0]
    cells = [(int(i), int(j), float(dense[j, i])) for j, i in zip(*np.nonzero(dense), strict=True)]
    kind = {"u32": "long", "f32": "float", "f64": "double"}[dtype]
    x = spark.createDataFrame(cells, "obs_idx long, var_idx long, value double").selectExpr("obs_idx", "var_idx", f"cast(value as {kind}) value")
    obs = spark.createDataFrame([(i, f"c{i}") for i in range(n)], "obs_idx long, obs_id string")
    var = spark.createDataFrame([(j, f"r{j}") for j in range(m)], "var_idx long, var_id string")
    return AnnotatedMatrix(spark, n, m, dtype, x, obs, var)


@pytest.mark.parametrize("dtype", ["u32", "f32", "f64"])
@pytest.mark.parametrize("packed", [True, False])
def test_packed_directories(spark, tmp_path, dtype, packed):
    data = matrix(spark, CANONICAL, dtype)
    back = api.read(spark, data.write(str(tmp_path / "m"), "bpcells", packed=packed), chunk_size=2)
    equal(data, back, tables=False)
    assert rows(back.obs) == rows(data.obs) and rows(back.var) == rows(data.var)


def test_packed_known_files(spark, tmp_path):
    path = matrix(spark, CANONICAL).write(str(tmp_path / "m"), "bpcells")
    assert bpcells.array(f"{path}/idxptr").tolist() == [0, 2, 3, 5, 6, 8]
    assert bpcells.array(f"{path}/shape").tolist() == [4, 5]
    assert bpcells.array(f"{path}/index_data")[:4].tolist() == [48, 28, 17, 17]
    assert open(f"{path}/version").read().strip() == "packed-uint-matrix-v2"
    with pytest.raises(InvalidFormatError):
        bpcells.Directory(path).rows(0, 6)


@pytest.mark.parametrize("dense", [np.zeros((4, 5), int), np.array([[1], [0], [5], [0]]), np.diag([2147483647, 1073741824, 1, 1000000]), np.stack([np.arange(1, 129), np.zeros(128, int)], 1), np.stack([np.arange(1, 257), np.zeros(256, int)], 1)])
def test_packed_shapes(spark, tmp_path, dense):
    data = matrix(spark, dense)
    equal(data, api.read(spark, data.write(str(tmp_path / "m"), "bpcells")), tables=False)


def test_packed_over_128_observations(spark, tmp_path):
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 9, (40, 300)) * (rng.random((40, 300)) < 0.2)
    data = matrix(spark, dense)
    equal(data, api.read(spark, data.write(str(tmp_path / "m"), "bpcells"), chunk_size=37), tables=False)


def test_row_order_and_bad_directories(spark, tmp_path):
    path = matrix(spark, CANONICAL).write(str(tmp_path / "m"), "bpcells")
    (tmp_path / "m" / "storage_order").write_text("row\n")
    assert bpcells.Directory(path).n_obs == 4 and bpcells.Directory(path).n_vars == 5
    (tmp_path / "m" / "version").write_text("packed-uint-matrix-v9\n")
    with pytest.raises(UnsupportedVersionError):
        bpcells.Directory(path)
    with pytest.raises(NotFoundError):
        sources.detect(str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(InvalidFormatError):
        sources.detect(str(tmp_path / "empty"))


def test_slot_filter():
    f = slots.SlotFilter.parse(only="X, obs , obsm:X_pca")
    assert f.includes("X") and f.includes("obs:score") and f.includes("obsm:X_pca") and not f.includes("obsm:X_umap") and not f.includes("obs_index")
    g = slots.SlotFilter(("obs",), ("obs:score",))
    assert g.includes("obs:count") and not g.includes("obs:score")
    assert slots.x_slot("auto", "counts", {"counts"}) == "data" and slots.x_slot("auto", "counts", set()) == "counts" and slots.x_slot("scale", "counts", {"counts"}) == "scale"


def test_qualifiers():
    for text, op, n in ((500, "==", 500), (">= 1000", ">=", 1000), ("> 0", ">", 0), ("<= 50000", "<=", 50000), ("< 100", "<", 100), ("== 8000", "==", 8000), ("42", "==", 42), (-3, "==", 0)):
        q = validate.Qualifier.parse(text)
        assert (q.op, q.value) == (op, n)
    for bad in ("about 5", "", ">=", "1.5"):
        with pytest.raises(InvalidFormatError):
            validate.Qualifier.parse(bad)


def test_validation(data, tmp_path):
    (tmp_path / "s.yaml").write_text("obs: '>= 3'\nvars: 4\nx_dtype: f32\nlayers: [spliced]\nobsm: [X_pca]\nobsp: [knn]\nobs_columns: [score, label]\nvar_columns: [highly_variable]\nobs_index_unique: true\nvar_index_unique: true\ncheck_finite: true\ncheck_finite_layers: [spliced]\ncheck_sorted_indices: true\n")
    report = validate.run(data, validate.Schema.load(str(tmp_path / "s.yaml")))
    assert report.passed and report.n_failed == 0 and [c.name for c in report.checks][:4] == ["obs", "vars", "x_dtype", "layers"]
    bad = validate.run(data, validate.Schema.of({"obs": "< 3", "layers": ["zz", "spliced", "aa"], "x_dtype": "f64"}))
    assert not bad.passed and bad.n_failed == 3 and bad.checks[2].detail == "missing: zz, aa"
    assert json.loads(bad.json("f", "s"))["checks"][0]["status"] == "fail" and "0 passed, 3 failed" in bad.text()
    with pytest.raises(InvalidFormatError):
        validate.Schema.of({"nonsense": 1})


def test_validation_of_values(spark, data):
    from dataclasses import replace

    twice = replace(data, x=data.x.union(data.x.limit(1)), obs=data.obs.union(data.obs.limit(1)))
    report = validate.run(twice, validate.Schema(obs_index_unique=True, check_sorted_indices=True))
    assert [c.ok for c in report.checks] == [False, False]
    nan = replace(data, x=spark.createDataFrame([(0, 0, float("nan"))], data.x.schema))
    assert not validate.run(nan, validate.Schema(check_finite=True)).passed
    packed = spark.createDataFrame([([0, 2, 1],), ([0, 1],), ([],)], "indices array<long>")
    assert validate.sorted_indices(packed).first()["detail"] == "1 rows not sorted"


def test_profile(data):
    text = profile.report(data, "here")
    assert "3 obs x 4 vars" in text and "categorical: A, B (2 levels)" in text and "uns:nested  dict(2 keys)" in text and "layers:spliced  3 x 4, 3 stored, f32" in text
    assert columns.preview(list("abcdefg")) == "a, b, c, d, e, ... (7 levels)"
    assert uns.summary("x" * 70) == "x" * 57 + "..." and uns.summary([1, 2]) == "array[2]" and uns.summary(None) == "null"


def test_uns_trees():
    tree = {"a": {"b": [1, "x"], "c": None}, "d": {}}
    assert [x[:2] for x in uns.leaves(tree)] == [("/a/b/0", "number"), ("/a/b/1", "string"), ("/a/c", "null"), ("/d", "object")]
    assert uns.merged({"a": {"x": 1}, "b": 2}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert uns.strict({"s": "t", "n": 1, "f": True, "l": [1], "z": None, "o": {"k": "v", "b": False}}) == {"s": "t", "n": 1, "o": {"k": "v"}}


def test_categories(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "i long, c string")
    known = columns.levels(df, "c")
    assert rows(known, "code", "level") == [[0, "a"], [1, "b"]]
    coded = columns.encoded(df, "c", known)
    assert {r["i"]: r["code"] for r in coded.collect()} == {0: 1, 1: 0, 2: None, 3: 1}
    odd = spark.createDataFrame([(0, 1), (1, -1), (2, 9), (3, None)], "i long, code int")
    assert {r["i"]: r["x"] for r in columns.decoded(odd, "code", known, "x").collect()} == {0: "b", 1: None, 2: None, 3: None}
    assert [columns.code_width(n) for n in (127, 128, 32767, 32768)] == ["tinyint", "smallint", "smallint", "int"]


def test_merge(spark, data):
    obs = spark.createDataFrame([(0, "c2", 7, True)], "obs_idx long, obs_id string, depth int, good boolean")
    var = spark.createDataFrame([(0, "g3")], "var_idx long, var_id string")
    x = spark.createDataFrame([(0, 0, 5.0)], "obs_idx long, var_idx long, value float")
    patch = AnnotatedMatrix(spark, 1, 1, "f32", x, obs, var, layers={"extra": x}, uns={"nested": {"b": 2}})
    out = merge.merge(data, patch)
    assert {r["obs_id"]: (r["depth"], r["good"]) for r in out.obs.collect()} == {"c0": (None, False), "c1": (None, False), "c2": (7, True)}
    assert rows(out.layers["extra"], "obs_idx", "var_idx", "value") == [[2, 3, 5.0]] and out.uns["nested"] == {"a": 1, "list": [1, 2], "b": 2}
    with pytest.raises(InvalidFormatError):
        merge.merge(out, patch)
    assert merge.merge(out, patch, "skip").layers["extra"] is out.layers["extra"]
    stranger = AnnotatedMatrix(spark, 1, 1, "f32", x, obs.selectExpr("obs_idx", "'zz' obs_id"), var)
    with pytest.raises(InvalidFormatError):
        merge.merge(data, stranger)


def test_merge_verb(spark, data, tmp_path):
    """Patches from files, one with the slots named; the record tells what came from where."""
    base = data.write(str(tmp_path / "base.bundle"))
    obs = spark.createDataFrame([(0, "c2", 7)], "obs_idx long, obs_id string, depth int")
    var = spark.createDataFrame([(0, "g3", True)], "var_idx long, var_id string, chosen boolean")
    x = spark.createDataFrame([(0, 0, 5.0)], "obs_idx long, var_idx long, value float")
    edges = spark.createDataFrame([(0, 0, 2.0)], "i long, j long, value float")
    vec = spark.createDataFrame([(0, [1.5])], "idx long, vec array<double>")
    patch = AnnotatedMatrix(spark, 1, 1, "f32", x, obs, var, layers={"extra": x}, varm={"own": vec}, obsp={"g": edges}, varp={"h": edges})
    path = patch.write(str(tmp_path / "p.h5ad"), "h5ad")
    out = api.merge(spark, base, [f"{path}:varm/own,obsp/g,var/chosen"], str(tmp_path / "out.bundle"), tags={"stage": "one"})
    back = api.read(spark, out)
    assert rows(back.varm["own"]) == [[3, [1.5]]] and rows(back.obsp["g"], "i", "j", "value") == [[2, 2, 2.0]] and "extra" not in back.layers and "h" not in back.varp and "depth" not in back.obs.columns
    assert {r["var_id"]: r["chosen"] for r in back.var.collect()}["g3"] is True
    record = back.uns[provenance.MERGE_KEY]
    assert record["patches"][0]["slots"] == ["obsp/g", "var/chosen", "varm/own"] and record["patches"][0]["sha256"] == provenance.sha256_file(path) and record["tags"] == {"stage": "one"}
    assert json.load(open(f"{out}.prov.json"))["base"]["n_obs"] == 3
    whole = merge.merge(data, patch)
    assert rows(whole.varp["h"], "i", "j", "value") == [[3, 3, 2.0]] and "own" in whole.varm


def test_slices(data):
    part = data.slice_obs(1, 3)
    assert part.shape == (2, 4) and rows(part.x, "obs_idx", "var_idx", "value") == [[0, 1, 3.0], [1, 0, 4.0], [1, 3, 5.0]]
    assert rows(part.obsp["knn"], "i", "j", "value") == [[0, 1, 22.0]]
    with pytest.raises(InvalidFormatError):
        data.slice_obs(2, 5)


def test_verbs(spark, data, tmp_path, capsys):
    start = data.write(str(tmp_path / "a.bundle"))
    out = str(tmp_path / "b.bpcells")
    assert api.convert(spark, start, out, dtype="u32") == out
    assert json.load(open(f"{out}.prov.json"))["n_obs"] == 3
    assert rows(api.read(spark, out).x, "obs_idx", "var_idx", "value") == [[0, 0, 1], [0, 2, 2], [1, 1, 3], [2, 0, 4], [2, 3, 5]]
    again = api.convert(spark, start, str(tmp_path / "c.bundle"))
    assert api.read(spark, again).uns[provenance.UNS_KEY]["n_vars"] == 4
    with pytest.raises(ValueError):
        api.convert(spark, start, out, dtype="f16")
    assert cli.run(spark, cli.parser().parse_args(["validate", start, "--min-obs", "3", "--has-layer", "spliced"])) == 0
    assert cli.run(spark, cli.parser().parse_args(["validate", start, "--min-obs", "4", "--json"])) == 1
    assert cli.run(spark, cli.parser().parse_args(["inspect", start])) == 0
    snap = str(tmp_path / "snap")
    assert cli.run(spark, cli.parser().parse_args(["snapshot", start, snap, "--only", "X,obs_index"])) == 0
    assert api.read(spark, snap).x.count() == 5
    assert "3 obs x 4 vars" in capsys.readouterr().out
    data.register("m")
    assert spark.sql("select sum(value) s from m_x").first()["s"] == 15.0


def test_provenance(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    want = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert provenance.sha256_file(str(tmp_path / "f.bin")) == want
    assert provenance.file_hashes(spark, str(tmp_path / "f.bin")).first()["sha256"] == want
    assert provenance.record("a", 1, 2) == provenance.record("a", 1, 2)


def test_stream(spark, data, tmp_path):
    from annomat import streaming

    path = data.write(str(tmp_path / "b"))
    q = streaming.copy(streaming.chunks(spark, f"{path}/X"), str(tmp_path / "copy"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "copy"))) == rows(data.x)
    q = streaming.running_profile(streaming.chunks(spark, f"{path}/X"), 2).writeStream.format("memory").queryName("profile").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("profile"), "row_offset", "nnz", "total") == [[0, 3, 6.0], [2, 2, 9.0]]
