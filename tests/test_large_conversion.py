"""What conversions of large files rest on: few tasks, no sort of what lies in order, no more read than is asked for."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_dataset import data, equal  # noqa: F401

from annomat import api
from annomat.errors import InvalidFormatError
from annomat.functions.casts import rounded
from annomat.plans import fixtures
from annomat.sources import h5file, parts
from annomat.sources.chunks import RangeReader


class Counting(RangeReader):
    def rows_of(self, partition):
        yield partition.start, partition.stop


@pytest.mark.parametrize(("n", "chunk", "each", "tasks"), [(9_000_000, 5000, 4.0, 35), (900_000, 5000, 1.0, 16), (9_000_000, 5000, 1e6, 1800), (100_000_000, 5000, 1.0, 96), (15, 1, 1.0, 15), (0, 5, 1.0, 1)])
def test_tasks_read_several_chunks(n, chunk, each, tasks):
    reader = Counting(n, chunk, None, each)
    found = reader.partitions()
    assert tasks <= len(found) <= 2 * tasks
    got = [x for p in found for x in reader.read(p)]
    assert [a for a, _ in got] == list(range(0, n, chunk)) and all(b - a <= chunk for a, b in got) and (not got or got[-1][1] == n)


@pytest.mark.parametrize(("format", "packed"), [("npy", False), ("h5ad", False), ("h5seurat", False), ("h5seurat", True), ("bpcells", True)])
def test_files_are_not_sorted_again(spark, data, tmp_path, monkeypatch, format, packed):  # noqa: F811
    path = data.write(str(tmp_path / f"a.{format}"), format, packed=packed)
    back = api.read(spark, path, format, chunk_size=1)
    monkeypatch.setattr(parts, "ordered", None)  # a call fails
    for k, target in enumerate(("npy", "h5ad", "h5seurat", "bpcells")):
        again = api.read(spark, back.write(str(tmp_path / f"b{k}.{target}"), target, packed=packed), target)
        assert rows(again.x, "obs_idx", "var_idx", "value") == rows(data.x, "obs_idx", "var_idx", "value") and rows(again.obs, "obs_id") == rows(data.obs, "obs_id")


@pytest.mark.parametrize("order", [[5, 1, 3, 2, 4, 0], [0, 1, 2, 4, 3, 5], [0, 1, 2, 2, 3, 3]])
def test_rows_out_of_order_are_sorted_all_the_same(spark, order):
    """Rows out of order inside a partition, or a row that lies in two of them."""
    df = spark.createDataFrame([(i, 10 - k, float(k)) for k, i in enumerate(order)], "obs_idx long, var_idx long, value double").repartition(1)
    for x in (df, df.repartitionByRange(3, df.obs_idx.desc()), spark.createDataFrame(df.collect(), df.schema)):
        with parts.SparseRows(x, 6, "f64", "<f8", in_order=True) as found:
            want = sorted((i, 10 - k, float(k)) for k, i in enumerate(order))
            assert np.frombuffer(found.whole("index"), "<u4").tolist() == [j for _, j, _ in want] and np.frombuffer(found.whole("data"), "<f8").tolist() == [v for *_, v in want]
            assert np.concatenate(list(found.pointers())).tolist() == [sum(i < r for i in order) for r in range(7)]


def test_embeddings_of_some_rows_are_read_alone(spark, data, tmp_path, monkeypatch):  # noqa: F811
    path = data.write(str(tmp_path / "a.h5seurat"), "h5seurat")
    with h5file.File(path) as f:
        d = f["reductions/pca/cell.embeddings"]
        monkeypatch.setattr(h5file.Dataset, "_rows", None)  # reads whole rows, which are components of all cells
        assert d[:, 1:3].tolist() == [[1.0, 2.0], [-1.0, -2.0]]


def test_vectors_of_several_lengths(spark, data, tmp_path):  # noqa: F811
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0])], "idx long, vec array<double>").repartition(1)
    with pytest.raises(InvalidFormatError):
        parts.vectors(ragged)


def test_texts_of_all_lengths(tmp_path):
    """Collections that are full to the byte, longer strings and empty ones."""
    rng, path = np.random.default_rng(3), str(tmp_path / "a.h5")
    size = np.concatenate([np.zeros(70_000, np.int64), rng.integers(0, 40, 5000), [70_000, 65_488, 65_480, 65_472, 0, 8, 1]])
    raw = rng.integers(97, 122, int(size.sum()), np.uint8).tobytes()
    with h5file.File(path, "w") as f:
        d = f.create_dataset("t", shape=(0,), maxshape=(None,), dtype=h5file.string_dtype(), chunks=(1000,))
        d.resize((len(size),))
        for at in range(0, len(size), 777):
            a, b = int(size[:at].sum()), int(size[: at + 777].sum())
            d.add_texts(size[at : at + 777], raw[a:b])
    ends = np.cumsum(size)
    with h5file.File(path) as f:
        assert f["t"][()].tolist() == [raw[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def test_rounded(spark):
    own = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, -4503599627370497.0, 1e15, 0.0, -0.0, 1.4999, 123456.005 * 100, None]
    df = spark.createDataFrame([(x,) for x in own], "x double").select("x", F.round("x").cast("long").alias("want"), rounded(F.col("x")).alias("got"), rounded(F.col("x").cast("float") * 100).alias("f"), F.round(F.col("x").cast("float") * 100).cast("long").alias("g"))
    assert all(r["want"] == r["got"] and r["f"] == r["g"] for r in df.collect())


def test_cells_read_a_table_once(spark, data):  # noqa: F811
    plan = fixtures.slot_cells(data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("obs_id#") and sum("LogicalRDD [obs_idx" in x and "obs_id#" in x for x in plan.splitlines()) == 1
    want = {(f"obs/{c}", r["obs_idx"]) for r in data.obs.collect() for c in data.obs.columns if c != "obs_idx"}
    assert {(r["slot"], r["a"]) for r in fixtures.slot_cells(data).where("slot like 'obs/%'").collect()} == want
