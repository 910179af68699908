import pytest
from helpers import rows
from pyspark.sql import functions as F

from annomat.functions import casts
from annomat.operators import layout


def coo(spark, cells):
    return spark.createDataFrame(cells, "obs_idx long, var_idx long, value double")


def axis(spark, n):
    return spark.range(n).withColumnRenamed("id", "idx")


def test_index_is_dense_and_in_order(spark):
    keys = [(k * 7919) % 100_003 - 50_000 for k in range(1000)]
    out = layout.with_index(spark.createDataFrame([(k,) for k in keys], "key long"), "key", "idx")
    assert sorted((r["key"], r["idx"]) for r in out.collect()) == [(k, i) for i, k in enumerate(sorted(keys))]


def test_index_of_nothing_and_one(spark):
    none = spark.createDataFrame([], "key long")
    assert layout.with_index(none, "key", "idx").collect() == []
    assert layout.with_index(spark.createDataFrame([(5,)], "key long"), "key", "idx").first()["idx"] == 0


def test_pointers_repeat_for_empty_rows(spark):
    x = coo(spark, [(0, 0, 1.0), (0, 2, 2.0), (3, 1, 3.0)])
    assert rows(layout.indptr(x, axis(spark, 5), "obs_idx"), "pos", "ptr") == [[0, 0], [1, 2], [2, 2], [3, 2], [4, 3], [5, 3]]
    assert rows(layout.indptr(x.limit(0), axis(spark, 0), "obs_idx"), "pos", "ptr") == [[0, 0]]


def test_running_total_over_many_ranges(spark):
    n = 3000
    counts = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7).alias("n"))
    got = {r["i"]: r["ptr"] for r in layout.running_total(counts).collect()}
    total, want = 0, {0: 0}
    for i in range(n):
        total += i % 7
        want[i + 1] = total
    assert got == want


def test_columns_to_rows(spark):
    x = coo(spark, [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)])
    by_column = layout.packed_rows(x, "var_idx", "obs_idx")
    assert rows(by_column, "var_idx", "indices", "values") == [[0, [0], [1.0]], [1, [1], [3.0]], [2, [0], [2.0]]]
    back = layout.unpacked(by_column, "var_idx", "obs_idx")
    assert rows(back, "obs_idx", "var_idx", "value") == rows(x, "obs_idx", "var_idx", "value")


def test_slices_and_chunks(spark):
    x = coo(spark, [(i, j, float(i + j)) for i in range(20) for j in range(3)])
    assert rows(layout.slice_rows(x, 1, 3), "obs_idx", "var_idx", "value") == [[i - 1, j, float(i + j)] for i in (1, 2) for j in range(3)]
    for size in (1, 7, 1000, 20):
        p = layout.chunk_profile(x, axis(spark, 20), size).collect()
        assert sum(r["nnz"] for r in p) == 60 and sum(r["nrows"] for r in p) == 20 and len(p) == -(-20 // size)


def test_dense_drops_both_zeros_and_keeps_nan(spark):
    dense = spark.createDataFrame([(0, [1.0, 0.0, -0.0]), (1, [float("nan"), 2.0, 0.0]), (2, None)], "i long, v array<double>")
    got = layout.dense_to_triples(dense, "i", "v").collect()
    assert sorted((r["obs_idx"], r["var_idx"]) for r in got) == [(0, 0), (1, 0), (1, 1)]
    assert rows(layout.dense_columns(dense.where("i < 1"), "i", "v"), "pos", "vec") == [[0, [1.0]], [1, [0.0]], [2, [-0.0]]]
    assert layout.stored_transposed(30, 2700, 2700) and not layout.stored_transposed(5, 5, 5) and not layout.stored_transposed(5, 2, 5)


def test_casts_truncate_and_saturate(spark):
    df = spark.createDataFrame([(1e20,), (-1e20,), (1.9,), (-1.9,), (float("nan"),), (None,)], "v double")
    got = df.select(casts.to_dtype(F.col("v"), "i32").alias("i"), casts.to_dtype(F.col("v"), "u32").alias("u"), casts.nan_for_null(F.col("v")).alias("n")).collect()
    assert [r["i"] for r in got] == [2147483647, -2147483648, 1, -1, 0, None]
    assert [r["u"] for r in got] == [4294967295, 0, 1, 0, 0, None]
    assert got[5]["n"] != got[5]["n"]


def test_cells_are_summed_before_the_join(spark):
    facts = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 5), ("zz", "x", 9)], "o string, v string, n long")
    obs = spark.createDataFrame([("a", 0), ("b", 1)], "key string, idx long")
    var = spark.createDataFrame([("x", 0), ("y", 1)], "key string, idx long")
    assert rows(layout.triples(facts, obs, var, "o", "v", F.col("n")), "obs_idx", "var_idx", "value") == [[0, 0, 3], [1, 1, 5]]


def test_shared_folder(spark, monkeypatch):
    from annomat import shared
    from annomat.errors import AnnotatedMatrixError

    named = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_folder(spark) == named and shared.mounted_folder(spark) == named

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf = type("C", (), {"master": master})(), type("D", (), {"get": staticmethod(lambda *_: folder)})()

    assert "annomat-" in shared.shared_folder(Session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(AnnotatedMatrixError):
            shared.shared_folder(Session(master))
    with pytest.raises(AnnotatedMatrixError):
        shared.mounted_folder(Session("yarn", "hdfs://host/tmp"))
    assert shared.mounted_folder(Session("yarn", "file:///mnt/x")) == "/mnt/x"
