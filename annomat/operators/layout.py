"""Layouts of a sparse matrix: coordinate triples, packed rows, row and column pointers, chunks, dense rows.

The logical form is the DataFrame (obs_idx, var_idx, value). Row- and column-major order are sort keys of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomat.functions.casts import to_dtype
from annomat.shared import checkpoint

#: Ranges that a running total is cut into at most; only their totals are ever gathered in one place.
RANGES = 1024
_ROW = (1 << 33) - 1


def with_index(df: DataFrame, key: str | tuple[str, ...], name: str) -> DataFrame:
    """Adds the 0-based rank of unique keys without a single-partition sort; the result is stored and evaluated once.

    Rows are range-partitioned, sorted and checkpointed; a row's rank is its place in its partition and the count of all
    partitions before it. Only these counts, one for each partition, reach the driver.
    """
    keys = (key,) if isinstance(key, str) else key
    spark, names = df.sparkSession, df.columns
    stored = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = stored.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("_row"))
    total, before = 0, []
    for part, count in sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect()):
        before.append((part, total))
        total += count
    starts = spark.createDataFrame(before, "_part int, _before long")  # a row for each partition
    return placed.join(F.broadcast(starts), "_part").select(*[F.col(f"`{c}`") for c in names], (F.col("_before") + F.col("_row")).alias(name))


def running_total(counts: DataFrame) -> DataFrame:
    """(i, ptr): the sum of ``n`` over all smaller ``i``, and a last row with the total at the largest i plus one.

    ``counts`` is (i, n) with dense i from 0. Totals of ranges of i are summed first; there are at most ``RANGES`` of them.
    """
    counts = checkpoint(counts)  # read three times
    top = counts.agg(F.coalesce(F.max("i"), F.lit(-1)).alias("_top"))
    dealt = counts.crossJoin(F.broadcast(top)).withColumn("_g", F.floor(F.col("i") * RANGES / (F.col("_top") + 1)).cast("int"))
    totals = dealt.groupBy("_g").agg(F.sum("n").alias("_n"))
    w = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)  # over at most RANGES rows
    starts = totals.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).select("_g", "_before")
    inner = Window.partitionBy("_g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.join(F.broadcast(starts), "_g").select((F.col("i") + 1).alias("i"), (F.col("_before") + F.sum("n").over(inner)).cast("long").alias("ptr"))
    zero = counts.sparkSession.createDataFrame([(0, 0)], "i long, ptr long")
    return zero.unionByName(ends)


def triples(facts: DataFrame, obs: DataFrame, var: DataFrame, obs_key: str, var_key: str, value: Column, **more: Column) -> DataFrame:
    """(obs_idx, var_idx, value, ``more``) from a fact table: values of one cell are summed before the indexes are attached.

    ``obs`` and ``var`` have (key, idx). Catalyst broadcasts whichever is small.
    """
    cells = facts.groupBy(F.col(obs_key).alias("_o"), F.col(var_key).alias("_v")).agg(F.sum(value).alias("value"), *[F.sum(v).alias(name) for name, v in more.items()])
    o = obs.select(F.col("key").alias("_o"), F.col("idx").alias("obs_idx"))
    v = var.select(F.col("key").alias("_v"), F.col("idx").alias("var_idx"))
    return cells.join(v, "_v").join(o, "_o").select("obs_idx", "var_idx", "value", *more)


def entries_per(x: DataFrame, axis: DataFrame, on: str) -> DataFrame:
    """(i, n) for every index of an axis (idx), empty ones included."""
    n = x.groupBy(F.col(on).alias("idx")).agg(F.count("*").alias("n"))
    return axis.select("idx").join(n, "idx", "left").select(F.col("idx").alias("i"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def indptr(x: DataFrame, axis: DataFrame, on: str) -> DataFrame:
    """(pos, ptr): row pointers along ``on``; the axis has n entries, the pointers n + 1."""
    return running_total(entries_per(x, axis, on)).select(F.col("i").alias("pos"), "ptr")


def packed_rows(x: DataFrame, by: str = "obs_idx", along: str = "var_idx") -> DataFrame:
    """One row for each non-empty row of the matrix: sorted indices and their values."""
    entries = F.array_sort(F.collect_list(F.struct(along, "value")))
    rows = x.groupBy(by).agg(entries.alias("e"))
    return rows.select(by, F.col(f"e.{along}").alias("indices"), F.col("e.value").alias("values"))


def row_blocks(x: DataFrame, size: int, by: str = "obs_idx", along: str = "var_idx") -> DataFrame:
    """(by, part, indices, values): packed rows cut at multiples of ``size``, for rows or columns that are too long for one array."""
    entries = F.array_sort(F.collect_list(F.struct(along, "value")))
    rows = x.groupBy(by, F.floor(F.col(along) / size).cast("long").alias("part")).agg(entries.alias("e"))
    return rows.select(by, "part", F.col(f"e.{along}").alias("indices"), F.col("e.value").alias("values"))


def unpacked(rows: DataFrame, by: str = "obs_idx", along: str = "var_idx") -> DataFrame:
    pairs = rows.select(by, F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return pairs.select(by, F.col("e.indices").alias(along), F.col("e.values").alias("value"))


def ordered(x: DataFrame, major: str = "obs_idx", minor: str = "var_idx") -> DataFrame:
    """Entries in row order (or column order): range-partitioned, then sorted inside partitions."""
    return x.repartitionByRange(major).sortWithinPartitions(major, minor)


def stream(x: DataFrame, of: str) -> DataFrame:
    """(k, v): the indices (``var_idx``) or values of X in row order, numbered from 0."""
    return with_index(x.select("obs_idx", "var_idx", F.col(of).cast("long").alias("v")), ("obs_idx", "var_idx"), "k").select("k", "v")


def slice_rows(x: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows [start, stop), counted from 0 again. The range reaches the scan as a filter."""
    return x.where((F.col("obs_idx") >= start) & (F.col("obs_idx") < stop)).withColumn("obs_idx", F.col("obs_idx") - start)


def chunk_start(index: Column, size: int) -> Column:
    return (index - F.pmod(index, F.lit(size))).cast("long")


def chunk_profile(x: DataFrame, obs: DataFrame, size: int) -> DataFrame:
    """(row_offset, nrows, nnz, total) of each chunk of ``size`` rows."""
    rows = obs.groupBy(chunk_start(F.col("idx"), size).alias("row_offset")).agg(F.count("*").alias("nrows"))
    entries = x.groupBy(chunk_start(F.col("obs_idx"), size).alias("row_offset")).agg(F.count("*").alias("nnz"), F.sum("value").cast("long").alias("total"))
    out = rows.join(entries, "row_offset", "left")
    return out.select("row_offset", "nrows", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def dense_to_triples(rows: DataFrame, index: str, vector: str) -> DataFrame:
    """Non-zero entries of dense rows; NaN stays, both zeros go."""
    out = rows.select(F.col(index).alias("obs_idx"), F.posexplode(vector).alias("var_idx", "value"))
    return out.where(F.col("value") != 0)


def transposed(rows: DataFrame, index: str, vector: str) -> DataFrame:
    """Dense rows of the transpose as (pos, idx, value): one row for each component."""
    return rows.select(F.posexplode(vector).alias("pos", "value"), F.col(index).alias("idx")).select("pos", "idx", "value")


def dense_columns(rows: DataFrame, index: str, vector: str) -> DataFrame:
    """(pos, vec): dense rows of the transpose as arrays in index order, each of all rows; :func:`column_blocks` cuts them."""
    cells = transposed(rows, index, vector).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("e"))
    return cells.select("pos", F.col("e.value").alias("vec"))


def column_blocks(rows: DataFrame, index: str, vector: str, size: int) -> DataFrame:
    """(pos, part, vec): the same for ``size`` consecutive rows each."""
    cells = transposed(rows, index, vector).groupBy("pos", F.floor(F.col("idx") / size).cast("long").alias("part"))
    return cells.agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("e")).select("pos", "part", F.col("e.value").alias("vec"))


def stored_transposed(d0: int, d1: int, n: int) -> bool:
    """Whether a dense matrix for n rows was stored the other way round; a square one is taken as it is."""
    return d0 != n and d1 == n


def sums(x: DataFrame, axis: DataFrame, on: str) -> DataFrame:
    """(idx, total) for every index of an axis, 0 where it is empty."""
    s = x.groupBy(F.col(on).alias("idx")).agg(F.sum("value").alias("total"))
    return axis.select("idx").join(s, "idx", "left").select("idx", F.coalesce("total", F.lit(0)).alias("total"))


def converted(x: DataFrame, dtype: str) -> DataFrame:
    return x.withColumn("value", to_dtype(F.col("value"), dtype))


def submatrix(x: DataFrame, rows: int, cols: int) -> DataFrame:
    """The dense top-left corner as triples with zeros; for comparing small samples."""
    spark = x.sparkSession
    grid = spark.range(rows).withColumnRenamed("id", "obs_idx").join(spark.range(cols).withColumnRenamed("id", "var_idx"))
    corner = x.where((F.col("obs_idx") < rows) & (F.col("var_idx") < cols))
    return grid.join(corner, ["obs_idx", "var_idx"], "left").select("obs_idx", "var_idx", F.coalesce("value", F.lit(0)).alias("value"))
