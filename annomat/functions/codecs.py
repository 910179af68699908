"""Integer codecs in DataFrame algebra: zig-zag, frame of reference, delta (D1Z) and 128-value bit packing.

A stream is a DataFrame (k, v): position from 0 and an unsigned 32-bit value held as a long. Chunks are 128 consecutive
positions. A chunk of width b is packed into 4 b words in four interleaved lanes: value r goes to lane r % 4 from bit
(r // 4) * b on, and word w of a lane is stored at 4 w + lane. Everything but the running offset over chunks partitions by
chunk; that offset is summed in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annomat.operators.layout import running_total

CHUNK = 128
_MASK = 4294967295


def zigzag(delta: Column) -> Column:
    return F.when(delta >= 0, 2 * delta).otherwise(-2 * delta - 1).cast("long")


def unzigzag(value: Column) -> Column:
    return F.when(value % 2 == 0, F.shiftright(value, 1)).otherwise(-F.shiftright(value + 1, 1)).cast("long")


def shifted(value: Column) -> Column:
    """Frame of reference 1, wrapping at zero."""
    return (value - 1).bitwiseAND(F.lit(_MASK))


def unshifted(value: Column) -> Column:
    return (value + 1).bitwiseAND(F.lit(_MASK))


def bits_needed(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("int")


def chunked(stream: DataFrame) -> DataFrame:
    """(c, vs): the values of each chunk in order; the one shuffle that a codec needs."""
    entries = F.array_sort(F.collect_list(F.struct("k", "v")))
    return stream.groupBy(F.shiftright("k", 7).alias("c")).agg(entries.alias("_e")).select("c", F.col("_e.v").alias("vs"))


def with_before(chunks: DataFrame) -> DataFrame:
    """Adds before: the last value of the chunk before, 0 for the first; a join of one row for each chunk."""
    carried = chunks.select((F.col("c") + 1).alias("c"), F.element_at("vs", -1).alias("_carry"))
    return chunks.join(carried, "c", "left").select("c", F.coalesce("_carry", F.lit(0)).cast("long").alias("before"), "vs")


def _exploded(chunks: DataFrame, values: str) -> DataFrame:
    """(k, c, r, u) from an array of each chunk."""
    rows = chunks.select("c", F.posexplode(values).alias("r", "u"))
    return rows.select((F.col("c") * CHUNK + F.col("r")).alias("k"), "c", "r", "u")


def d1z(stream: DataFrame) -> DataFrame:
    """(k, c, r, u): zig-zagged deltas."""
    chunks = with_before(chunked(stream))
    delta = F.zip_with("vs", F.concat(F.array("before"), F.slice("vs", 1, F.size("vs") - 1)), lambda v, p: zigzag(v - p))
    return _exploded(chunks.withColumn("us", delta), "us")


def d1z_starts(stream: DataFrame) -> DataFrame:
    """(c, start): the value before each chunk."""
    return with_before(chunked(stream)).select("c", F.col("before").alias("start"))


def frame(stream: DataFrame) -> DataFrame:
    """(k, c, r, u): values less one."""
    placed = stream.withColumn("c", F.shiftright("k", 7)).withColumn("r", (F.col("k") % CHUNK).cast("int"))
    return placed.select("k", "c", "r", shifted(F.col("v")).alias("u"))


def widths(coded: DataFrame) -> DataFrame:
    """(c, b): bits of the widest value of each chunk."""
    return coded.groupBy("c").agg(bits_needed(F.max("u")).alias("b"))


def pack(coded: DataFrame) -> DataFrame:
    """(c, b, pos, word): all 4 b words of each chunk, zero words included; chunks of width 0 have none.

    The values of a chunk are gathered once. Word w of a lane ors the parts of the lane's values whose bits [j b, j b + b) meet
    [32 w, 32 w + 32).
    """
    entries = F.array_sort(F.collect_list(F.struct("r", "u")))
    chunks = coded.groupBy("c").agg(entries.alias("_e")).select("c", F.col("_e.u").alias("us")).withColumn("b", bits_needed(F.array_max("us"))).where("b > 0")
    from_bit = "32 * cast(p div 4 as int)"
    value = "coalesce(get(us, 4 * j + p % 4), 0L)"
    part = f"if(j * b >= {from_bit}, shiftleft({value}, j * b - {from_bit}), shiftright({value}, {from_bit} - j * b)) & {_MASK}L"
    values = f"sequence(cast({from_bit} div b as int), cast(least(31, ({from_bit} + 31) div b) as int))"
    words = F.expr(f"transform(sequence(0, 4 * b - 1), p -> aggregate({values}, 0L, (a, j) -> a | ({part})))")
    return chunks.select("c", "b", F.posexplode(words).alias("pos", "word"))


def word_offsets(coded: DataFrame) -> DataFrame:
    """(c, idx): the first word of each chunk in the whole stream, and one row past the last with the total."""
    return running_total(widths(coded).select(F.col("c").alias("i"), (4 * F.col("b")).cast("long").alias("n"))).select(F.col("i").alias("c"), F.col("ptr").alias("idx"))


def unpack(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(c, r, u) of all values; ``packed`` has all words of a chunk, ``chunks`` has (c, b, count), width 0 gives zeros."""
    words = packed.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w")).select("c", F.col("_w.word").alias("m"))
    place, bit = "4 * cast(cast(r div 4 as int) * b div 32 as int) + r % 4", "cast(r div 4 as int) * b % 32"
    low = f"shiftright(coalesce(get(m, {place}), 0L), {bit})"
    high = f"if({bit} + b > 32, shiftleft(coalesce(get(m, {place} + 4), 0L), 32 - {bit}), 0L)"
    values = F.expr(f"transform(sequence(0, count - 1), r -> if(b = 0, 0L, ({low} | {high}) & (shiftleft(1L, b) - 1)))")
    return chunks.join(words, "c", "left").select("c", F.posexplode(values).alias("r", "u"))


def undo_d1z(coded: DataFrame, starts: DataFrame) -> DataFrame:
    """(k, v) from (c, r, u) and (c, start)."""
    w = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    s = coded.join(starts, "c").withColumn("v", F.col("start") + F.sum(unzigzag(F.col("u"))).over(w))
    return s.select((F.col("c") * CHUNK + F.col("r")).alias("k"), "v")


def undo_frame(coded: DataFrame) -> DataFrame:
    return coded.select((F.col("c") * CHUNK + F.col("r")).alias("k"), unshifted(F.col("u")).alias("v"))


def chunk_table(coded: DataFrame) -> DataFrame:
    """(c, b, count) of each chunk."""
    return coded.groupBy("c").agg(bits_needed(F.max("u")).alias("b"), F.count("*").cast("int").alias("count"))
