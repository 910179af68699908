"""Document fingerprints by locally consistent parsing.

A text's symbols are grouped into phrases at places that depend on their neighbourhood only: runs of one symbol collapse,
deterministic coin tossing (the place and value of the lowest bit in which a symbol differs from the one before) shrinks
the labels to a handful in a few rounds, and a phrase starts at every local maximum. A phrase's name is a hash of its
symbols; names are the symbols of the next level. So equal substrings get equal phrases apart from a few at their ends,
wherever they stand. A fingerprint holds the ``KEEP`` least names of each of two levels, phrases of about ten and thirty
bytes; likeness is their estimated Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, frugal, longs, partitions

#: Least names kept of each level, the levels, and UTF-8 bytes parsed in one go (its arrays stay in the cache).
KEEP, LEVELS, PARSE_BYTES = 32, (2, 3), 256 << 10
#: UTF-8 bytes of text for which there is a bucket of neighbours at least, and ranges that quantiles cut ids into.
BUCKET_BYTES, RANGES = 16 << 20, 512
#: What a null id is held as.
FIRST = -(1 << 63)
_U = np.uint64
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, _U), dtype=_U)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWEST = np.array([8, *[(x & -x).bit_length() - 1 for x in range(1, 256)]], np.uint8)


def _tossed(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of at most six values that differ between neighbours; each depends on the four symbols up to it."""
    x = symbol[1:] ^ symbol[:-1]
    low = np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.uint8)
    label = np.empty(len(symbol), np.uint8)
    label[1:] = (low << 1) | ((symbol[1:] >> low) & _U(1)).astype(np.uint8)
    label[first] = (symbol[first] & _U(1)).astype(np.uint8)
    for _ in range(3):
        low = _LOWEST[label[1:] ^ label[:-1]]
        after = np.empty_like(label)
        after[1:] = (low << 1) | ((label[1:] >> low) & 1)
        after[first] = label[first] & 1
        label = after
    return label


def phrases(symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases that the symbols of each document form, and their documents (in order)."""
    if not len(symbol):
        return symbol, doc
    change = np.ones(len(symbol), bool)
    change[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(change)
    run = np.diff(np.append(at, len(symbol)))
    symbol, doc = symbol[at], doc[at]
    many = run > 1
    symbol[many] = _mix(symbol[many] + run[many].astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    edge = doc[1:] != doc[:-1]
    first = np.flatnonzero(np.concatenate([[True], edge]))
    label = _tossed(symbol, first)
    start = np.zeros(len(symbol), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~edge[1:]
    start[first] = True
    begin = np.flatnonzero(start)
    place = np.arange(len(symbol)) - np.repeat(begin, np.diff(np.append(begin, len(symbol))))
    return _mix(np.add.reduceat(symbol * _POWERS[place & 63], begin)), doc[begin]


def sketches(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """For each text the sorted least names, as 32 bits, of each level."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    name = _BYTES[np.frombuffer(b"".join(texts), np.uint8)]
    out = []
    for level in range(1, max(LEVELS) + 1):
        name, doc = phrases(name, doc)
        if level in LEVELS:
            key = np.unique((doc << 32) | (name >> _U(32)).astype(np.int64))
            own = key >> 32
            begin = np.searchsorted(own, np.arange(len(texts) + 1))
            low = (key & 0xFFFFFFFF).astype(np.uint32)
            out.append([low[s : min(e, s + KEEP)] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
    return list(zip(*out, strict=True))


def written(sketch: tuple[np.ndarray, ...]) -> str:
    """A fingerprint as text: the names of each level in hex, levels joined by a dot; an empty text's is empty."""
    return ".".join(x.astype(">u4").tobytes().hex() for x in sketch) if len(sketch[0]) else ""


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Mean over the levels of the estimated Jaccard similarity; two empty texts are alike, an empty and another not."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        own, other = set(x.tolist()), set(y.tolist())
        if not own or not other:
            total += own == other
            continue
        union = sorted(own | other)[:KEEP]
        total += sum(v in own and v in other for v in union) / len(union)
    return total / len(a)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", PARSE_BYTES):
            yield pa.record_batch({"doc_id": part.column(0), "fingerprint": pa.array([written(s) for s in sketches([t or b"" for t in texts])], pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), "doc_id long, fingerprint string")


def _bucket(key: Column, bounds: list[int], low: int = 0) -> Column:
    """How many bounds are at most the key, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _bucket(key, bounds[:mid], low)).otherwise(_bucket(key, bounds[mid + 1 :], low + mid + 1))


def in_turn(docs: DataFrame) -> DataFrame:
    """``docs`` (key, sub, text) dealt to buckets by range, each ending with a guest: the row that follows it in falling order.

    Adds bucket and guest. A bucket's guest is the first row of the next bucket down; the last bucket's is the first of all.
    The number of buckets follows the bytes of text. Ids are cut at quantiles into ``RANGES`` ranges at most, and each of these
    evenly; rows without an id (key ``FIRST``) are cut by ``sub``, a hash. Only bounds and each bucket's first key reach the driver.
    """
    spark = docs.sparkSession
    known, size = F.col("key") != FIRST, F.coalesce(F.octet_length("text"), F.lit(0))
    least, most, whole, without = docs.agg(F.min(F.when(known, F.col("key"))), F.max("key"), F.sum(F.when(known, size)), F.sum(F.when(~known, size + 1))).first()
    low_buckets = 0 if without is None else -(-without // BUCKET_BYTES)
    n = max(4 * partitions(spark), -(-(whole or 0) // BUCKET_BYTES))
    ranges = min(n, RANGES)
    each = -(-n // ranges)
    found = docs.where(known).approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)) if least is not None else []
    bounds = sorted({int(x) for x in found} - {least})
    bucket = _bucket(F.col("key"), bounds)
    if each > 1:
        edges = F.array(*[F.lit(float(x)) for x in (least, *bounds, most + 1)])
        low, high = (F.get(edges, bucket + k) for k in (0, 1))
        inner = F.floor((F.col("key").cast("double") - low) / (high - low) * each).cast("int")
        bucket = bucket * each + F.greatest(F.least(inner, F.lit(each - 1)), F.lit(0))
    share = F.col("sub").cast("double") / float(1 << 64) + 0.5
    bucket = F.when(known, bucket + low_buckets).otherwise(F.least(F.floor(share * low_buckets), F.lit(max(0, low_buckets - 1)))).cast("int")
    dealt = docs.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["first"]["key"], r["first"]["sub"]) for r in dealt.groupBy("bucket").agg(F.max(F.struct("key", "sub")).alias("first")).collect())
    guests = [(key, sub, firsts[(k + 1) % len(firsts)][0]) for k, (_, key, sub) in enumerate(firsts)]
    follow = spark.createDataFrame(guests or [(0, 0, -1)], "key long, sub long, visits int")  # a row for each bucket
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    both = F.when(F.col("visits").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("visits").alias("bucket"), F.lit(1).alias("guest"))))
    rows = dealt.join(F.broadcast(follow), ["key", "sub"], "left").withColumn("_to", F.explode(both)).drop("bucket", "visits")
    return rows.select("*", "_to.bucket", "_to.guest").drop("_to").repartition(max(partitions(spark), -(-n // 4)), "bucket")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A null text counts as empty. Rows follow each other by falling id, rows of one id by their text; null ids come last, by falling
    hash of their text. After the last row comes the first; a single row follows itself.
    """
    ident = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(FIRST)).alias("key"), F.when(ident.isNull(), F.xxhash64(text_col)).otherwise(0).cast("long").alias("sub"), F.col(text_col).alias("text"))
    dealt = in_turn(rows).sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("sub"), "text").select("bucket", "guest", "key", "text")

    def emit(held: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        """The rows of ``held`` that have a successor in it."""
        pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if a[0] == b[0] and not a[1]]
        texts = [h[3] for h in held]
        edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
        raw = [t.encode() for t in edited]
        found = sketches([t.encode() for t in texts])
        changed = sketches(raw)
        at = [k for k, (a, b) in enumerate(zip(held, held[1:], strict=False)) if a[0] == b[0] and not a[1]]
        return pa.record_batch({
            "doc_id": pa.array([None if a[2] == FIRST else a[2] for a, _ in pairs], pa.int64()),
            "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
            "fingerprint": pa.array([written(found[k]) for k in at], pa.string()),
            "edited_fingerprint": pa.array([written(s) for s in changed], pa.string()),
            "near_edited": pa.array([likeness(found[k], s) for k, s in zip(at, changed, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(found[k], found[k + 1]) for k in at], pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, str]] = []
        size = 0
        for batch in batches:
            for row in zip(longs(batch.column(0)).tolist(), longs(batch.column(1)).tolist(), longs(batch.column(2)).tolist(), as_bytes(batch.column(3)), strict=True):
                held.append((*row[:3], (row[3] or b"").decode()))
                size += len(row[3] or b"")
                if size > PARSE_BYTES and len(held) > 1:
                    yield emit(held)
                    held, size = held[-1:], len(row[3] or b"")
        if len(held) > 1:
            yield emit(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(frugal(run), schema)
