"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers, dealt to blocks of a bounded size and turned into bit slices: one bitmap for each dimension
and bit. A query's weights are cut to a few bits; the weighted slices are added with bitmap arithmetic (carry-save full
adders over whole bitmaps), and the sum's slices are walked from the most significant one downward to select the top rows.
What the dropped bits can change is bounded by norms; every row within that bound of the k-th is resolved exactly.

Rows are shuffled once, to their block. The queries, packed, are sent to every block, where they stream past its index: a task
holds one index and one query block. So ``rows / ROWS`` copies of the queries travel, and each meeting returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, longs, partitions, starts_of_runs

#: Rows in a block of the index, at most and where there are too few blocks for all tasks; queries in a query block; bits that a
#: slice index keeps of a component and of a weight.
ROWS, FEW_ROWS, QUERIES, KEEP, WEIGHT = 32_768, 8192, 1024, 6, 4
#: Components beyond this, as integers, count as this; scores are compared as they are and returned within the bounds of a long.
LIMIT = 1 << 56
_ONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two stacks of numbers in slices, least significant first: (bits, ..., words)."""
    bits = max(len(a), len(b)) + 1
    out = np.empty((bits, *a.shape[1:]), np.uint64)
    carry = None
    for i in range(bits - 1):
        x = a[i] if i < len(a) else None
        y = b[i] if i < len(b) else None
        if x is None or y is None:
            x = y if x is None else x
            out[i], carry = (x, None) if carry is None else (x ^ carry, x & carry)
        elif carry is None:
            out[i], carry = x ^ y, x & y
        else:
            half = x ^ y
            out[i], carry = half ^ carry, (x & y) | (half & carry)
    out[bits - 1] = 0 if carry is None else carry
    return out


def _sum(stack: np.ndarray) -> np.ndarray:
    """Sum over the second axis of (bits, numbers, words), pair by pair."""
    while stack.shape[1] > 1:
        n = stack.shape[1] // 2
        both = _add(stack[:, :n], stack[:, n : 2 * n])
        if stack.shape[1] % 2:
            odd = np.zeros((len(both), 1, stack.shape[2]), np.uint64)
            odd[: len(stack)] = stack[:, 2 * n :]
            both = np.concatenate([both, odd], axis=1)
        stack = both
    return stack[:, 0]


class SlicedBlock:
    """Bit slices of a block of integer vectors, in the order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.n, self.most = ids, rows, len(ids), int(np.abs(rows).max(initial=0))
        self.low = rows.min(axis=0)
        width = int((rows.max(axis=0) - self.low).max(initial=0)).bit_length()
        self.drop = max(0, width - KEEP)
        y = (rows - self.low) >> self.drop
        self.bits = max(1, width - self.drop)
        self.top = (1 << self.bits) - 1
        self.step = 1 << self.drop
        words = -(-self.n // 64)
        self.slices = np.zeros((2, self.bits, rows.shape[1], words), np.uint64)
        for b in range(self.bits):
            flags = np.zeros((rows.shape[1], words * 64), np.uint8)
            flags[:, : self.n] = ((y >> b) & 1).T
            self.slices[0, b] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        self.slices[1] = self.slices[0] ^ _ONE
        self.all = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)
        kept = self.low + y * self.step + (self.step - 1) / 2
        self.longest = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max()))
        self.off = float(np.sqrt(((rows - kept) ** 2).sum(axis=1).max()))

    def _score(self, weight: np.ndarray) -> np.ndarray:
        sign = (weight < 0).astype(int)
        size, total = np.abs(weight), None
        for j in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero((size >> j) & 1)
            if len(dims):
                part = _sum(np.ascontiguousarray(self.slices[sign[dims], :, dims].transpose(1, 0, 2)))
                part = np.concatenate([np.zeros((j, part.shape[1]), np.uint64), part]) if j else part
                total = part if total is None else _add(total, part)
        return total if total is not None else np.zeros((1, len(self.all)), np.uint64)

    def top_k(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, best first, ties to the smaller id; rows of id ``own`` take no part.

        Scores that may not fit a long are Python integers.
        """
        shift = max(0, int(np.abs(query).max(initial=0)).bit_length() - WEIGHT)
        most = int(np.abs(query).max(initial=0)) * self.most * len(query)
        weight = np.sign(query) * ((np.abs(query) + (1 << shift >> 1)) >> shift)
        score = self._score(weight)
        live = self.all.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            live[i >> 6] &= ~np.uint64(1 << (i & 63))
        count = lambda x: int(np.bitwise_count(x).sum())
        if count(live) <= k:
            chosen = live
        else:
            sure, tied, least = np.zeros_like(live), live, 0
            for b in range(len(score) - 1, -1, -1):  # the k-th largest sum, bit by bit
                more = tied & score[b]
                if count(sure) + count(more) >= k:
                    tied, least = more, least | (1 << b)
                else:
                    sure, tied = sure | more, tied & ~score[b]
            # In units of the sum: what the query's and the rows' dropped bits can change, twice.
            unit = float(self.step << shift)
            bound = (np.linalg.norm(query - (weight << shift)) * self.longest + np.linalg.norm(weight << shift) * self.off) * (1 + 1e-6)
            floor = max(0, least - int(np.ceil(2 * bound / unit + 1e-6)) - 1)
            above, equal = np.zeros_like(live), live
            for b in range(len(score) - 1, -1, -1):
                if floor >> b & 1:
                    equal = equal & score[b]
                else:
                    above, equal = above | (equal & score[b]), equal & ~score[b]
            chosen = above | equal
        at = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        exact = self.rows[at] @ query if most < 1 << 62 else self.rows[at].astype(object) @ query.astype(object)
        order = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at][order], exact[order]


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part: id and vector not null, all components finite."""
    d = F.transform(F.col("e"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")).where("vec_id is not null and e is not null")
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    bounded = lambda x: F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return rows.select("vec_id", F.transform(d, lambda x: F.floor(bounded(x))).alias("v"))


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """One row for each query block: its number, the vectors' length, ids and components as bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        dims = table["dims"][0].as_py()
        data = _matrix(table["v"].combine_chunks(), dims)
        raw = data.astype("<i4" if np.abs(data).max(initial=0) < 1 << 31 else "<i8").tobytes()
        return pa.table({"q": table["q"][:1], "dims": table["dims"][:1], "q_ids": [longs(table["vec_id"].combine_chunks()).astype("<i8").tobytes()], "q_data": [raw]})

    dealt = queries.withColumn("dims", F.size("v")).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    return dealt.groupBy("q", "dims").applyInArrow(run, "q long, dims int, q_ids binary, q_data binary")


def _meetings(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each block for each query; a block's rows come first, then the query blocks."""
    low = (1 << 62) - 1
    now, ids, vectors, index = None, [], [], None

    def built(dims: int) -> SlicedBlock | None:
        if not ids:
            return None
        at, rows = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(at, kind="stable")
        return SlicedBlock(at[order], rows[order])

    for batch in batches:
        block, dims = longs(batch.column(0)), longs(batch.column(1))
        kind = longs(batch.column(2))
        first = starts_of_runs(block * 2 + kind) if len(np.unique(dims)) < 2 else np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (dims[1:] != dims[:-1]) | (kind[1:] != kind[:-1])]))
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
            if (here := (int(block[s]), int(dims[s]))) != now:
                now, ids, vectors, index = here, [], [], None
            if not kind[s]:
                ids.append(longs(batch.column(3)[s:e]))
                vectors.append(_matrix(batch.column(4)[s:e], now[1]))
                continue
            if index is None:
                index = built(now[1])
                if index is None:
                    continue  # no row of this length here
                ids, vectors = [], []
            for raw_ids, raw in zip(batch.column(5)[s:e].to_pylist(), batch.column(6)[s:e].to_pylist(), strict=True):
                own = np.frombuffer(raw_ids, "<i8")
                asked = np.frombuffer(raw, "<i8" if len(raw) == 8 * len(own) * now[1] else "<i4").reshape(len(own), now[1]).astype(np.int64)
                out = []
                for query_id, query in zip(own.tolist(), asked, strict=True):
                    found, score = index.top_k(query, query_id, k)
                    if score.dtype == object:
                        high, rest = np.array([x >> 62 for x in score], np.int64), np.array([x & low for x in score], np.int64)
                        score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], np.int64)
                    else:
                        high, rest = score >> 62, score & low
                    out.append((np.full(len(found), query_id), found, score, high, rest))
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.record_batch(dict(zip(("query_id", "vec_id", "score", "high", "low"), columns, strict=True)))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best other rows.

    Only vectors of the query's length are compared; empty ones all score 0. The id is a key: rows with the query's id are its
    own, and of repeated query rows the least vector is the query.
    """
    rows = quantised(vectors, id_col, vec_col)
    size, tasks = rows.count(), partitions(vectors.sparkSession)
    n = max(1, -(-size // ROWS), min(tasks, -(-size // FEW_ROWS)))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    packed = _query_blocks(queries, max(1, -(-size // (every * QUERIES))))
    left = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).alias("block"), F.size("v").alias("dims"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q_data"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block")
    right = packed.select(everywhere, "dims", F.lit(1).alias("kind"), F.col("q").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"), "q_ids", "q_data")
    met = left.unionByName(right).repartition(max(tasks, 2 * n), "block", "dims").sortWithinPartitions("block", "dims", "kind")
    best = met.mapInArrow(frugal(lambda batches: _meetings(batches, k)), "query_id long, vec_id long, score long, high long, low long")
    w = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
