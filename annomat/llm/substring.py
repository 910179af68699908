"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Each window has a minimiser, the least hash among its ``mini``-word
grams; consecutive windows with the same minimiser travel together as one string, a super-k-mer, to the bucket of that
minimiser, so equal windows always meet and the text is sent about three times instead of ``window`` times. Inside a bucket
the windows are sorted and equal ones compared word for word.

The number of buckets follows the bytes of text, so a bucket stays as large as it is when the table grows.

Skew: of equal super-k-mers in one block only the earliest travels, and of those that a task meets again in later blocks only
earlier ones; the others are repeats whatever other tasks hold. Minimisers that hold a large share of all super-k-mers are
found first, by partial counts that keep every share above the limit (at most ``2 * buckets`` of them, and never more than
``2 * HEAVY``, so the list is bounded); their windows are dealt again, by the minimiser of grams of three fifths of a window.

A document is known by its id and a tie: 0 for an id that is there once, else a hash of the text. So rows that share an id, or
have none, are documents of their own that follow each other by that hash, null ids after all others. Rows equal in id and
text are one document given more than once: all of them lose the same words, and none loses words to another.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, checkpoint, frugal, longs, partitions, small, text_bytes

#: Buckets for each shuffle partition; UTF-8 bytes of text that one map block covers, and for which there is a bucket at least;
#: level of compression on the way.
BUCKETS_EACH, MAP_BYTES, BUCKET_BYTES, LEVEL = 8, 4 << 20, 4 << 20, 5
#: Heavy minimisers are at least one in so many; bytes of super-k-mers that a task remembers; repeated ids that are copied to
#: every executor at most.
HEAVY, KNOWN_BYTES, LOCAL_IDS = 1 << 16, 16 << 20, 1_000_000
#: What a null id is held as.
LAST = (1 << 63) - 1
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class _Windows:
    """Windows of a block of documents with their minimisers."""

    def __init__(self, ids: np.ndarray, texts: list[bytes | None], window: int, ties: np.ndarray | None = None):
        words, doc, start = [], [], []
        for k, text in enumerate(texts):
            own = (text or b"").split()
            if len(own) >= window:
                words += own
                doc.append(np.full(len(own), k, np.int32))
                start.append(np.arange(len(own), dtype=np.int64))
        self.n = len(words)
        if not self.n:
            return
        self.text = b" ".join(words)
        self.doc, self.start = np.concatenate(doc), np.concatenate(start)
        self.ids = ids[self.doc]
        self.ties = ties[self.doc] if ties is not None else np.zeros(self.n, np.int64)
        size = np.fromiter(map(len, words), np.int64, self.n)
        self.ends = np.cumsum(size + 1) - 1
        self.begins = self.ends - size
        h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
        at = self.n - window + 1
        self.valid = self.doc[:at] == self.doc[window - 1 :]
        self.window, self.hash = window, h

    def minimisers(self, mini: int) -> np.ndarray:
        """The least hash of ``mini``-word grams of each window."""
        low = np.zeros(self.n - mini + 1, _U)
        for j in range(mini):
            low = low * _U(0x9E3779B97F4A7C15) + self.hash[j : j + len(low)]
        low, span, reach = _mix(low), 1, self.window - mini + 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = reach - span
        return np.minimum(low[:-rest], low[rest:]) if rest else low

    def keys(self, mini: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each window is dealt by, its minimiser or that of longer grams where the first is heavy; and where it is."""
        key = self.minimisers(mini)
        common = np.isin(key, heavy)
        if common.any():
            key = np.where(common, self.minimisers(max(mini, self.window * 3 // 5)) ^ _U(0xC2B2AE3D27D4EB4F), key)
        return key, common

    def runs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each super-k-mer."""
        cut = np.ones(len(key), bool)
        cut[1:] = (key[1:] != key[:-1]) | (self.doc[1 : len(key)] != self.doc[: len(key) - 1]) | (self.valid[1:] != self.valid[:-1])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(key)))
        return first[self.valid[first]], size[self.valid[first]]


def _pack(kept: list[np.ndarray], gone: list[np.ndarray], text: bytes) -> bytes:
    """Super-k-mers (document, tie, start) with their words, one a line, and repeats (document, tie, start, words)."""
    columns = [np.diff(p, prepend=0) if k in (0, len(kept)) else p for k, p in enumerate([*kept, *gone])]  # documents rise, so steps are small
    raw = b"".join([struct.pack("<3q", len(kept[0]), len(gone[0]), len(text)), *(p.astype("<i8").tobytes() for p in columns), text])
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, size = struct.unpack_from("<3q", raw)
    at, parts = 24, []
    for k in (n, n, n, m, m, m, m):
        parts.append(np.frombuffer(raw, "<i8", k, at))
        at += 8 * k
    return [np.cumsum(p) if k in (0, 3) else p for k, p in enumerate(parts)], raw[at : at + size]


def _repeats(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, text: bytes, window: int) -> list[np.ndarray]:
    """Of a bucket's super-k-mers, one a line: (doc, tie, start, words) of the stretches covered by windows that start earlier elsewhere."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    line_end = raw[gap] == 10
    begins, ends = np.concatenate([[0], gap[:-1] + 1]), gap
    line = np.concatenate([[0], np.cumsum(line_end)[:-1]])
    n = len(ends) - window + 1
    ok = np.flatnonzero(line[:n] == line[window - 1 :])
    # Hash of each window's bytes from running sums; equal bytes have equal hashes, the reverse is checked below.
    table = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    base = _U(0x9E3779B97F4A7C15 | 1)
    word = _words(raw, begins, ends, table, base)
    h = np.zeros(n, _U)
    for j in range(window):
        h = h * _U(0xC2B2AE3D27D4EB4F) + word[j : j + n]
    h = h[ok]
    first_word = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    at = line[ok]
    place = start[at] + (ok - first_word[at])
    order = np.lexsort((place, tie[at], doc[at], h) if tie.any() else (place, doc[at], h))
    h = h[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    if not same.any():
        return [np.empty(0, np.int64)] * 4
    lead = np.flatnonzero(~same)
    lead = lead[np.cumsum(~same) - 1]
    s, e = begins[ok][order], ends[ok + window - 1][order]
    key_doc, key_tie, key_place = doc[at][order], tie[at][order], place[order]
    later = np.zeros(len(h), bool)
    last, mixed = -1, set()
    for k in np.flatnonzero(same).tolist():
        f = int(lead[k])
        if f != last:
            last, want = f, text[s[f] : e[f]]
        if text[s[k] : e[k]] != want:
            mixed.add(f)
    later[same] = (key_doc[same] != key_doc[lead[same]]) | (key_tie[same] != key_tie[lead[same]]) | (key_place[same] != key_place[lead[same]])
    for f in mixed:  # different windows with one hash: by their words
        own = np.flatnonzero(lead == f)
        seen: dict[bytes, int] = {}
        for k in own.tolist():
            j = seen.setdefault(text[s[k] : e[k]], k)
            later[k] = (key_doc[k], key_tie[k], key_place[k]) != (key_doc[j], key_tie[j], key_place[j])
    hit = np.sort(order[later])  # windows in the order of the text
    line_hit, place_hit = at[hit], place[hit]
    cut = np.flatnonzero(np.concatenate([[True], (line_hit[1:] != line_hit[:-1]) | (place_hit[1:] != place_hit[:-1] + 1)])) if len(hit) else np.empty(0, np.int64)
    size = np.diff(np.append(cut, len(hit)))
    return [doc[line_hit[cut]], tie[line_hit[cut]], place_hit[cut], size + window - 1]


def _words(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, table: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of each word: the sum of its bytes' values, each times a power of ``base`` by its place in the word."""
    width = ends - begins
    longest = int(width.max()) if len(width) else 0
    if longest <= 64:
        out = width.astype(_U)
        at = begins.copy()
        left = np.arange(len(width))
        for j in range(longest):
            left = left[width[left] > j]
            out[left] = out[left] * base + table[raw[at[left] + j]]
        return out
    text = raw.tobytes()
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(text[s:e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]), "<u8")


def heavy_minimisers(docs: DataFrame, window: int, mini: int, buckets: int) -> np.ndarray:
    """Minimisers that may hold more than ``1 / buckets`` of all super-k-mers: at most ``2 * buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mins, total = [], 0
        for part, texts in blocks(batches, "text"):
            w = _Windows(longs(part.column(0)), texts, window)
            if w.n:
                low = w.minimisers(mini)
                first, _ = w.runs(low)
                mins.append(low[first])
                total += len(first)
            if sum(map(len, mins)) > 1_000_000:
                yield from share(mins, total)
                mins, total = [], 0
        yield from share(mins, total)

    def share(mins: list[np.ndarray], total: int) -> Iterator[pa.RecordBatch]:
        if total:
            key, n = np.unique(np.concatenate(mins), return_counts=True)
            much = n >= max(2, total / (2 * buckets))
            keys, counts = np.append(key[much].view(np.int64), 0), np.append(n[much], total).astype(np.int64)
            yield pa.record_batch({"key": keys, "n": counts, "total": np.append(np.zeros(much.sum(), bool), True)})

    found = checkpoint(docs.select("id", "text").mapInArrow(frugal(run), "key long, n long, total boolean").groupBy("key", "total").agg(F.sum("n").alias("n")))
    whole = found.where("total").agg(F.sum("n")).first()[0] or 0
    rows = found.where(~F.col("total") & (F.col("n") >= whole / (2 * buckets))).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(_U))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, ...) with the document's key in _id and _tie."""
    marked = rows.withColumn("_id", F.coalesce("id", F.lit(LAST)))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1).bitwiseOR(F.lit(1).cast("long"))
    repeated = checkpoint(rows.select("id").where("id is not null").groupBy("id").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("id").alias("_id"), F.lit(True).alias("_again")))
    local = small(repeated, LOCAL_IDS)
    if local is not None and not local.take(1):
        return marked.withColumn("_tie", F.when(F.col("id").isNull(), tie).otherwise(0).cast("long"))
    again = marked.join(repeated if local is None else local, "_id", "left")
    return again.withColumn("_tie", F.when(F.col("id").isNull() | F.col("_again"), tie).otherwise(0).cast("long")).drop("_again")


def repeated_stretches(docs: DataFrame, window: int = 20, mini: int = 5) -> DataFrame:
    """(_id, _tie, start, words) of stretches, in words, covered by windows whose words also start earlier; ``docs`` has (_id, _tie, text)."""
    n = partitions(docs.sparkSession)
    buckets = max(n * BUCKETS_EACH, -(-text_bytes(docs) // BUCKET_BYTES))
    tasks = max(n, -(-buckets // BUCKETS_EACH))
    heavy = heavy_minimisers(docs.select(F.col("_id").alias("id"), "text"), window, mini, min(buckets, HEAVY))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, int]] = {}  # where a super-k-mer met more than once was sent from
        known_bytes = 0
        for part, texts in blocks(batches, "text", MAP_BYTES):
            w = _Windows(longs(part.column(0)), texts, window, longs(part.column(1)))
            if not w.n:
                continue
            if known_bytes > KNOWN_BYTES:
                known.clear()
                known_bytes = 0
            key, common = w.keys(mini, heavy)
            first, size = w.runs(key)
            if not len(first):
                continue
            bucket = (_mix(key[first]) % _U(buckets)).astype(np.int64)
            doc, tie, start, often = w.ids[first], w.ties[first], w.start[first], common[first].tolist()
            order = np.lexsort((start, tie, doc, bucket))
            s, e = w.begins[first], w.ends[first + size + window - 2]
            text, bounds = w.text, np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
            out_bucket, out = [], []
            for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)], strict=True):
                own = order[i:j]
                seen: dict[bytes, int] = {}
                keep, lines, gone = [], [], []
                for k in own.tolist():
                    line = text[s[k] : e[k]]
                    f = seen.setdefault(line, k)
                    if f != k and (doc[f], tie[f], start[f]) == (doc[k], tie[k], start[k]):
                        continue
                    if f == k:
                        before, here = known.get(line), (int(doc[k]), int(tie[k]), int(start[k]))
                        if before == here:
                            continue
                        if before is None or here < before:
                            keep.append(k)
                            lines.append(line)
                            if before is not None or often[k]:
                                known[line] = here
                                known_bytes += len(line) + 100
                            continue
                    elif line not in known:
                        known[line] = (int(doc[f]), int(tie[f]), int(start[f]))
                        known_bytes += len(line) + 100
                    gone.append(k)
                lines.append(b"")
                out_bucket.append(int(bucket[own[0]]))
                out.append(_pack([x[keep] for x in (doc, tie, start)], [*(x[gone] for x in (doc, tie, start)), size[gone] + window - 1], b"\n".join(lines)))
            yield pa.record_batch({"bucket": pa.array(out_bucket, pa.int64()), "packed": pa.array(out, pa.binary())})

    def join(held: list[bytes]) -> pa.RecordBatch | None:
        parts = [_unpack(b) for b in held]
        doc, tie, start = (np.concatenate([p[0][i] for p in parts]) for i in (0, 1, 2))
        gone = [np.concatenate([p[0][i] for p in parts]) for i in (3, 4, 5, 6)]
        more = _repeats(doc, tie, start, b"".join(p[1] for p in parts), window) if len(doc) else []
        ids, ties, at, words = (np.concatenate(p) for p in zip(gone, more, strict=True)) if more else gone
        return pa.record_batch({"_id": ids, "_tie": ties, "start": at, "words": words}) if len(ids) else None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for bucket, blob in chain.from_iterable(zip(longs(b.column(0)).tolist(), b.column(1).to_pylist(), strict=True) for b in batches):
            if bucket != now and held:
                if (out := join(held)) is not None:
                    yield out
                held = []
            now = bucket
            held.append(blob)
        if held and (out := join(held)) is not None:
            yield out

    sent = docs.select("_id", "_tie", "text").mapInArrow(frugal(cut), "bucket long, packed binary")
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(meet), "_id long, _tie long, start long, words long")


def removed_mask(n: int, stretches: np.ndarray) -> np.ndarray:
    """Which of ``n`` words the packed (start << 32 | words) stretches cover."""
    edge = np.zeros(n + 1, np.int64)
    start, size = stretches >> 32, stretches & 0xFFFFFFFF
    start = np.minimum(start, n)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + size, n), -1)
    return np.cumsum(edge)[:n] > 0


def _with_stretches(rows: DataFrame, window: int, mini: int) -> DataFrame:
    """``rows`` (id, text, ...) with the stretches that go, in ``_cut``."""
    marked = keyed(rows)
    found = repeated_stretches(marked, window, mini)
    lists = found.groupBy("_id", "_tie").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("words"))).alias("_cut"))
    return marked.join(lists, ["_id", "_tie"], "left").drop("_id", "_tie")


def _kept(text: bytes | None, cut: list[int] | None) -> tuple[list[bytes], int]:
    words = (text or b"").split()
    if not cut:
        return words, 0
    gone = removed_mask(len(words), np.array(cut, np.int64))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def remove_repeats(docs: DataFrame, window: int = 20, mini: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    A null text has no words; texts under ``window`` words lose none. Of rows that share an id, or have none, see above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest = [], [], []
            for text, cut in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
                kept, k = _kept(text, cut.as_py())
                n.append(len(kept) + k)
                gone.append(k)
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(0).cast(pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    rows = _with_stretches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), window, mini)
    return rows.mapInArrow(frugal(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = 20, mini: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut from the text; untouched texts stay as they are, others are joined by one space.

    A text that loses all its words becomes empty; the row stays. A column n_chars follows the text where it changes.
    """
    schema = docs.schema
    at = schema.names.index(text_col)
    chars = schema.names.index("n_chars") if "n_chars" in schema.names and schema["n_chars"].dataType.typeName() in ("long", "integer") else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            cuts = batch.column(1).to_pylist()
            texts = [text if not cut else b" ".join(_kept(text, cut)[0]) for text, cut in zip(as_bytes(columns[at]), cuts, strict=True)]
            if chars >= 0:
                now = columns[chars].to_pylist()
                columns[chars] = pa.array([n if not cut else len(t.decode()) for n, cut, t in zip(now, cuts, texts, strict=True)], columns[chars].type)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _with_stretches(rows, window, mini).select("row", "_cut").mapInArrow(frugal(run), schema)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)
),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
