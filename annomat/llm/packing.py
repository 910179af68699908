"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and an end id. It is cut at multiples of ``capacity`` into full windows, and what is
left over into pieces of at most ``piece`` ids, which keeps the differencing fine-grained. Pieces are dealt to groups by their
own hash, so neither a long document nor rows that share an id meet in one group, and all groups run in parallel. In a group the number of windows starts at
the least that can hold its ids; partial partitions are merged with opposing imbalances, largest difference first, until
one is left; while its fullest window exceeds the capacity, one more window is added. Only piece lengths take part, so the
ids themselves never move.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RARE, as_bytes, frugal

#: Ids in a piece of a left-over, and documents in a group on average.
PIECE, GROUP_DOCS = 128, 1024
#: White space on which the fast encoder's pattern, whose time grows with the square of a run, would run out of time and stack.
LONG_RUN = re.compile(r"\s{500}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Groups that pieces which are equal in all columns are spread over.
SALTS = 1024


class ByteTokenizer:
    """Ids of the byte-level vocabulary of a tokenizers file.

    Texts go through the same merges held as ranks; a text that contains the string of an added token, a character that
    Unicode versions may class differently, or a very long run of white space goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [t["content"] for t in spec["added_tokens"]]
        # The byte alphabet of such files: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added) or RARE.search(text) or len(text) > 500 and LONG_RUN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Where a document of ``n`` ids is cut: full windows, then pieces of nearly equal size of at most ``piece``."""
    full, rest = divmod(n, capacity)
    at = [i * capacity for i in range(full + 1)]
    k = -(-rest // piece)
    at += [full * capacity + rest * i // k for i in range(1, k + 1)]
    return at


def pieces(docs: DataFrame, path: str, capacity: int = 1024, piece: int = PIECE, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document: its place, length and checksum. A null text counts as empty.

    The salt counts a task's rows; it spreads rows without an id over groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        n = 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = np.append(encode((text or b"").decode()), np.uint32(end)).astype("<u4")
                raw, at = ids.tobytes(), cuts(len(ids), capacity, piece)
                n += 1
                rows += [(doc, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), len(ids), n % SALTS) for s, e in zip(at, at[1:], strict=False)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"{PIECES}, salt long")


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The window of each size after multiway differencing into ``ways`` windows.

    A partial partition holds the sums of its windows in falling order, less the least, and a chain of items for each.
    """
    n = len(sizes)
    if ways == 1 or not n:
        return np.zeros(n, np.int64)
    follow = np.full(n, -1, np.int64)
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), i, np.array([sizes[i]], np.int64), np.array([i]), np.array([i])))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, head_a, tail_a = heapq.heappop(heap)
        _, _, b, head_b, tail_b = heapq.heappop(heap)
        # Slots beyond those stored are empty, with sum 0; the largest of one side meet the least of the other.
        if len(a) + len(b) <= ways:
            s, head, tail = np.concatenate([a, b]), np.concatenate([head_a, head_b]), np.concatenate([tail_a, tail_b])
        else:
            s, head, tail = np.zeros(ways, np.int64), np.full(ways, -1), np.full(ways, -1)
            s[: len(a)], head[: len(a)], tail[: len(a)] = a, head_a, tail_a
            at = np.arange(ways - 1, ways - 1 - len(b), -1)
            met = (head[at] >= 0) & (head_b >= 0)
            follow[tail[at[met]]] = head_b[met]
            alone = (head[at] < 0) & (head_b >= 0)
            head[at[alone]] = head_b[alone]
            tail[at] = np.where(head_b >= 0, tail_b, tail[at])
            s[at] += b
        order = np.argsort(-s, kind="stable")
        s, head, tail = s[order], head[order], tail[order]
        if len(s) == ways:
            s = s - s[-1]
        made += 1
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == ways else 0)), made, s, head, tail))
    out = np.empty(n, np.int64)
    for slot, i in enumerate(heap[0][3].tolist()):
        while i >= 0:
            out[i] = slot
            i = int(follow[i])
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size so that no window holds more than ``capacity``."""
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        slot = difference(sizes, ways)
        if np.bincount(slot, sizes, ways).max(initial=0) <= capacity:
            return slot
        ways += 1 + ways // 256


def pack(found: DataFrame, groups: int, capacity: int = 1024) -> DataFrame:
    """``found`` with sequence_id and offset. A full piece is a sequence of its own; the others are packed by group.

    A sequence id is the group's number times 2**32 plus the place in the group. Repeated rows are packed as often as they
    occur.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        size = pdf["length"].to_numpy(np.int64)
        full = size == capacity
        seq, offset = np.empty(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        seq[full] = np.arange(full.sum())
        rest = np.flatnonzero(~full)
        if len(rest):
            slot = windows(size[rest], capacity)
            order = np.argsort(slot, kind="stable")
            run_size = size[rest][order]
            before = np.cumsum(run_size) - run_size
            first = np.concatenate([[True], slot[order][1:] != slot[order][:-1]])
            offset[rest[order]] = before - np.maximum.accumulate(np.where(first, before, 0))
            seq[rest] = full.sum() + slot
        return pdf.assign(sequence_id=(pdf["group"].to_numpy(np.int64) << 32) + seq, offset=offset).drop(columns="group")

    salt = F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(0)
    keyed = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", salt), F.lit(groups))).drop("salt")
    return keyed.groupBy("group").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; an empty text is its end id alone."""
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    return pack(pieces(docs, path, capacity, piece, 0, id_col, text_col), groups, capacity)
