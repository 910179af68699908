"""Near-duplicate detection with SimHash and a byte-position inverted index.

A fingerprint is cut into positional bytes. Two fingerprints that differ in at most ``max_bits`` bits share at least
``n_bytes - max_bits`` of them, so the index is kept on small sets of positions chosen so that every pair with the
guaranteed number of matches meets in at least one of them (for 8 bytes and 3 bits: five matches, hence three within one
half). With more fingerprints the sets are larger, and so are the keys, so postings stay short. Postings hold distinct
fingerprints only. Inside a posting the shared positional bytes of each pair are tallied, pairs below the guaranteed count are
dropped, and the rest are verified by Hamming distance. Members that are known to be linked are not compared with each other
again, so a group of alike ones costs a posting little more than its size, and what leaves a posting is a star for each of its
components, so the output is linear. Postings over ``TILE`` members are cut into pairs of blocks of fixed size.

Where shingles decide (``near_duplicate_groups``), such links are only candidates. Their components are found by a few position
sets first; the other sets then only look for links between those. Inside a component of candidates texts are compared by their
sets of shingles, each one with all others unless both are known to be alike to the same text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, frugal, longs, partitions, picked, small, starts_of_runs

#: Members of a posting, or of a block of a large one, that are compared with each other in one go.
TILE = 1024
#: Fingerprints up to which keys have three bytes.
FEW_PRINTS = 1 << 28
#: Edges (16 bytes each) whose components one task finds; links that a task gathers before it joins what they link.
LOCAL_EDGES, PAIRS = 500_000, 200_000
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_MIX = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Digests of a text's word shingles in order; a shorter text is one shingle, a wordless one none."""
    digest, words = xxhash.xxh64_digest, (text or b"").lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    if n < 2:
        return [digest(b" ".join(words), 42)] * n
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[s:e], 42) for s, e in zip(begin[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[bytes | None], width: int, bits: int, distinct: bool = False) -> list[bytes]:
    """SimHash of each text over its word shingles (each counted once if ``distinct``), big-endian; zero where there is no word."""
    digests, counts = [], []
    for text in texts:
        own = shingles(text, width)
        if distinct:
            own = dict.fromkeys(own)
        counts.append(len(own))
        digests.extend(own)
    n = np.array(counts, np.int64)
    out = np.zeros((len(texts), bits), np.int64)
    if digests:
        raw = np.frombuffer(b"".join(digests), ">u8")
        full = np.flatnonzero(n)
        first = np.concatenate([[0], np.cumsum(n[full])])
        # Lanes of eight counters add up in bytes; 255 rows at most fit in one.
        cut = np.unique(np.concatenate([np.arange(0, first[-1], 255), first[:-1]]))
        owner = np.searchsorted(cut, first[:-1])
        for lane in range(bits // 64):
            h = raw if bits == 64 else _mixed(raw.astype(np.uint64) + np.uint64(_MIX * (lane + 1) % 2**64)).astype(">u8")
            ones = np.unpackbits(h.view(np.uint8)).view(np.uint64).reshape(-1, 8)
            sums = np.add.reduceat(ones, cut, axis=0).view(np.uint8).astype(np.int64)
            out[full, lane * 64 : lane * 64 + 64] = np.add.reduceat(sums, owner, axis=0)
    return [row.tobytes() for row in np.packbits(out * 2 > n[:, None], axis=1)]


def fingerprints(docs: DataFrame, width: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary) of every row; a null text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            yield pa.record_batch({"id": part.column(0).cast(pa.int64()), "fp": pa.array(fingerprints_of(texts, width, bits), pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), "id long, fp binary")


def half_triples() -> list[tuple[int, ...]]:
    """Position sets for 8 bytes and at most 3 differing bits: of five matching bytes, three lie in one half."""
    return [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def covering(n_bytes: int, matches: int, size: int) -> list[tuple[int, ...]]:
    """Position sets of ``size`` bytes, one of which at least lies in every set of ``matches`` bytes; found greedily."""
    need, out = set(combinations(range(n_bytes), matches)), []
    inside = {t: {m for m in need if set(t) <= set(m)} for t in combinations(range(n_bytes), size)}
    while need:
        best = max(inside, key=lambda t: (len(inside[t] & need), t))
        out.append(best)
        need -= inside[best]
    return out


def index_positions(fingerprints: int) -> list[tuple[int, ...]]:
    """Position sets for 8 bytes and at most 3 differing bits, with keys long enough for so many distinct fingerprints.

    Up to 2**28 of them a key of three bytes has 16 on average; beyond, keys of four bytes are good for 2**36.
    """
    return half_triples() if fingerprints <= FEW_PRINTS else covering(8, 5, 4)


def spread_triples(n_bits: int, rounds: int, seed: int = 7) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """An order of bits that lays out a fingerprint ``rounds`` times, and triples of bytes of that; those of a round share no bit."""
    rng, size = np.random.default_rng(seed), n_bits // 8
    order = np.concatenate([rng.permutation(n_bits) for _ in range(rounds)])
    return order, [(k, k + 1, k + 2) for r in range(rounds) for k in range(r * size, (r + 1) * size - 2, 3)]


def _shared(x: np.ndarray) -> np.ndarray:
    """The tally: how many positional bytes are zero in each row of differences, held as longs."""
    differ = ((x & _LOW) + _LOW | x) & _HIGH
    return 8 * x.shape[1] - np.bitwise_count(differ).sum(axis=1)


def merged_by(compare: Callable[[int], np.ndarray], group: np.ndarray) -> np.ndarray:
    """Components of ``len(group)`` members, as numbers: members of equal group are linked, and ``compare(i)`` gives those linked with i.

    Members of the largest component are not compared once they are in it: links among them add nothing, and any other member
    is compared with all.
    """
    _, part = np.unique(group, return_inverse=True)
    done = np.zeros(len(part), bool)
    main = int(np.bincount(part).argmax())
    while True:
        todo = np.flatnonzero((part != main) & ~done)
        if not len(todo):
            return part
        i = int(todo[0])
        done[i] = True
        met = np.unique(np.append(part[compare(i)], part[i]))
        if len(met) > 1:
            into = main if main in met else int(met[0])
            part[np.isin(part, met)] = into
            if into != main and (part == into).sum() > (part == main).sum():
                main = into


def _linked(fp: np.ndarray, label: np.ndarray, max_bits: int, least: int) -> list[tuple[int, int]]:
    """Edges between labels that make the same components as all verified links between members do: a star for each component."""
    if (label == label[0]).all():
        return []
    lanes = fp.view(np.uint64)

    def compare(i: int) -> np.ndarray:
        x = lanes ^ lanes[i]
        if not least:
            return np.flatnonzero(np.bitwise_count(x).sum(axis=1) <= max_bits)
        enough = np.flatnonzero(_shared(x) >= least)  # pairs short of the guaranteed matches go before they are verified
        return enough[np.bitwise_count(x[enough]).sum(axis=1) <= max_bits]

    part = merged_by(compare, label)
    order = np.lexsort((label, part))
    first = starts_of_runs(part[order])
    lead = np.repeat(label[order][first], np.diff(np.append(first, len(order))))
    return [*{(a, b) for a, b in zip(lead.tolist(), label[order].tolist(), strict=True) if a != b}]


def links(prints: DataFrame, positions: list[tuple[int, ...]], max_bits: int, least: int, order: np.ndarray | None = None) -> DataFrame:
    """Edges (a, b) between ids of distinct fingerprints ``(id, fp)`` that make the same components as all links do.

    With a column label, members of equal label are taken as linked and edges are between labels. With ``order``, the positions
    are those of the fingerprint's bits in that order.
    """
    if "label" not in prints.columns:
        prints = prints.withColumn("label", F.col("id"))
    prints = prints.select("id", "label", "fp")
    bare = prints.select("id", "fp")
    spark = prints.sparkSession
    sets = np.array(positions)
    n = partitions(spark)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 200_000 // len(sets))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                if order is not None:
                    fp = np.packbits(np.unpackbits(fp, axis=1)[:, order], axis=1)
                key = np.zeros((part.num_rows, len(sets)), np.int64)
                for k in range(sets.shape[1]):
                    key = (key << 8) | fp[:, sets[:, k]]
                key |= np.arange(len(sets)) << (8 * sets.shape[1])
                yield pa.record_batch({"key": key.ravel(), "id": np.repeat(longs(part.column(0)), len(sets))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings dealt to ranges of keys, as byte planes that the shuffle compresses well."""
        for batch in post(batches):
            key, ids = longs(batch.column(0)), longs(batch.column(1))
            bucket = key * (4 * n) // (len(sets) << (8 * sets.shape[1]))
            by = np.argsort(bucket, kind="stable")
            rows, bucket = np.stack([key[by], ids[by]], axis=1), bucket[by]
            first = starts_of_runs(bucket)
            blobs = [np.ascontiguousarray(x.view(np.uint8).T).tobytes() for x in np.split(rows, first[1:])]
            yield pa.record_batch({"bucket": bucket[first], "blob": pa.array(blobs, pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted postings of one range of keys after the other."""
        held, now = [], None

        def emit() -> pa.RecordBatch:
            rows = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(16, -1).T).view(np.int64) for x in held])
            by = np.argsort(rows[:, 0])
            return pa.record_batch({"key": rows[by, 0], "id": rows[by, 1]})

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and bucket != now:
                    yield emit()
                    held = []
                held.append(blob)
                now = bucket
        if held:
            yield emit()

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings with two members or more; a large one as pairs of blocks."""
        held_key, held = None, []  # the last key's members so far

        def emit(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = starts_of_runs(keys)
            size = np.diff(np.concatenate([first, [len(keys)]]))
            each = np.repeat(size, size)
            small = (each > 1) & (each <= TILE)
            if small.any():
                yield pa.record_batch({"key": keys[small], "tile": np.zeros(small.sum(), np.int64), "id": ids[small]})
            for k in np.flatnonzero(size > TILE):
                own = ids[first[k] : first[k] + size[k]]
                cut = [own[i : i + TILE] for i in range(0, len(own), TILE)]
                for i, x in enumerate(cut):
                    for j in range(i + 1):
                        y = cut[j]
                        n = len(x) + (len(y) if j < i else 0)
                        both = np.concatenate([x, y]) if j < i else x
                        yield pa.record_batch({"key": np.full(n, keys[first[k]]), "tile": np.full(n, (i << 32) | j, np.int64), "id": both})

        for batch in batches:
            keys, ids = longs(batch.column(0)), longs(batch.column(1))
            if not len(keys):
                continue
            more = int(np.searchsorted(keys, held_key, "right")) if held else 0  # members of the run that was left open
            if more:
                held.append(ids[:more])
            if more == len(keys):
                continue
            if held:
                own = np.concatenate(held)
                yield from emit(np.full(len(own), held_key), own)
            last = int(np.searchsorted(keys, keys[-1]))
            if last > more:
                yield from emit(keys[more:last], ids[more:last])
            held_key, held = int(keys[-1]), [ids[last:]]
        if held:
            own = np.concatenate(held)
            yield from emit(np.full(len(own), held_key), own)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            new = pa.Table.from_batches([batch]) if batch is not None else None
            rows = new if rest is None else rest if new is None else pa.concat_tables([rest, new])
            if rows is None or not rows.num_rows:
                continue
            key, tile = longs(rows.column("key").combine_chunks()), longs(rows.column("tile").combine_chunks())
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
            done = len(key) if batch is None else int(first[-1])
            rest = rows.slice(done) if done < len(key) else None
            if not done:
                continue
            label = longs(rows.column("label").combine_chunks())
            fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint8).reshape(len(key), -1)
            ends = np.append(first[1:], len(key))
            keep = ends <= done
            first, ends = first[keep], ends[keep]
            two = first[(ends - first == 2)]
            two = two[label[two] != label[two + 1]]
            x = fp.view(np.uint64)[two] ^ fp.view(np.uint64)[two + 1]
            enough = _shared(x) >= least
            two, x = two[enough], x[enough]
            two = two[np.bitwise_count(x).sum(axis=1) <= max_bits]
            a, b = label[two], label[two + 1]
            more = [e for s, t in zip(first.tolist(), ends.tolist(), strict=True) if t - s > 2 for e in _linked(fp[s:t], label[s:t], max_bits, least)]
            own = np.array(more, np.int64).reshape(-1, 2)
            a, b = np.append(a, own[:, 0]), np.append(b, own[:, 1])
            edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.record_batch({"a": edges[:, 0], "b": edges[:, 1]})

    if order is None:
        posted = bare.mapInArrow(frugal(post), "key long, id long").repartition(n, "key").sortWithinPartitions("key")
        tiled = posted.mapInArrow(frugal(tiles), "key long, tile long, id long")
    else:
        posted = bare.mapInArrow(frugal(pack), "bucket long, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
        tiled = posted.mapInArrow(frugal(lambda batches: tiles(unpack(batches))), "key long, tile long, id long")
    full = tiled.join(prints, "id").repartition(n, "key", "tile").sortWithinPartitions("key", "tile")
    return full.select("key", "tile", "label", "fp").mapInArrow(frugal(verify), "a long, b long").where("a <> b").distinct()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each can reach."""
    node, end = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, low = end[: len(a)], end[len(a) :], np.arange(len(node))
    while True:
        least = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, before[a], least)  # the roots of both ends take the lower one
        np.minimum.at(low, before[b], least)
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, before):
            return node, node[low]


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge (a, b).

    Up to ``local`` edges are one task's. Beyond, alternating large-star and small-star steps; each round's edges are
    checkpointed and the rounds end when a count and checksum no longer change. Only those two numbers reach the driver.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if now.count() <= local:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(longs(batch.column(0)), longs(batch.column(1))) for batch in batches]
            if held:
                node, low = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.record_batch({"node": node, "component": low})

        return now.coalesce(1).mapInArrow(frugal(run), "node long, component long")
    now, seen = now.distinct(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == seen:
            break
        seen = (mark["n"], mark["s"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def grouped(prints: DataFrame, positions: list[tuple[int, ...]] | None, max_bits: int, least: int) -> DataFrame:
    """(id, fp, component_id) for every row of ``prints``; equal fingerprints are always linked.

    Without positions, fingerprints are of 8 bytes and the positions are those for their number.

    A null id keeps its fingerprint and takes its component from the other rows; it is null if there is none.
    """
    prints = checkpoint(prints)
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null").select("id", "fp"))
    found = components(links(distinct, positions or index_positions(distinct.count()), max_bits, least))
    owner = distinct.join(found, distinct.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(owner, "fp", "left").select("id", "fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit fingerprints, linked at 3 or fewer differing bits.

    Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows are returned as often
    as they occur.
    """
    out = grouped(fingerprints(docs, width, 64, id_col, text_col), None, 3, 5)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: At a similarity s of shingles, two fingerprints differ in a share of arccos(2s / (1 + s)) / pi of their bits on average:
#: 0.152 at 0.8, which is 78 of 512 bits with a deviation of 8. Pairs that agree in a table and differ in ``WIDE_MAX`` bits or
#: less (five deviations more; a similarity of 0.59 on average) are candidates, and their shingles decide. ``WIDE_ROUNDS`` of
#: 21 tables each find 0.99 of the pairs at 0.8.
WIDE_BITS, WIDE_ROUNDS, WIDE_MAX = 512, 20, 120
#: Large components up to which a row for each is copied to every executor.
LOCAL_COMPONENTS = 10_000
#: Texts, and bytes of text, of a component that a task holds.
BLOCK_TEXTS, BLOCK_SIZE = 512, 8 << 20


class Sets:
    """The sets of shingles of some texts, and how large a part of them other sets share."""

    def __init__(self, texts: list[bytes | None], width: int):
        own = [np.unique(np.frombuffer(b"".join(shingles(t, width)), np.uint64)) for t in texts]
        self.size = np.array([len(x) for x in own], np.int64)
        self.known, self.place = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_inverse=True)
        self.end = np.cumsum(self.size)
        holder = np.repeat(np.arange(len(own)), self.size)
        self.holders = holder[np.argsort(self.place, kind="stable")]
        self.many = np.bincount(self.place, minlength=len(self.known))
        self.start = np.cumsum(self.many) - self.many

    def alike(self, place: np.ndarray, size: int, least: float) -> np.ndarray:
        """Texts whose similarity with a set of ``size`` shingles, of which those at ``place`` are known here, is at least ``least``."""
        n = self.many[place]
        at = np.repeat(self.start[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.holders[at], minlength=len(self.size))
        return np.flatnonzero((both >= least * (self.size + size - both)) & (both > 0)) if size else np.flatnonzero(self.size == 0)

    def places(self, i: int) -> np.ndarray:
        return self.place[self.end[i] - self.size[i] : self.end[i]]

    def central(self) -> int:
        """The text with the largest average support of its shingles by all texts."""
        return int(np.argmax(np.add.reduceat(np.append(self.many[self.place], 0), np.minimum(self.end - self.size, len(self.place))) * (self.size > 0) / np.maximum(1, self.size)))

    def asked(self, text: bytes | None, width: int) -> tuple[np.ndarray, int]:
        own = np.unique(np.frombuffer(b"".join(shingles(text, width)), np.uint64))
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        return (at[self.known[at] == own] if len(self.known) else np.empty(0, np.int64)), len(own)


def alike(texts: list[bytes | None], width: int, least: float) -> list[tuple[int, int]]:
    """Links (i, j) that make the same components as all pairs of texts whose sets of shingles have the similarity ``least``."""
    sets = Sets(texts, width)
    centre, part = sets.central(), np.arange(len(texts))
    part[sets.alike(sets.places(centre), int(sets.size[centre]), least)] = centre
    part = merged_by(lambda i: sets.alike(sets.places(i), int(sets.size[i]), least), part)
    order = np.argsort(part, kind="stable")
    first = starts_of_runs(part[order])
    lead = np.repeat(order[first], np.diff(np.append(first, len(order))))
    return [(i, j) for i, j in zip(lead.tolist(), order.tolist(), strict=True) if i != j]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], Iterator[tuple[int, bytes | None, int]]]]:
    """Runs of equal (component, part) with their rows (id, text, role); columns component, part, role, id, text."""
    rows = ((key, (doc, text, role)) for part, own in blocks(batches, "text") for key, role, doc, text in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), part.column(2).to_pylist(), part.column(3).to_pylist(), own, strict=True))
    for key, run in groupby(rows, lambda r: r[0]):
        yield key, (r for _, r in run)


def alike_in_blocks(members: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (a, b) between the nodes of ``members`` (node, component, fp) whose texts in ``docs`` (doc_id, text) are alike.

    The edges make the same components as all pairs of alike texts of a component do. A component of few texts is one task's.
    The texts of a large one are dealt to parts. All are compared with a central text, the one whose fingerprint is nearest to
    the majority of all; those alike to it are linked through it, and the others are compared with every text of every part.
    So a group of copies is sent twice, whatever its size; only texts that are not alike to the centre are sent to all parts.
    """
    spark = members.sparkSession
    n = partitions(spark)
    texts = picked(docs, members.select(F.col("node").alias("doc_id"))).distinct()
    rows = checkpoint(texts.join(members.select(F.col("node").alias("doc_id"), "component"), "doc_id"))
    sizes = checkpoint(rows.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_SIZE), F.lit(1)).cast("int").alias("parts")).where("parts > 1"))
    dealt = rows.join(sizes if (few := small(sizes, LOCAL_COMPONENTS)) is None else few, "component", "left")
    one = dealt.where("parts is null").select("component", F.lit(0).alias("part"), F.lit(0).alias("role"), F.col("doc_id").alias("id"), "text")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in _groups(batches):
            ids, own, _ = zip(*run, strict=True)
            if len(ids) > 1:
                found = alike(list(own), width, least)
                yield pa.record_batch({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition(n, "component", "part").sortWithinPartitions("component", "part", "role")

    edges = gathered(one).mapInArrow(frugal(within), "a long, b long")
    if not sizes.take(1):
        return edges.where("a <> b").distinct()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of role 1 against those of role 0 of their part: stars of what they join, and (a, a) for a text of role 0 that none is alike to."""

        def star(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            node, low = joined(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
            return low[low != node], node[low != node]

        for _, run in _groups(batches):
            ids, own, first = [], [], None
            for doc, text, role in run:
                if role:
                    first = (doc, text)
                    break
                ids.append(doc)
                own.append(text)
            if first is None or not ids:
                continue
            sets, held, met = Sets(own, width), np.array(ids), np.zeros(len(ids), bool)
            pairs, size, most = [], 0, PAIRS
            for doc, text, _ in chain([(*first, 1)], run):
                near = sets.alike(*sets.asked(text, width), least)
                met[near] = True
                pairs.append((held[near], np.full(len(near), doc)))
                size += len(near)
                if size > most:
                    pairs = [star(pairs)]
                    size = len(pairs[0][0])
                    most = max(PAIRS, 2 * size)
            a, b = star(pairs)
            yield pa.record_batch({"a": np.append(a, held[~met]), "b": np.append(b, held[~met])})

    many = checkpoint(dealt.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.col("parts")).cast("int")).select("component", "part", "parts", F.lit(0).alias("role"), F.col("doc_id").alias("id"), "text"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")

    def against(asked: DataFrame) -> DataFrame:
        sent = asked.select("component", every, F.lit(1).alias("role"), "id", "text")
        return gathered(many.drop("parts").unionByName(sent)).mapInArrow(frugal(across), "a long, b long")

    centres = central(members.join(F.broadcast(sizes) if few is not None else sizes, "component").select("node", "component", "fp"))
    first = checkpoint(against(many.join(centres.select(F.col("node").alias("id")), "id", "left_semi")))
    alone = first.where("a = b").select(F.col("a").alias("id")).distinct()
    rest = against(many.join(alone, "id", "left_semi"))
    return edges.unionByName(first).unionByName(rest).where("a <> b").distinct()


def central(members: DataFrame) -> DataFrame:
    """(node) of each component of ``members`` (node, component, fp): that whose fingerprint is nearest to the majority of bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component, fp = longs(batch.column(0)), batch.column(1).to_pylist()
            order = np.argsort(component, kind="stable")
            first = starts_of_runs(component[order])
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                ones = np.unpackbits(np.frombuffer(b"".join([fp[i] for i in order[s:e]]), np.uint8).reshape(e - s, -1), axis=1).sum(axis=0)
                yield pa.record_batch({"component": pa.array([component[order[s]]], pa.int64()), "n": pa.array([e - s], pa.int64()), "ones": pa.array([ones.astype("<i8").tobytes()])})

    def majority(table: pa.Table) -> pa.Table:
        ones = sum(np.frombuffer(x, "<i8") for x in table["ones"].to_pylist())
        n = sum(table["n"].to_pylist())
        return pa.table({"component": table["component"][:1], "centre": pa.array([np.packbits(2 * ones > n).tobytes()])})

    sums = members.select("component", "fp").mapInArrow(frugal(count), "component long, n long, ones binary")
    centres = checkpoint(sums.groupBy("component").applyInArrow(majority, "component long, centre binary"))
    few = small(centres, LOCAL_COMPONENTS)

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)]
            yield pa.record_batch({"component": batch.column(0), "node": batch.column(1), "apart": np.bitwise_count(x[0] ^ x[1]).sum(axis=1).astype(np.int64)})

    met = members.join(centres if few is None else few, "component").select("component", "node", "fp", "centre")
    return met.mapInArrow(frugal(distance), "component long, node long, apart long").groupBy("component").agg(F.min(F.struct("apart", "node")).alias("best")).select("best.node")


def near_duplicate_groups(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for a similarity of at least ``least`` of the sets of word shingles.

    Equal sequences of words are one node. Candidates are equal 512-bit fingerprints and near ones; a fingerprint counts each
    shingle once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            words = [xxhash.xxh3_128_digest(b" ".join((t or b"").lower().split())) for t in texts]
            yield pa.record_batch({"id": part.column(0), "words": pa.array(words, pa.binary()), "fp": pa.array(fingerprints_of(texts, width, WIDE_BITS, True), pa.binary())})

    prints = checkpoint(rows.mapInArrow(frugal(run), "id long, words binary, fp binary"))
    nodes = checkpoint(prints.groupBy("words").agg(F.min("id").alias("id"), F.first("fp").alias("fp")).where("id is not null"))
    distinct = checkpoint(nodes.groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp"))
    order, triples = spread_triples(WIDE_BITS, WIDE_ROUNDS)
    each = len(triples) // WIDE_ROUNDS
    near = checkpoint(components(links(distinct, triples[:each], WIDE_MAX, 0, order)))
    labelled = checkpoint(distinct.join(near, distinct.id == near.node, "left").select("id", "fp", F.coalesce("component", "id").alias("label")))
    more = links(labelled, triples[each:], WIDE_MAX, 0, order)
    equal = nodes.join(distinct.withColumnRenamed("id", "a"), "fp").select("a", F.col("id").alias("b")).where("a <> b")
    same = labelled.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
    blocked = checkpoint(components(more.unionByName(same).unionByName(equal)))
    members = checkpoint(blocked.join(nodes.select(F.col("id").alias("node"), "fp"), "node"))
    found = components(alike_in_blocks(members, rows, width, least))
    owner = nodes.join(found, nodes.id == found.node, "left").select("words", F.coalesce("component", "id").alias("component_id"))
    return prints.join(owner, "words", "left").select(F.col("id").alias("doc_id"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of each near-duplicate group, columns unchanged.

    Rows without an id stay. Of rows that repeat an id, all with the group's smallest id stay.
    """
    groups = near_duplicate_groups(docs, id_col=id_col, text_col=text_col)
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop_id")).distinct()
    return docs.join(drop, docs[id_col] == drop["_drop_id"], "left_anti")
