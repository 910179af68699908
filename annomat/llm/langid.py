"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of bitmasks serves as a Bloom filter for every language at once: bit ``l`` of a cell belongs to language ``l``, and
a cell has as many 64-bit words as the languages need. The cells of an n-gram's hashes, AND-ed, give the set of all languages
that contain it. For a text, the set bits of each language are counted over its n-grams and corrected for that filter's false
positives; the largest count decides. The filter has room for all n-grams of the training sample.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, frugal, starts_of_runs

#: Lengths of the n-grams; labelled rows that training reads at most; least cells of the filter, cells for an n-gram at least,
#: and hashes for an n-gram.
LENGTHS, MAX_TRAIN, CELLS, CELLS_EACH, HASHES = (2, 3, 4), 20_000, 1 << 20, 4, 2
#: An n-gram belongs to a language in which it is at least this share as frequent as in the one where it is most frequent.
SHARE = 0.25
_U = np.uint64
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    if not _TABLES:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0])
        _TABLES.append(table)
    return _TABLES[0]


def grams(texts: list[bytes | None], n: int, codes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and the text that each belongs to."""
    code, doc = codes
    size = len(code) - n + 1
    if size <= 0:
        return np.empty(0, _U), np.empty(0, np.int32)
    h = np.full(size, n, _U)
    for j in range(n):
        h = (h ^ code[j : j + size]) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    inside = doc[:size] == doc[n - 1 :]
    return h[inside], doc[:size][inside]


def letters_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with one space around each word, and the text each belongs to; texts without letters have none."""
    plain = [(t or b"").decode() for t in texts]
    code = _letters()[np.frombuffer("".join(f" {t} " for t in plain).encode("utf-32-le"), np.uint32)]
    doc = np.repeat(np.arange(len(plain), dtype=np.int32), np.fromiter(map(len, plain), np.int64, len(plain)) + 2)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    some = np.zeros(len(plain), bool)
    some[doc[code != 32]] = True
    keep = some[doc]
    return code[keep].astype(_U), doc[keep]


class Filters:
    """The Bloom filters of all languages, bit-sliced.

    ``masks`` has a row of 64-bit words for each n-gram, or one word each.
    """

    def __init__(self, languages: list[str], hashes: np.ndarray, masks: np.ndarray, default: str | None = None):
        self.languages, self.default = languages, default
        masks = np.asarray(masks).astype(_U).reshape(len(hashes), -1) if len(hashes) else np.empty((0, 1), _U)
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.dtype(k).itemsize * 8 >= len(languages)), _U)
        cells = max(CELLS, 1 << (CELLS_EACH * len(hashes) - 1).bit_length())
        self.cells = np.zeros((max(1, -(-len(languages) // 64)), cells), kind)
        for at in self._places(hashes):
            for word, own in zip(self.cells, masks.T, strict=False):
                np.bitwise_or.at(word, at, own.astype(kind))
        self.false = np.array([self._bit(self.cells, i).mean() ** HASHES for i in range(len(languages))])

    @staticmethod
    def _bit(words: np.ndarray, language: int) -> np.ndarray:
        kind = words.dtype.type
        return (words[language >> 6] >> kind(language & 63)) & kind(1)

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        mask = _U(self.cells.shape[1] - 1)
        return [((h >> _U(32 * k)) & mask).astype(np.int64) for k in range(HASHES)]

    def contain(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages whose filter contains it, as words by n-grams."""
        first, *rest = self._places(h)
        out = self.cells[:, first]
        for at in rest:
            out = out & self.cells[:, at]
        return out

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) corrected counts, and the number of n-grams of each text."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        codes = letters_of(texts)
        for n in LENGTHS:
            h, doc = grams(texts, n, codes)
            if not len(h):
                continue
            mask, first = self.contain(h), starts_of_runs(doc)
            own = doc[first]
            total[own] += np.diff(np.append(first, len(doc)))
            for i in range(len(self.languages)):
                hits[own, i] += np.add.reduceat(self._bit(mask, i).astype(np.int64), first)
        return np.maximum(0, (hits - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999))), total

    def decide(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text; ``und`` where there is no letter or no language was learned.

        The score is the decided language's share of all corrected counts. Ties go to the first language by name; a text
        none of whose n-grams is known gets the most frequent language of training, with score 0.
        """
        count, total = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = count.argmax(axis=1)
        top, every = count[np.arange(len(texts)), best], count.sum(axis=1)
        lang = ["und" if not n else self.languages[b] if t > 0 else self.default for n, b, t in zip(total.tolist(), best.tolist(), top.tolist(), strict=True)]
        with np.errstate(invalid="ignore", divide="ignore"):
            score, cover = np.where(every > 0, top / every, 0.0), np.where(total > 0, top / total, 0.0)
        return lang, np.clip(score, 0, 1), np.clip(cover, 0, 1)


def fair(sizes: list[int], total: int) -> float:
    """The most that each may have so that all together have ``total``, where the small ones keep all of theirs."""
    for k, n in enumerate(sorted(sizes)):
        each = total / (len(sizes) - k)
        if n > each:
            return each
        total -= n
    return float("inf")


def train(docs: DataFrame, max_rows: int = MAX_TRAIN) -> Filters:
    """Filters from labelled rows (key, text, lang); at most about ``max_rows`` of them, by a hash of the key.

    A language with few rows keeps all of them; the others share what is left evenly.
    """
    labelled = docs.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = sum(sizes.values())
    languages = sorted(sizes)
    if rows > max_rows:
        most = fair(list(sizes.values()), max_rows)
        share = F.create_map(*[F.lit(x) for lang, n in sizes.items() if n > most for x in (lang, 2 * most / n - 1)])[F.col("lang")]
        labelled = labelled.where(share.isNull() | (F.xxhash64("key") / F.lit(float(1 << 63)) < share))
    index = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            lang = np.array([index[x] for x in part.column(1).to_pylist()])
            codes = letters_of(texts)
            for n in LENGTHS:
                h, doc = grams(texts, n, codes)
                own = lang[doc] if len(doc) else np.empty(0, np.int64)
                for i in np.unique(own).tolist():
                    key, count = np.unique(h[own == i], return_counts=True)
                    yield pa.record_batch({"h": key.view(np.int64), "n": np.full(len(key), n, np.int32), "lang": np.full(len(key), i, np.int32), "count": count.astype(np.int64)})

    found = labelled.select("text", "lang").mapInArrow(frugal(run), "h long, n int, lang int, count long").groupBy("h", "n", "lang").agg(F.sum("count").alias("count"))
    whole = found.groupBy("n", "lang").agg(F.sum("count").alias("whole"))
    share = found.join(F.broadcast(whole), ["n", "lang"]).withColumn("rate", F.col("count") / F.col("whole"))
    most = share.withColumn("most", F.max("rate").over(Window.partitionBy("h"))).where(F.col("rate") >= SHARE * F.col("most"))
    words = range(max(1, -(-len(languages) // 64)))
    masks = [F.expr(f"bit_or(if(shiftright(lang, 6) = {w}, shiftleft(1L, lang & 63), 0L))").alias(f"mask{w}") for w in words]
    table = most.groupBy("h").agg(*masks).toArrow()
    default = max(languages, key=lambda x: (sizes[x], x), default=None)
    return Filters(languages, table["h"].to_numpy().view(_U), np.stack([table[f"mask{w}"].to_numpy().view(_U) for w in words], axis=1), default)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def predictions(docs: DataFrame, filters: Filters, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score and coverage (share of the text's n-grams known in that language)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # eight cells at most for each n-gram of the bounded sample, a bit a language
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "_text"):
            lang, score, cover = shared.value.decide(texts)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(cover)], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Learns from rows that are not held out and have a language and a text. A null or letterless text is ``und`` with score
    0. A null id is held out as SQL's null, shown as false.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    keyed = keyed.withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    filters = train(keyed.where(~F.col("held_out") & F.col("text").isNotNull()).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predictions(keyed, filters, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.05) -> DataFrame:
    """The rows of ``docs`` in a known language, columns unchanged: not ``und``, and at least ``least`` of the n-grams known."""
    names = docs.columns
    filters = train(docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null"))
    found = predictions(docs, filters, names, text_col)
    return found.where((F.col("lang_pred") != "und") & (F.col("coverage") >= least)).select(*[F.col(f"`{c}`") for c in names])
