"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are UTF-8 bytes, white space collapsed, so an n-gram of up to eight symbols is one long and its history
and suffix are shifts and masks of it. Counts are kept in distributed tables only. Training counts the highest order per
block and then by key; lower orders count distinct left continuations. Scoring gathers the distinct n-grams of the whole
corpus, pre-aggregated per block, and joins them with the count and history tables, order by order, each join sharded by
the n-gram: the result is one log probability for each distinct n-gram. Documents then sum theirs: with a copy on every
executor if the table is at most ``local_rows`` rows, and else by asking, for each batch of documents, for that batch's
n-grams only. Both ways give the same figures.

Thresholds are exact quantiles, found by counts of value ranges first and then by sorting the ranges that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, checkpoint, frugal, longs, partitions, picked, small, text_bytes

#: Order of the model, rows of log probabilities that are copied to executors at most, and symbols' worth of the language's
#: mean that a text's own mean is drawn towards.
ORDER, LOCAL_ROWS, PRIOR = 5, 4_000_000, 40
#: A text is kept up to this quantile of its language's trusted texts that were not trained on. One in ``CALIBRATE`` trusted
#: texts is kept from training for that.
QUANTILE, CALIBRATE = 0.99, 5
#: Ranges of values that a quantile is looked for in; UTF-8 bytes of text in a batch that asks for its own n-grams.
RANGES, ASK_BYTES = 4096, 32 << 20
#: Groups up to which their bounds are copied to every executor.
LOCAL_GROUPS = 10_000


def symbols(texts: list[bytes | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of every text as a long, and the text it belongs to; texts start with ``order - 1`` marks."""
    start = b"\x02" * (order - 1)
    plain = [b" ".join((t or b"").split()) for t in texts]
    raw = np.frombuffer(b"".join([start + p for p in plain]), np.uint8)
    size = np.fromiter(map(len, plain), np.int64, len(plain))
    n = len(raw) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = np.zeros(n, np.int64)
    for j in range(order):
        gram = (gram << 8) | raw[j : j + n]
    ends = np.cumsum(size + order - 1)
    doc = np.repeat(np.arange(len(plain)), size)
    first = ends - size - (order - 1)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(doc))
    return gram[at], doc


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over a column ``text``, pre-aggregated before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for _, part in blocks(batches, "text", 2 << 20):
            key, n = np.unique(symbols(part, order)[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 1_000_000:
                yield merged(keys, counts)
                keys, counts, held = [], [], 0
        if keys:
            yield merged(keys, counts)

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        return pa.record_batch({"gram": key, "n": n})

    return texts.select("text").mapInArrow(frugal(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Count and history tables of each order, and the discounts."""

    def __init__(self, highest: DataFrame, order: int = ORDER):
        self.order, self.counts, self.histories, self.discounts = order, {}, {}, {}
        now = checkpoint(highest)
        for k in range(order, 0, -1):
            self.counts[k] = now
            self.discounts[k] = self._discount(list(now.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()))
            d = self._of(F.col("n"), self.discounts[k])
            history = now.groupBy(F.shiftright("gram", 8).alias("history"))
            self.histories[k] = checkpoint(history.agg(F.sum("n").alias("total"), (F.sum(d) / F.sum("n")).alias("gamma")))
            if k > 1:
                now = checkpoint(now.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n")))

    @staticmethod
    def _discount(n: list[int]) -> tuple[float, float, float]:
        """D1, D2 and D3+ from the numbers of n-grams met once to four times; half where the numbers don't allow them."""
        if not all(n):
            return (0.5, 0.5, 0.5)
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return tuple(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d))

    @staticmethod
    def _of(n, d: tuple[float, float, float]):
        return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])

    def log_probabilities(self, asked: DataFrame) -> DataFrame:
        """(gram, logp) of the distinct highest-order n-grams ``asked`` (gram)."""
        asked = checkpoint(asked)
        wanted = {self.order: asked}
        for k in range(self.order - 1, 0, -1):
            wanted[k] = checkpoint(wanted[k + 1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).distinct())
        lower = None
        for k in range(1, self.order + 1):
            q = wanted[k].withColumn("history", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            q = q.join(self.counts[k], "gram", "left").join(self.histories[k], "history", "left")
            base = F.lit(1 / 256)
            if lower is not None:
                q = q.join(lower, "suffix", "left")
                base = F.col("below")
            own = F.coalesce(F.greatest(F.col("n") - self._of(F.col("n"), self.discounts[k]), F.lit(0.0)) / F.col("total"), F.lit(0.0))
            p = own + F.coalesce("gamma", F.lit(1.0)) * base
            lower = q.select(F.col("gram").alias("suffix"), p.alias("below"))
        return checkpoint(lower.select(F.col("suffix").alias("gram"), F.log("below").alias("logp")))


def _sums(keys: np.ndarray, logp: np.ndarray, texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(negative log probability, symbols) of each text from sorted n-grams that hold all of theirs."""
    gram, doc = symbols(texts, order)
    total, n = np.zeros(len(texts)), np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    if len(gram):
        by = np.argsort(gram)
        found = np.empty(len(gram))
        found[by] = logp[np.searchsorted(keys, gram[by])]
        total = -np.bincount(doc, found, len(texts))
    return total, n


def scored(docs: DataFrame, logp: DataFrame, order: int = ORDER, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """``docs`` (key columns and text) with nll and symbols in place of the text."""
    names = [c for c in docs.columns if c != "text"]
    fields = [docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("nll", T.DoubleType()), T.StructField("symbols", T.LongType())])

    def rows(part: pa.RecordBatch, texts: list[bytes | None], keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        total, n = _sums(keys, values, texts, order)
        own = [part.column(part.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*own, pa.array(total), pa.array(n.astype(np.int64))], names=schema.names)

    if logp.count() <= local_rows:
        found = logp.sort("gram").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((found["gram"].to_numpy(), found["logp"].to_numpy().astype(np.float64)))
        del found

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in blocks(batches, "text"):
                yield rows(part, texts, *shared.value)

        return docs.mapInArrow(frugal(near), schema)

    n = max(partitions(docs.sparkSession) * 4, -(-text_bytes(docs) // ASK_BYTES))
    dealt = docs.withColumn("_batch", F.pmod(F.xxhash64(*names, "text"), F.lit(n)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            gram, doc = symbols(texts, order)
            batch = longs(part.column(part.schema.get_field_index("_batch")))[doc] if len(doc) else np.empty(0, np.int64)
            for b in np.unique(batch).tolist():
                key = np.unique(gram[batch == b])
                yield pa.record_batch({"_batch": np.full(len(key), b), "gram": key})

    asked = dealt.mapInArrow(frugal(ask), "_batch long, gram long").distinct()
    answers = asked.join(logp, "gram")

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = longs(right.column("gram").combine_chunks()), right.column("logp").to_numpy()
        by = np.argsort(keys)
        out = [rows(part, texts, keys[by], values[by]) for part, texts in blocks(left.to_batches(), "text")]
        return pa.Table.from_batches(out, schema=pa.schema([*[left.schema.field(c) for c in names], ("nll", pa.float64()), ("symbols", pa.int64())]))

    return dealt.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(far, schema)


def quantiles(values: DataFrame, q: float = QUANTILE) -> DataFrame:
    """(group, limit): the ``q`` quantile of each group's values, between two neighbours in proportion; ``values`` is (group, v).

    Values are counted by range first, ``RANGES`` of them between a group's least and largest; only those in the ranges with
    the two neighbours are then sorted, which spills where memory is short. No group is held in one place.
    """
    ends = values.groupBy("group").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    span = F.col("high") - F.col("low")
    part = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("low")) / span * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int")
    ends = checkpoint(ends)  # a row for each group
    few = small(ends, LOCAL_GROUPS)
    dealt = checkpoint(values.join(ends if few is None else few, "group").select("group", "v", "n", part.alias("part")))
    sizes = dealt.groupBy("group", "part", "n").agg(F.count("*").alias("size"))
    place = (F.col("n") - 1) * F.lit(q)
    at = F.floor(place)
    counts = sizes.groupBy("group", "n").agg(F.sort_array(F.collect_list(F.struct("part", "size"))).alias("sizes"))  # RANGES entries at most

    def found(now: Column, x: Column) -> Column:
        upto, here = now["before"] + x["size"], F.array(F.struct(x["part"].alias("part"), now["before"].alias("before")))
        return F.struct(upto.alias("before"), F.when((now["before"] <= at + 1) & (upto > at), F.concat(now["held"], here)).otherwise(now["held"]).alias("held"))

    none = F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<struct<part:int,before:bigint>>").alias("held"))
    held = counts.select("group", F.inline(F.aggregate("sizes", none, found)["held"]))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("group", "part").orderBy("v")) - 1
    held = checkpoint(held)  # three rows for each group at most
    near = dealt.join(held if few is None else F.broadcast(held), ["group", "part"]).select("group", "v", rank.alias("rank"), place.alias("place"), at.alias("at"))
    lower, upper = (F.max(F.when(F.col("rank") == F.col("at") + k, F.col("v"))) for k in (0, 1))
    pair = near.groupBy("group", "place", "at").agg(lower.alias("lower"), upper.alias("upper"))
    return pair.select("group", (F.col("lower") + F.coalesce((F.col("upper") - F.col("lower")) * (F.col("place") - F.col("at")), F.lit(0.0))).alias("limit"))


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(doc_id, lang, symbols, perplexity, threshold, keep) of every row of ``docs`` (doc_id, text, lang).

    Trusted are texts labelled of quality 1 and not toxic; without any, all labelled texts are, and without those, all. A
    text's mean is drawn towards its language's by ``PRIOR`` symbols, so short texts are judged mildly; empty and null texts
    have the language's mean and are kept. A language without trusted texts takes the threshold of all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    label = label.withColumn("trust", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).otherwise(1))
    known = docs.select("doc_id").join(label, "doc_id")
    best = known.agg(F.max("trust")).first()[0] or 0
    trusted = label.where(F.col("trust") >= best).select("doc_id") if best else docs.select("doc_id").where("doc_id is not null").distinct()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE))
    model = KneserNey(gram_counts(picked(docs, trusted.where(part != 0)), order), order)
    logp = model.log_probabilities(gram_counts(docs, order).select("gram"))
    found = checkpoint(scored(docs.select("doc_id", "lang", "text"), logp, order, local_rows))
    held = found.join(trusted.where(part == 0), "doc_id", "left_semi").where("symbols > 0")
    mean = (F.sum("nll") / F.sum("symbols")).alias("mean")
    means = held.groupBy("lang").agg(mean)
    every = held.agg(F.sum("nll"), F.sum("symbols")).first()
    middle = every[0] / every[1] if every[1] else 0.0
    drawn = (F.col("nll") + PRIOR * F.coalesce("mean", F.lit(middle))) / (F.col("symbols") + PRIOR)
    held = held.join(F.broadcast(means), "lang", "left").withColumn("drawn", drawn)
    groups = F.array(F.concat(F.lit("="), "lang"), F.lit("*"))  # its language, and all
    limits = checkpoint(quantiles(checkpoint(held.select(F.explode(groups).alias("group"), F.col("drawn").alias("v")))))
    whole = limits.where("group = '*'").first()
    other = float(whole["limit"]) if whole is not None else float("inf")
    limits = limits.where("group <> '*'").select(F.expr("substring(group, 2)").alias("lang"), "limit")
    out = found.join(F.broadcast(means.join(limits, "lang")), "lang", "left").withColumn("drawn", drawn).withColumn("limit", F.coalesce("limit", F.lit(other)))
    return out.select("doc_id", "lang", "symbols", F.exp("drawn").alias("perplexity"), F.exp("limit").alias("threshold"), (F.col("drawn") <= F.col("limit")).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged. Rows without an id stay."""
    bad = judged(docs, labels).where(~F.col("keep") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == F.col("_bad"), "left_anti")
