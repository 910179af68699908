"""A dataset from the relational tables: orders are observations, parts are variables, X counts quantities."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat.functions.casts import rounded
from annomat.model import AnnotatedMatrix
from annomat.operators import uns
from annomat.operators.layout import triples, with_index
from annomat.shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, idx): orders by key."""
    return with_index(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), "key", "idx")


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, idx): parts by key."""
    return with_index(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), "key", "idx")


class Axes:
    """Both axes of the dataset, indexed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.obs, self.var = observations(spark, sf_dir), variables(spark, sf_dir)


def counts(spark: SparkSession, sf_dir: str, axes: Axes | None = None) -> DataFrame:
    """X: the quantity of each part in each order, whole numbers as long."""
    axes = axes or Axes(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    x = triples(lines, axes.obs, axes.var, "l_orderkey", "l_partkey", F.col("l_quantity"))
    return x.withColumn("value", F.col("value").cast("long"))


def cents(spark: SparkSession, sf_dir: str, axes: Axes | None = None) -> DataFrame:
    """A layer: the price of each part in each order in cents."""
    axes = axes or Axes(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return triples(lines, axes.obs, axes.var, "l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long"))


def cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document metadata with every kind of column: (doc_id, lang, source, n_chars, quality, toxic)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def dataset(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """The whole dataset; X is u32, the layer holds cents as f64."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    o = with_index(orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent")), "key", "idx")
    v = with_index(parts.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.col("p_size").cast("int").alias("size")), "key", "idx")
    obs = o.select(F.col("idx").alias("obs_idx"), F.concat(F.lit("o"), F.col("key").cast("string")).alias("obs_id"), "status", "total", "urgent")
    var = v.select(F.col("idx").alias("var_idx"), F.concat(F.lit("p"), F.col("key").cast("string")).alias("var_id"), "brand", "size")
    levels = {"obs": {"status": [r[0] for r in obs.select("status").distinct().orderBy("status").collect()]}, "var": {}}
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    both = stored(triples(lines, o, v, "l_orderkey", "l_partkey", F.col("l_quantity"), cents=rounded(F.col("l_extendedprice") * 100)))
    x, layer = both.select("obs_idx", "var_idx", F.col("value").cast("long").alias("value")), both.select("obs_idx", "var_idx", F.col("cents").cast("double").alias("value"))
    return AnnotatedMatrix(spark, orders.count(), parts.count(), "u32", x, obs, var, layers={"price_cents": layer}, layer_dtypes={"price_cents": "f64"}, levels=levels, uns={"origin": "orders and parts"}, format="memory")


def rich_dataset(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """The same with embeddings, graphs, an integer column that has nulls, and nested metadata."""
    data = dataset(spark, sf_dir)
    rank = F.when(F.col("status") != "F", F.floor(F.col("total")).cast("int"))
    obs = data.obs.withColumn("rank", rank)
    square = lambda df, idx, size: df.select(F.col(idx).alias("i"), F.pmod(F.col(idx) * 7 + 3, F.lit(size)).alias("j"), (F.col(idx) % 100 + 1).cast("float").alias("value"))
    vectors = lambda df, idx, *of: df.select(F.col(idx).alias("idx"), F.array(*[F.col(c).cast("double") for c in of]).alias("vec"))
    return replace(
        data, obs=obs, obsm={"X_pca": vectors(obs, "obs_idx", "total", "obs_idx", "urgent")}, varm={"X_pca": vectors(data.var, "var_idx", "size", "var_idx")},
        obsp={"knn": square(obs, "obs_idx", data.n_obs)}, varp={"near": square(data.var, "var_idx", data.n_vars)}, uns={"origin": "orders and parts", "nested": {"n": 3, "name": "x"}},
    )


def slot_cells(data: AnnotatedMatrix, skip: tuple[str, ...] = ()) -> DataFrame:
    """(slot, a, b, value): every cell of every slot as text, numbers as whole ones: for comparing whole datasets."""
    whole = lambda v: rounded(F.col(v) * 100).cast("string")
    rows = lambda df, slot, a, b, v: df.select(F.lit(slot).alias("slot"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), v.alias("value"))
    out = [rows(data.x, "X", "obs_idx", "var_idx", whole("value"))] + [rows(d, f"layers/{k}", "obs_idx", "var_idx", whole("value")) for k, d in data.layers.items()]
    for slot in ("obs", "var"):
        df = getattr(data, slot)
        values = {c: whole(f"`{c}`") if kind in ("int", "double", "float", "bigint") else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if c != f"{slot}_idx"}
        cells = F.explode(F.array(*[F.struct(F.lit(f"{slot}/{c}").alias("slot"), v.alias("value")) for c, v in values.items()]))  # one pass over the table
        out.append(df.select(F.col(f"{slot}_idx").cast("long").alias("a"), cells.alias("c")).select("c.slot", "a", F.lit(0).cast("long").alias("b"), "c.value"))
    for slot in ("obsm", "varm"):
        for k, d in getattr(data, slot).items():
            out.append(rows(d.select("idx", F.posexplode("vec").alias("pos", "v")), f"{slot}/{k}", "idx", "pos", whole("v")))
    out += [rows(d, f"{slot}/{k}", "i", "j", whole("value")) for slot in ("obsp", "varp") for k, d in getattr(data, slot).items()]
    fixed = [(f"levels/{slot}/{c}", i, 0, x) for slot, own in data.levels.items() for c, xs in own.items() for i, x in enumerate(xs)] + [(f"uns{p}", 0, 0, v) for p, _, v in uns.leaves(data.uns) if data.uns]
    out.append(data.spark.createDataFrame(fixed, "slot string, a long, b long, value string"))
    both = reduce(DataFrame.unionByName, out)
    return both.where(~F.col("slot").isin(*skip)) if skip else both


def small_dataset(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """Nations by regions: a dataset of a few rows, for verbs that write many files."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    x = nation.select(F.col("n_nationkey").cast("long").alias("obs_idx"), F.col("n_regionkey").cast("long").alias("var_idx"), (F.col("n_nationkey") + 1).cast("long").alias("value"))
    obs = nation.select(F.col("n_nationkey").cast("long").alias("obs_idx"), F.col("n_name").alias("obs_id"), F.col("n_regionkey").alias("region"))
    var = region.select(F.col("r_regionkey").cast("long").alias("var_idx"), F.col("r_name").alias("var_id"))
    return AnnotatedMatrix(spark, nation.count(), region.count(), "u32", x, obs, var, layers={"spliced": x.withColumn("value", F.col("value").cast("float"))}, uns={"origin": "nations"})


def patch_dataset(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """A patch for :func:`dataset`: every third order and every second part, numbered anew, with slots of its own."""
    base = dataset(spark, sf_dir)
    obs = with_index(base.obs.where("obs_idx % 3 = 0").select(F.col("obs_idx").alias("old"), "obs_id"), "old", "obs_idx")
    var = with_index(base.var.where("var_idx % 2 = 0").select(F.col("var_idx").alias("old"), "var_id"), "old", "var_idx")
    n, m = obs.count(), var.count()
    x = base.x.withColumnsRenamed({"obs_idx": "i", "var_idx": "j"}).join(obs.select(F.col("old").alias("i"), "obs_idx"), "i").join(var.select(F.col("old").alias("j"), "var_idx"), "j")
    ring = lambda df, idx, size: df.select(F.col(idx).alias("i"), F.pmod(F.col(idx) + 1, F.lit(size)).alias("j"), F.col("old").cast("float").alias("value"))
    return AnnotatedMatrix(
        spark, n, m, "u32", x.select("obs_idx", "var_idx", "value"), obs.select("obs_idx", "obs_id", (F.col("old") / 2).alias("score")), var.select("var_idx", "var_id", (F.col("old") % 4 == 0).alias("chosen")),
        layers={"third": x.select("obs_idx", "var_idx", F.col("value").cast("double").alias("value"))}, layer_dtypes={"third": "f64"},
        obsm={"X_two": obs.select(F.col("obs_idx").alias("idx"), F.array(F.col("old").cast("double"), F.lit(1.0)).alias("vec"))}, varm={"PCs": var.select(F.col("var_idx").alias("idx"), F.array(F.col("old").cast("double")).alias("vec"))},
        obsp={"ring": ring(obs, "obs_idx", n)}, varp={"ring": ring(var, "var_idx", m)}, uns={"third": {"of": 3}},
    )
