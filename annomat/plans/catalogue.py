"""Named queries of the engine with the SQL that states the same result over the same tables."""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomat import api, cli, sources, streaming
from annomat.errors import AnnotatedMatrixError, InvalidFormatError, NotFoundError
from annomat.functions import casts, codecs
from annomat.model import AnnotatedMatrix
from annomat.operators import columns, layout, profile, provenance, slots, uns, validate
from annomat.operators import merge as merging
from annomat.plans import fixtures
from annomat.plans.fixtures import table
from annomat.shared import mounted_folder
from annomat.sources import hdf5, npy

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The canonical dataset in SQL.
COO = """
x AS (SELECT l_orderkey AS o, l_partkey AS p, CAST(sum(l_quantity) AS BIGINT) AS v, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1, 2),
ob AS (SELECT o_orderkey AS o, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS i FROM orders),
va AS (SELECT p_partkey AS p, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS j FROM part),
coo AS (SELECT i, j, v, c FROM x JOIN ob USING (o) JOIN va USING (p))"""
#: Its index and value streams in row order, cut into chunks of 128.
STREAM = COO + """,
s0 AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS k, j, v FROM coo),
s1 AS (SELECT k, k // 128 AS c, CAST(k % 128 AS INTEGER) AS r, j, v, j - coalesce(lag(j) OVER (ORDER BY k), 0) AS d, coalesce(lag(j) OVER (ORDER BY k), 0) AS prev FROM s0),
s AS (SELECT k, c, r, j, v, prev, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z, (v - 1) & 4294967295 AS f FROM s1)"""


def _pack_sql(u: str) -> str:
    return f"""WITH {STREAM},
w AS (SELECT c, CASE WHEN max({u}) = 0 THEN 0 ELSE length(ltrim(bin(max({u})), '0')) END AS b FROM s GROUP BY c),
t AS (SELECT c, b, {u} AS u, r % 4 AS lane, ((r // 4) * b) % 32 AS off, ((r // 4) * b) // 32 AS wd FROM s JOIN w USING (c) WHERE b > 0),
y AS (SELECT c, b, wd * 4 + lane AS pos, (u << off) & 4294967295 AS word FROM t
      UNION ALL SELECT c, b, (wd + 1) * 4 + lane, u >> (32 - off) FROM t WHERE off + b > 32
      UNION ALL SELECT c, b, unnest(range(4 * b)), 0 FROM w WHERE b > 0)
SELECT CAST(c AS BIGINT) AS c, CAST(b AS INTEGER) AS b, CAST(pos AS INTEGER) AS pos, CAST(bit_or(CAST(word AS BIGINT)) AS BIGINT) AS word FROM y GROUP BY c, b, pos"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# Layouts


@query(f"WITH {COO} SELECT i AS obs_idx, j AS var_idx, v AS value FROM coo")
def x_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.counts(spark, sf_dir)


@query(f"WITH {COO}, n AS (SELECT ob.i, count(coo.j) AS n FROM ob LEFT JOIN coo ON ob.i = coo.i GROUP BY ob.i) SELECT i + 1 AS pos, CAST(sum(n) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ptr FROM n UNION ALL SELECT 0, 0")
def csr_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fixtures.Axes(spark, sf_dir)
    return layout.indptr(fixtures.counts(spark, sf_dir, axes), axes.obs, "obs_idx")


@query(f"WITH {COO}, n AS (SELECT va.j, count(coo.i) AS n FROM va LEFT JOIN coo ON va.j = coo.j GROUP BY va.j) SELECT j + 1 AS pos, CAST(sum(n) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ptr FROM n UNION ALL SELECT 0, 0")
def csc_indptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fixtures.Axes(spark, sf_dir)
    return layout.indptr(fixtures.counts(spark, sf_dir, axes), axes.var, "var_idx")


@query(f"WITH {COO} SELECT i AS obs_idx, list(j ORDER BY j) AS indices, list(v ORDER BY j) AS values FROM coo GROUP BY i")
def csr_rows_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.packed_rows(fixtures.counts(spark, sf_dir))


@query(f"WITH {COO} SELECT j AS var_idx, list(i ORDER BY i) AS indices, list(v ORDER BY i) AS values FROM coo GROUP BY j")
def csc_cols_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.packed_rows(fixtures.counts(spark, sf_dir), "var_idx", "obs_idx")


@query(f"WITH {COO} SELECT j AS var_idx, i // 1000 AS part, list(i ORDER BY i) AS indices, list(v ORDER BY i) AS values FROM coo GROUP BY 1, 2")
def csc_cols_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_blocks(fixtures.counts(spark, sf_dir), 1000, "var_idx", "obs_idx")


@query(f"WITH {COO} SELECT i AS obs_idx, j AS var_idx, v AS value FROM coo")
def csc_to_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_column = layout.packed_rows(fixtures.counts(spark, sf_dir), "var_idx", "obs_idx")
    return layout.ordered(layout.unpacked(by_column, "var_idx", "obs_idx").select("obs_idx", "var_idx", "value"))


@query(f"WITH {COO} SELECT i - 100 AS obs_idx, j AS var_idx, v AS value FROM coo WHERE i >= 100 AND i < 900")
def csr_slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.slice_rows(fixtures.counts(spark, sf_dir), 100, 900)


@query(f"WITH {COO} SELECT ob.i // 1000 * 1000 AS row_offset, count(DISTINCT ob.i) AS nrows, count(coo.j) AS nnz, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM ob LEFT JOIN coo ON ob.i = coo.i GROUP BY 1")
def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fixtures.Axes(spark, sf_dir)
    return layout.chunk_profile(fixtures.counts(spark, sf_dir, axes), axes.obs, 1000)


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS value, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS var_idx FROM embeddings) SELECT vec_id AS obs_idx, var_idx, value FROM e WHERE value <> 0")
def dense_to_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dense_to_triples(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, vec_id AS idx, unnest(embedding) AS value FROM embeddings")
def obsm_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.transposed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("WITH e AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, vec_id, unnest(embedding) AS value FROM embeddings) SELECT pos, list(value ORDER BY vec_id) AS vec FROM e GROUP BY pos")
def obsm_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dense_columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("WITH e AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, vec_id, unnest(embedding) AS value FROM embeddings) SELECT pos, vec_id // 100 AS part, list(value ORDER BY vec_id) AS vec FROM e GROUP BY 1, 2")
def obsm_column_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_blocks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 100)


@query(f"WITH {COO} SELECT ob.i AS idx, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM ob LEFT JOIN coo ON ob.i = coo.i GROUP BY ob.i")
def row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fixtures.Axes(spark, sf_dir)
    return layout.sums(fixtures.counts(spark, sf_dir, axes), axes.obs, "obs_idx")


@query(f"WITH {COO} SELECT va.j AS idx, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM va LEFT JOIN coo ON va.j = coo.j GROUP BY va.j")
def col_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fixtures.Axes(spark, sf_dir)
    return layout.sums(fixtures.counts(spark, sf_dir, axes), axes.var, "var_idx")


@query(f"WITH {COO} SELECT count(*) AS nnz FROM coo")
def x_nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.counts(spark, sf_dir).agg(F.count("*").alias("nnz"))


@query(f"WITH {COO}, g AS (SELECT a.i, b.j FROM range(100) AS a(i), range(100) AS b(j)) SELECT g.i AS obs_idx, g.j AS var_idx, coalesce(v, 0) AS value FROM g LEFT JOIN coo ON g.i = coo.i AND g.j = coo.j")
def submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.submatrix(fixtures.counts(spark, sf_dir), 100, 100)


@query(f"WITH {COO} SELECT i AS obs_idx, j AS var_idx, c AS value FROM coo")
def layer_price_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cents(spark, sf_dir)


@query(f"""WITH {COO} SELECT 'X' AS slot, '' AS key, (SELECT count(*) FROM ob) AS n_rows, (SELECT count(*) FROM va) AS n_cols, (SELECT count(*) FROM coo) AS nnz, 'u32' AS dtype
UNION ALL SELECT 'layers', 'price_cents', (SELECT count(*) FROM ob), (SELECT count(*) FROM va), (SELECT count(*) FROM coo), 'f64'""")
def slot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.dataset(spark, sf_dir).manifest()


# Casts: totals in cents run past both integer types.



def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cents(spark, sf_dir).withColumn("value", ((F.col("value") - 1000000) * F.lit(1000.5)).cast("double"))


@query(f"WITH {COO} SELECT i AS obs_idx, j AS var_idx, CAST(c AS FLOAT) AS value FROM coo")
def cast_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.converted(fixtures.cents(spark, sf_dir), "f32")


@query(f"WITH {COO} SELECT i AS obs_idx, j AS var_idx, CAST(c AS DOUBLE) AS value FROM coo")
def cast_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.converted(fixtures.cents(spark, sf_dir), "f64")


@query(f"WITH {COO}, w AS (SELECT i, j, (c - 1000000) * CAST(1000.5 AS DOUBLE) AS v FROM coo) SELECT i AS obs_idx, j AS var_idx, CAST(trunc(greatest(least(v, 2147483647), -2147483648)) AS INTEGER) AS value FROM w")
def cast_i32_sat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.converted(_wide(spark, sf_dir), "i32")


@query(f"WITH {COO}, w AS (SELECT i, j, (c - 1000000) * CAST(1000.5 AS DOUBLE) AS v FROM coo) SELECT i AS obs_idx, j AS var_idx, CAST(trunc(greatest(least(v, 4294967295), 0)) AS BIGINT) AS value FROM w")
def cast_u32_sat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.converted(_wide(spark, sf_dir), "u32")


#: Values that any column may hold, by line number: null, not a number, both infinities, both zeros and plain ones.
_ODD_SQL = "SELECT l_orderkey AS o, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN 'Infinity'::DOUBLE WHEN 4 THEN '-Infinity'::DOUBLE WHEN 5 THEN -0.0::DOUBLE ELSE (l_quantity - 25) * 1e8 + 0.75 END AS v FROM lineitem"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("l_linenumber") == 1, None)
    for n, value in ((2, "nan"), (3, "inf"), (4, "-inf")):
        odd = odd.when(F.col("l_linenumber") == n, float(value))
    odd = odd.when(F.col("l_linenumber") == 5, -0.0).otherwise((F.col("l_quantity").cast("double") - 25) * 1e8 + 0.75)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), odd.alias("value"))


@query(f"WITH w AS ({_ODD_SQL}) SELECT o AS orderkey, n AS line, CAST(CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN 0 ELSE trunc(greatest(least(v, 2147483647), -2147483648)) END AS INTEGER) AS value FROM w")
def cast_i32_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.converted(_odd(spark, sf_dir), "i32")


@query(f"WITH w AS ({_ODD_SQL}) SELECT o AS orderkey, n AS line, CAST(CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN 0 ELSE trunc(greatest(least(v, 4294967295), 0)) END AS BIGINT) AS value FROM w")
def cast_u32_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.converted(_odd(spark, sf_dir), "u32")


# Codecs


def _stream(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    """(k, v): indices or values of X in row order."""
    return layout.stream(fixtures.counts(spark, sf_dir), of)


@query(f"WITH {STREAM} SELECT k, c, r, CAST(z AS BIGINT) AS u FROM s")
def d1z_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.d1z(_stream(spark, sf_dir, "var_idx"))


@query(f"WITH {STREAM} SELECT c, CAST(prev AS BIGINT) AS start FROM s WHERE r = 0")
def d1z_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.d1z_starts(_stream(spark, sf_dir, "var_idx"))


@query(f"WITH {STREAM} SELECT k, c, r, CAST(f AS BIGINT) AS u FROM s")
def for_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.frame(_stream(spark, sf_dir, "value"))


@query(f"WITH {STREAM} SELECT c, CAST(CASE WHEN max(z) = 0 THEN 0 ELSE length(ltrim(bin(max(z)), '0')) END AS INTEGER) AS b FROM s GROUP BY c")
def bp128_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.widths(codecs.d1z(_stream(spark, sf_dir, "var_idx")))


@query(f"WITH {STREAM}, w AS (SELECT c, 4 * CASE WHEN max(z) = 0 THEN 0 ELSE length(ltrim(bin(max(z)), '0')) END AS n FROM s GROUP BY c) SELECT c + 1 AS c, CAST(sum(n) OVER (ORDER BY c ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idx FROM w UNION ALL SELECT 0, 0")
def bp128_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.word_offsets(codecs.d1z(_stream(spark, sf_dir, "var_idx")))


@query(_pack_sql("z"))
def bp128_d1z_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.pack(codecs.d1z(_stream(spark, sf_dir, "var_idx")))


@query(_pack_sql("f"))
def bp128_for_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.pack(codecs.frame(_stream(spark, sf_dir, "value")))


@query(f"WITH {STREAM} SELECT k, CAST(j AS BIGINT) AS v FROM s")
def bp128_d1z_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir, "var_idx")
    coded = codecs.d1z(stream)
    return codecs.undo_d1z(codecs.unpack(codecs.pack(coded), codecs.chunk_table(coded)), codecs.d1z_starts(stream))


@query(f"WITH {STREAM} SELECT k, CAST(v AS BIGINT) AS v FROM s")
def bp128_for_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codecs.frame(_stream(spark, sf_dir, "value"))
    return codecs.undo_frame(codecs.unpack(codecs.pack(coded), codecs.chunk_table(coded)))


# Columns


@query("WITH l AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) SELECT doc_id, lang, code FROM documents LEFT JOIN l USING (lang)")
def cat_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.encoded(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "code")


@query("SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS code, source AS level FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def cat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.levels(table(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id, source AS label FROM documents")
def cat_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    known = columns.levels(docs, "source")
    return columns.decoded(columns.encoded(docs, "source", known).select("doc_id", "code"), "code", known, "label").select("doc_id", "label")


@query("WITH l AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS factor FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) SELECT doc_id, factor, lang AS label FROM documents LEFT JOIN l USING (lang)")
def factor_1based(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    known = columns.levels(docs, "lang")
    coded = columns.encoded(docs, "lang", known).select("doc_id", columns.factor(F.col("code")).alias("factor"))
    return columns.decoded(coded, "factor", known, "label", base=1).select("doc_id", "factor", "label")


@query("SELECT doc_id, coalesce(CAST(quality AS DOUBLE), -1) AS quality, quality IS NULL AS missing, coalesce(toxic = 1, false) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def nullable_to_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.cell_table(spark, sf_dir).select("doc_id", casts.nan_for_null(F.col("quality")).alias("q"), casts.false_for_null(F.col("toxic") == 1).alias("toxic"))
    return cells.select("doc_id", F.nanvl("q", F.lit(-1.0)).alias("quality"), F.isnan("q").alias("missing"), "toxic")


@query("SELECT doc_id, coalesce(toxic, 2) = 1 AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def logical_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cell_table(spark, sf_dir).select("doc_id", casts.logical(F.coalesce("toxic", F.lit(2))).alias("toxic"))


@query("SELECT doc_id, CAST(n_chars AS INTEGER) AS n_chars FROM documents")
def widen_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", casts.widened(F.col("n_chars"), "bigint").alias("n_chars"))


# Slots

_SLOTS = ("X", "obs:status", "obs:total", "obs:urgent", "var:brand", "var:size", "layers:price_cents", "obsm:X_pca", "obsp:knn", "uns")
_VALUES = ", ".join(f"('{x}')" for x in _SLOTS)


def _slots(spark: SparkSession, keep: slots.SlotFilter) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _SLOTS], "slot string").where(keep.condition(F.col("slot")))


@query(f"SELECT slot FROM (VALUES {_VALUES}) AS t(slot) WHERE slot = 'X' OR slot = 'obs' OR slot LIKE 'obs:%' OR slot = 'var:size'")
def slot_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, slots.SlotFilter.parse(only="X, obs,var:size"))


@query(f"SELECT slot FROM (VALUES {_VALUES}) AS t(slot) WHERE NOT (slot = 'uns' OR slot = 'obs' OR slot LIKE 'obs:%' OR slot = 'layers:price_cents')")
def slot_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, slots.SlotFilter.parse(exclude="uns, obs, layers:price_cents"))


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN 'data' ELSE o_orderpriority END AS slot FROM orders")
def x_slot_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("orderkey"), slots.x_slot_column(F.lit("auto"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F").alias("slot"))


@query("SELECT p_partkey AS partkey, 'X_' || lower(p_brand) AS key, lower(p_brand) AS name FROM part")
def reduction_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), slots.reduction_key(F.col("p_brand")).alias("key"))
    return p.withColumn("name", slots.reduction_name(F.col("key")))


# Profiles and validation


@query("""SELECT 'lang' AS "column", count(lang) AS n, count(*) - count(lang) AS n_null, count(DISTINCT lang) AS n_distinct FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'source', count(source), count(*) - count(source), count(DISTINCT source) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'n_chars', count(n_chars), count(*) - count(n_chars), count(DISTINCT n_chars) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'quality', count(quality), count(*) - count(quality), count(DISTINCT quality) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', count(toxic), count(*) - count(toxic), count(DISTINCT toxic) FROM documents LEFT JOIN labels USING (doc_id)""")
def inspect_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(fixtures.cell_table(spark, sf_dir), ["lang", "source", "n_chars", "quality", "toxic"])


@query("SELECT 'orders' AS name, count(*) = count(DISTINCT o_orderkey) AS ok, 'unique' AS detail FROM orders UNION ALL SELECT 'lines', count(*) = count(DISTINCT (l_orderkey, l_linenumber)), CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS VARCHAR) || ' duplicates' FROM lineitem")
def index_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"))
    return validate.unique(table(spark, sf_dir, "orders"), "o_orderkey", "orders").unionByName(validate.unique(lines, "id", "lines"))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return validate.missing_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), found, "custkey")


@query(f"WITH {COO} SELECT ob.i // 1000 * 1000 AS row_offset, count(coo.j) >= 3900 AS enough FROM ob LEFT JOIN coo ON ob.i = coo.i GROUP BY 1")
def qualifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = fixtures.Axes(spark, sf_dir)
    chunks = layout.chunk_profile(fixtures.counts(spark, sf_dir, axes), axes.obs, 1000)
    return chunks.select("row_offset", validate.Qualifier.parse(">= 3900").condition(F.col("nnz")).alias("enough"))


@query(f"""WITH {COO}, n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM part) AS p)
SELECT 'obs' AS name, o >= 1000 AS ok, CAST(o AS VARCHAR) || ', expected >= 1000' AS detail FROM n
UNION ALL SELECT 'vars', p < 100, CAST(p AS VARCHAR) || ', expected < 100' FROM n
UNION ALL SELECT 'x_dtype', true, 'u32, expected u32'
UNION ALL SELECT 'layers', false, 'missing: spliced'
UNION ALL SELECT 'obs_columns', true, 'all 2 present'
UNION ALL SELECT 'obs_index_unique', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders), 'unique'
UNION ALL SELECT 'check_finite', true, '0 values not finite'
UNION ALL SELECT 'check_sorted_indices', true, '0 cells stored twice'""")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = validate.Schema.of({"obs": ">= 1000", "vars": "< 100", "x_dtype": "u32", "layers": ["price_cents", "spliced"], "obs_columns": ["status", "total"], "obs_index_unique": True, "check_finite": True, "check_sorted_indices": True})
    report = validate.run(fixtures.dataset(spark, sf_dir), schema)
    return spark.createDataFrame([(c.name, c.ok, c.detail) for c in report.checks], "name string, ok boolean, detail string")


@query("SELECT 'check_finite' AS name, count(*) = 0 AS ok, CAST(count(*) AS VARCHAR) || ' values not finite' AS detail FROM (SELECT unnest(embedding) AS v FROM embeddings) WHERE v IS NULL OR NOT isfinite(v)")
def check_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.finite(layout.dense_to_triples(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "check_finite")


@query("SELECT 'sorted_indices' AS name, true AS ok, '0 rows not sorted' AS detail")
def check_sorted_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.sorted_indices(layout.packed_rows(fixtures.counts(spark, sf_dir)))


# Unstructured metadata and provenance


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def uns_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uns.extracted(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": "$.k", "absent": "$.absent"}).drop("props")


@query("SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def uns_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uns.exploded(table(spark, sf_dir, "events"), "event_id", "props").where("value is not null")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def prov_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", provenance.sha256(F.col("text")).alias("sha256"))


@query("""SELECT source, count(*) AS n_docs, '{"source":"' || source || '","n_obs":' || count(*) || ',"n_vars":' || max(n_chars) || ',"source_sha256":"' || sha256(source) || '"}' AS record FROM documents GROUP BY source""")
def prov_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.max("n_chars").alias("most"))
    return docs.select("source", "n_docs", provenance.record_column(F.col("source"), F.col("n_docs"), F.col("most"), provenance.sha256(F.col("source"))).alias("record"))


# Graphs, sinks and sources, merging


@query("WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS i, b.l_suppkey AS j, count(*) AS value FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def obsp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts, and how many; a stored graph for the tests, not a matrix operator."""
    s = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    both = s.withColumnRenamed("l_suppkey", "i").join(s.withColumnRenamed("l_suppkey", "j"), "l_partkey").where("i < j")
    return both.groupBy("i", "j").agg(F.count("*").alias("value"))


def _scratch(spark: SparkSession) -> str:
    """A new path that driver and executors share."""
    return f"{mounted_folder(spark)}/roundtrip-{uuid.uuid4().hex}"


def _remove(path: str) -> None:
    """Removes a dataset in the scratch folder that nothing reads any more."""
    shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)


def _roundtrip(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    path = fixtures.dataset(spark, sf_dir).write(_scratch(spark), format)
    return sources.read(spark, path, format).x


@query(_ORACLES["x_coo"])
def roundtrip_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "bundle")


@query(_ORACLES["x_coo"])
def roundtrip_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "npy")


@query(_ORACLES["x_coo"])
def roundtrip_bpcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, "bpcells")


@query("SELECT doc_id, lang, quality, coalesce(toxic = 1, false) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def merge_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annomat.operators.merge import merged_columns

    base = table(spark, sf_dir, "documents").select("doc_id", "lang")
    patch = table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    return merged_columns(base, patch, "doc_id")


# Whole datasets through files: every slot is compared

#: Every cell of the dataset with all slots; ``{null}`` is what a null integer becomes.
CELLS = COO + """,
o1 AS (SELECT i, o_orderkey AS o, o_orderstatus AS status, o_totalprice AS total, o_orderpriority = '1-URGENT' AS urgent FROM orders JOIN ob ON o_orderkey = ob.o),
p1 AS (SELECT j, p_partkey AS p, p_brand AS brand, p_size AS size FROM part JOIN va ON p_partkey = va.p),
sizes AS (SELECT (SELECT count(*) FROM o1) AS n, (SELECT count(*) FROM p1) AS m),
levels AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS k FROM (SELECT DISTINCT status FROM o1)),
cells(slot, a, b, value) AS (
  SELECT 'X', i, j, CAST(v * 100 AS VARCHAR) FROM coo UNION ALL SELECT 'layers/price_cents', i, j, CAST(c * 100 AS VARCHAR) FROM coo
  UNION ALL SELECT 'obs/obs_id', i, 0, 'o' || o FROM o1 UNION ALL SELECT 'obs/status', i, 0, status FROM o1
  UNION ALL SELECT 'obs/total', i, 0, CAST(CAST(round(total * 100) AS BIGINT) AS VARCHAR) FROM o1 UNION ALL SELECT 'obs/urgent', i, 0, CAST(urgent AS VARCHAR) FROM o1
  UNION ALL SELECT 'obs/rank', i, 0, CAST(CASE WHEN status <> 'F' THEN CAST(floor(total) AS BIGINT) * 100 ELSE {null} END AS VARCHAR) FROM o1
  UNION ALL SELECT 'var/var_id', j, 0, 'p' || p FROM p1 UNION ALL SELECT 'var/brand', j, 0, brand FROM p1 UNION ALL SELECT 'var/size', j, 0, CAST(size * 100 AS VARCHAR) FROM p1
  UNION ALL SELECT 'obsm/X_pca', i, 0, CAST(CAST(round(total * 100) AS BIGINT) AS VARCHAR) FROM o1 UNION ALL SELECT 'obsm/X_pca', i, 1, CAST(i * 100 AS VARCHAR) FROM o1
  UNION ALL SELECT 'obsm/X_pca', i, 2, CASE WHEN urgent THEN '100' ELSE '0' END FROM o1
  UNION ALL SELECT 'varm/X_pca', j, 0, CAST(size * 100 AS VARCHAR) FROM p1 UNION ALL SELECT 'varm/X_pca', j, 1, CAST(j * 100 AS VARCHAR) FROM p1
  UNION ALL SELECT 'obsp/knn', i, (i * 7 + 3) % n, CAST((i % 100 + 1) * 100 AS VARCHAR) FROM o1, sizes UNION ALL SELECT 'varp/near', j, (j * 7 + 3) % m, CAST((j % 100 + 1) * 100 AS VARCHAR) FROM p1, sizes
  UNION ALL SELECT 'levels/obs/status', k, 0, status FROM levels
  UNION ALL SELECT 'uns/origin', 0, 0, '"orders and parts"' UNION ALL SELECT 'uns/nested/n', 0, 0, '3' UNION ALL SELECT 'uns/nested/name', 0, 0, '"x"'
)"""


def _cells_sql(null: str = "0", where: str = "true") -> str:
    return f"WITH {CELLS.replace('{null}', null)} SELECT slot, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, value FROM cells WHERE {where}"


def _through(spark: SparkSession, sf_dir: str, format: str, name: str, **options: object) -> DataFrame:
    path = fixtures.rich_dataset(spark, sf_dir).write(f"{_scratch(spark)}{name}", format, **options)
    return fixtures.slot_cells(sources.read(spark, path))


@query(_cells_sql("NULL"))
def slots_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "bundle", ".bundle")


@query(_cells_sql())
def slots_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "npy", "-snapshot")


@query(_cells_sql())
def slots_h5ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "h5ad", ".h5ad")


@query(_cells_sql())
def slots_h5ad_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "h5ad", ".h5ad", compression="gzip", chunk_size=3000)


@query(_cells_sql(where="slot NOT LIKE 'varp/%'"))
def slots_h5seurat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "h5seurat", ".h5seurat", compat=True)


@query(_cells_sql(where="slot NOT LIKE 'varp/%'"))
def slots_h5seurat_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "h5seurat", ".h5seurat", packed=True)


@query(_cells_sql(where="slot IN ('X', 'obs/obs_id', 'var/var_id')"))
def slots_bpcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "bpcells", ".bpcells")


@query(_cells_sql(where="slot IN ('X', 'obs/obs_id', 'var/var_id')"))
def slots_bpcells_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "bpcells", ".bpcells", packed=False)


@query(f"WITH {CELLS.replace('{null}', '0')} SELECT slot, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, value FROM cells WHERE slot NOT LIKE 'varp/%' UNION ALL SELECT 'uns/annomat_provenance/n_obs', 0, 0, CAST(n AS VARCHAR) FROM sizes UNION ALL SELECT 'uns/annomat_provenance/n_vars', 0, 0, CAST(m AS VARCHAR) FROM sizes")
def convert_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet to annotated-data file to Seurat-style file to snapshot, by the verb; what each step records of its source is left out but for the shape."""
    at = _scratch(spark)
    start = fixtures.rich_dataset(spark, sf_dir).write(f"{at}.bundle")
    for out in (f"{at}.h5ad", f"{at}.h5seurat"):
        before, start = start, api.convert(spark, start, out, dtype="u32")
        _remove(before)
    last = api.convert(spark, start, f"{at}-snapshot", dtype="u32", format="npy")
    _remove(start)
    return fixtures.slot_cells(api.read(spark, last), ("uns/annomat_provenance/tool", "uns/annomat_provenance/source", "uns/annomat_provenance/source_sha256"))


@query(_cells_sql(where="slot IN ('X', 'obs/status', 'levels/obs/status', 'uns/origin', 'uns/nested/n', 'uns/nested/name')") + " UNION ALL SELECT 'obs/obs_id', CAST(i AS BIGINT), 0, CAST(i AS VARCHAR) FROM o1 UNION ALL SELECT 'var/var_id', CAST(j AS BIGINT), 0, CAST(j AS VARCHAR) FROM p1")
def snapshot_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    start = fixtures.rich_dataset(spark, sf_dir).write(f"{at}.bundle")
    return fixtures.slot_cells(api.read(spark, api.snapshot(spark, start, f"{at}-snapshot", only="X, obs:status, uns")))


@query(_cells_sql(where="slot NOT LIKE 'layers/%' AND slot NOT LIKE 'obsp/%' AND slot NOT LIKE 'uns/%' AND slot NOT IN ('obs/rank', 'var/brand')"))
def snapshot_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    start = fixtures.rich_dataset(spark, sf_dir).write(f"{at}.bundle")
    return fixtures.slot_cells(api.read(spark, api.snapshot(spark, start, f"{at}-snapshot", exclude="layers, obsp, obs:rank, var:brand, uns")))


_FORMS = (("a.bundle", "bundle"), ("a-snapshot", "npy"), ("a.bpcells", "bpcells"), ("a.h5ad", "h5ad"), ("a.h5seurat", "h5seurat"), ("b.dat", "h5ad"), ("c.dat", "h5seurat"))


@query("SELECT t.*, (SELECT count(*) FROM nation) AS n_obs, (SELECT count(*) FROM region) AS n_vars, (SELECT count(*) FROM nation) AS nnz FROM (VALUES " + ", ".join(str(x) for x in _FORMS) + ") AS t(file, format)")
def sniffed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats told by content, two of them in files whose names say nothing."""
    at, data, out = _scratch(spark), fixtures.small_dataset(spark, sf_dir), []
    os.makedirs(at)
    for file, format in _FORMS:
        back = sources.read(spark, data.write(f"{at}/{file}", format))
        out.append((file, sources.detect(f"{at}/{file}"), back.n_obs, back.n_vars, back.x.count()))
    return spark.createDataFrame(out, "file string, format string, n_obs long, n_vars long, nnz long")


_TEXTS = (("500", "==", 500), (">= 1000", ">=", 1000), ("> 0", ">", 0), ("<= 50000", "<=", 50000), ("< 100", "<", 100), (" == 8000 ", "==", 8000), ("about 5", "error", 0), ("-3", "error", 0))


@query("SELECT * FROM (VALUES " + ", ".join(str(x) for x in _TEXTS) + ") AS t(text, op, value)")
def qualifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(text: str) -> tuple[str, str, int]:
        try:
            q = validate.Qualifier.parse(text)
        except InvalidFormatError:
            return text, "error", 0
        return text, q.op, q.value

    return spark.createDataFrame([parsed(t) for t, _, _ in _TEXTS], "text string, op string, value int")


@query("SELECT (SELECT count(*) FROM nation) AS n_obs, (SELECT count(*) FROM region) AS n_vars, true AS source_hash, true AS output_hash, true AS dated, 'https://example.org/x' AS source_url")
def prov_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    start = fixtures.small_dataset(spark, sf_dir).write(f"{at}.h5ad", "h5ad")
    out = api.convert(spark, start, f"{at}.h5seurat", source_url="https://example.org/x")
    with open(f"{out}.prov.json", encoding="utf-8") as f:
        found = json.load(f)
    same = [found["source_sha256"] == provenance.sha256_file(start), found["output_sha256"] == provenance.sha256_file(out), bool(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", found["converted_at"]))]
    return spark.createDataFrame([(found["n_obs"], found["n_vars"], *same, found["source_url"])], "n_obs long, n_vars long, source_hash boolean, output_hash boolean, dated boolean, source_url string")


@query(f"WITH {COO} SELECT i // 1000 * 1000 AS row_offset, count(*) AS nnz, CAST(sum(v) AS BIGINT) AS total FROM coo GROUP BY 1")
def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running profile of X after all files of its Parquet table have arrived as a stream."""
    path, name = f"{_scratch(spark)}.parquet", f"profile_{uuid.uuid4().hex}"
    layout.ordered(fixtures.counts(spark, sf_dir)).write.parquet(path)
    streaming.running_profile(streaming.chunks(spark, path), 1000).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT CAST(d0 AS INTEGER) AS d0, CAST(d1 AS INTEGER) AS d1, CAST(n AS INTEGER) AS n, d0 <> n AND d1 = n AS turned FROM range(1, 6) AS a(d0), range(1, 6) AS b(d1), range(1, 6) AS c(n)")
def transposed_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = range(1, 6)
    return spark.createDataFrame([(x, y, n, layout.stored_transposed(x, y, n)) for x in sizes for y in sizes for n in sizes], "d0 int, d1 int, n int, turned boolean")


#: A patch of every third order and every second part, moved to the base's rows and columns.
_PATCHED = f"""WITH {COO},
o3 AS (SELECT i, CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS q, lead(i) OVER (ORDER BY i) AS after FROM ob WHERE i % 3 = 0), p2 AS (SELECT j, lead(j) OVER (ORDER BY j) AS after FROM va WHERE j % 2 = 0),
cells(slot, a, b, value) AS (
  SELECT 'layers/third', i, j, CAST(v * 100 AS VARCHAR) FROM coo WHERE i % 3 = 0 AND j % 2 = 0
  UNION ALL SELECT 'obs/score', ob.i, 0, CASE WHEN ob.i % 3 = 0 THEN CAST(ob.i * 50 AS VARCHAR) END FROM ob UNION ALL SELECT 'var/chosen', j, 0, CAST(j % 4 = 0 AS VARCHAR) FROM va
  UNION ALL SELECT 'obsm/X_two', i, 0, CAST(i * 100 AS VARCHAR) FROM o3 UNION ALL SELECT 'obsm/X_two', i, 1, '100' FROM o3 UNION ALL SELECT 'varm/PCs', j, 0, CAST(j * 100 AS VARCHAR) FROM p2
  UNION ALL SELECT 'obsp/ring', i, coalesce(after, 0), CAST(i * 100 AS VARCHAR) FROM o3 UNION ALL SELECT 'varp/ring', j, coalesce(after, 0), CAST(j * 100 AS VARCHAR) FROM p2 UNION ALL SELECT 'uns/third/of', 0, 0, '3'
) SELECT slot, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, value FROM cells"""


def _merged(spark: SparkSession, sf_dir: str, policy: str, only: list[str] | None = None) -> AnnotatedMatrix:
    base = fixtures.dataset(spark, sf_dir)
    return merging.merge(merging.merge(base, fixtures.patch_dataset(spark, sf_dir)), fixtures.patch_dataset(spark, sf_dir), policy, only)


def _new_cells(data: AnnotatedMatrix) -> DataFrame:
    """Cells of what the patch brought; a score that rows of the base lack is NaN, here null."""
    data = replace(data, obs=data.obs.withColumn("score", F.when(~F.isnan("score"), F.col("score"))))
    return fixtures.slot_cells(data).where("slot in ('layers/third', 'obs/score', 'var/chosen', 'obsm/X_two', 'varm/PCs', 'obsp/ring', 'varp/ring', 'uns/third/of')")


@query(_PATCHED)
def merge_slots_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch with every kind of slot, merged twice: the second time nothing is new."""
    return _new_cells(_merged(spark, sf_dir, "skip"))


@query(_PATCHED)
def merge_slots_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_cells(_merged(spark, sf_dir, "overwrite"))


@query(_PATCHED.replace("FROM cells", "FROM cells WHERE slot IN ('obsp/ring', 'varm/PCs')"))
def merge_slots_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots of the patch alone."""
    out = merging.merge(fixtures.dataset(spark, sf_dir), fixtures.patch_dataset(spark, sf_dir), only=["obsp/ring", "varm/PCs"])
    return fixtures.slot_cells(out).where("slot like '%/ring' or slot like '%/PCs' or slot like '%/X_two' or slot like '%/third' or slot in ('obs/score', 'var/chosen', 'uns/third/of')")


@query("SELECT 'error' AS policy, 'layers in both: third' AS message")
def merge_slots_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = fixtures.patch_dataset(spark, sf_dir)
    once = merging.merge(fixtures.dataset(spark, sf_dir), patch, only=["layers/third"])
    try:
        merging.merge(once, patch, only=["layers/third"])
        message = "merged"
    except InvalidFormatError as e:
        message = str(e)
    return spark.createDataFrame([("error", message)], "policy string, message string")


# Files laid out by hand: what other programs store


def _nations(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[int, str, int]], list[str]]:
    """The 25 nations (key, name, region) and the 5 regions, which fit any place."""
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()]
    return nations, [r[0] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]


@query("""SELECT 'X' AS slot, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, CAST((n_nationkey + 1) * 100 AS VARCHAR) AS value FROM nation
UNION ALL SELECT 'layers/dense', n_nationkey, n_regionkey, CAST((n_nationkey + 1) * 100 AS VARCHAR) FROM nation
UNION ALL SELECT 'obs/obs_id', n_nationkey, 0, n_name FROM nation UNION ALL SELECT 'obs/region', n_nationkey, 0, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'obs/maybe', n_nationkey, 0, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey * 100 AS VARCHAR) END FROM nation UNION ALL SELECT 'obs/flag', n_nationkey, 0, CAST(n_nationkey % 2 = 1 AS VARCHAR) FROM nation
UNION ALL SELECT 'var/var_id', r_regionkey, 0, r_name FROM region UNION ALL SELECT 'levels/obs/region', r_regionkey, 0, r_name FROM region
UNION ALL SELECT 'obsm/X_t', n_nationkey, k, CAST((n_nationkey + k) * 100 AS VARCHAR) FROM nation, range(2) AS t(k)
UNION ALL SELECT 'obs/odd', 0, 0, 'skipped'""")
def h5ad_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense X and layer, categories, nullable integers, stored booleans, a turned embedding, a column of an unknown type."""
    nations, regions = _nations(spark, sf_dir)
    n, path = len(nations), f"{_scratch(spark)}.h5ad"
    dense = np.zeros((n, len(regions)), "<f4")
    for key, _, region in nations:
        dense[key, region] = key + 1
    with hdf5._h5().File(path, "w") as f:
        f.attrs["encoding-type"] = "anndata"
        f.create_dataset("X", data=dense)
        f.create_dataset("layers/dense", data=dense.astype("<f8"))
        obs, var = f.create_group("obs"), f.create_group("var")
        obs.attrs["_index"], obs.attrs["column-order"] = "name", np.asarray(["region", "maybe", "flag", "odd"], object)
        obs.create_dataset("name", data=np.asarray([x[1] for x in nations], object))
        obs.create_dataset("region/codes", data=np.asarray([x[2] for x in nations], "i1"))
        obs.create_dataset("region/categories", data=np.asarray(regions, object))
        maybe = obs.create_group("maybe")
        maybe.attrs["encoding-type"] = "nullable-integer"
        maybe.create_dataset("values", data=np.arange(n, dtype="<i8"))
        maybe.create_dataset("mask", data=np.arange(n) % 4 == 0)
        obs.create_dataset("flag", data=np.arange(n) % 2 == 1)
        obs.create_dataset("odd", data=np.zeros(n, "<c8"))
        var.attrs["_index"] = "name"
        var.create_dataset("name", data=np.asarray(regions, object))
        f.create_dataset("obsm/X_t", data=np.arange(n)[None, :] + np.arange(2.0)[:, None])
    back = sources.read(spark, path, chunk_size=7)
    skipped = spark.createDataFrame([(x.replace(":", "/"), 0, 0, "skipped") for x in back.skipped], "slot string, a long, b long, value string")
    return fixtures.slot_cells(back).unionByName(skipped)


@query("""SELECT 'X' AS slot, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, CAST((n_nationkey + 1) * 100 AS VARCHAR) AS value FROM nation
UNION ALL SELECT 'obs/obs_id', n_nationkey, 0, n_name FROM nation UNION ALL SELECT 'obs/region', n_nationkey, 0, CAST(n_regionkey * 100 AS VARCHAR) FROM nation
UNION ALL SELECT 'var/var_id', r_regionkey, 0, r_name FROM region UNION ALL SELECT 'obsm/X_u', n_nationkey, 0, CAST(n_nationkey * 100 AS VARCHAR) FROM nation""")
def h5_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The internal layout: X by columns of variables x observations, its dtype in an attribute, numbers stored as doubles."""
    nations, regions = _nations(spark, sf_dir)
    path = f"{_scratch(spark)}.h5"
    with hdf5._h5().File(path, "w") as f:
        f.create_dataset("X/data", data=np.asarray([x[0] + 1.0 for x in nations])).attrs["dtype"] = "uint32"
        f.create_dataset("X/indices", data=np.asarray([x[2] for x in nations], "<i4"))
        f.create_dataset("X/indptr", data=np.arange(len(nations) + 1.0))
        f.create_dataset("X/shape", data=np.asarray([len(regions), len(nations)], "<f8"))
        f.create_dataset("obs/index", data=np.asarray([x[1] for x in nations], object))
        f.create_dataset("obs/region", data=np.asarray([x[2] for x in nations], "<i4"))
        f.create_dataset("var/index", data=np.asarray(regions, object))
        f.create_dataset("obsm/X_u", data=np.asarray([[x[0]] for x in nations], "<f8"))
    back = sources.read(spark, path, chunk_size=7)
    assert (back.format, back.dtype) == ("h5", "u32")
    return fixtures.slot_cells(back)


@query("""SELECT 'X' AS slot, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, CAST((n_nationkey + 1) * 100 AS VARCHAR) AS value FROM nation
UNION ALL SELECT 'layers/data', n_nationkey, n_regionkey, CAST((n_nationkey + 1) * 50 AS VARCHAR) FROM nation
UNION ALL SELECT 'obs/obs_id', n_nationkey, 0, n_name FROM nation UNION ALL SELECT 'obs/region', n_nationkey, 0, CASE WHEN n_regionkey > 0 THEN r_name END FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'obs/known', n_nationkey, 0, CASE n_nationkey % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END FROM nation
UNION ALL SELECT 'var/var_id', r_regionkey, 0, r_name FROM region UNION ALL SELECT 'levels/obs/region', r_regionkey - 1, 0, r_name FROM region WHERE r_regionkey > 0
UNION ALL SELECT 'obsm/X_pca', n_nationkey, k, CAST((n_nationkey + k) * 100 AS VARCHAR) FROM nation, range(2) AS t(k)""")
def h5seurat_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later layout: counts and data below layers, factors from 1 with missing ones, logicals with missing ones, a reduction."""
    nations, regions = _nations(spark, sf_dir)
    n, path = len(nations), f"{_scratch(spark)}.h5seurat"
    with hdf5._h5().File(path, "w") as f:
        f.attrs["active.assay"] = "RNA"
        f.create_dataset("cell.names", data=np.asarray([x[1] for x in nations], object))
        f.create_dataset("assays/RNA/features", data=np.asarray(regions, object))
        for name, scale in (("counts", 1.0), ("data", 0.5)):
            g = f.create_group(f"assays/RNA/layers/{name}")
            g.attrs["dims"] = np.asarray([len(regions), n], "<i4")
            g.create_dataset("data", data=np.asarray([(x[0] + 1) * scale for x in nations]))
            g.create_dataset("indices", data=np.asarray([x[2] for x in nations], "<i4"))
            g.create_dataset("indptr", data=np.arange(n + 1, dtype="<i4"))
        meta = f.create_group("meta.data")
        meta.attrs["logicals"] = np.asarray(["known"], object)
        meta.create_dataset("known", data=np.asarray([x[0] % 3 for x in nations], "<i4"))
        meta.create_dataset("region/levels", data=np.asarray(regions[1:], object))
        meta.create_dataset("region/values", data=np.asarray([x[2] for x in nations], "<i4"))
        f.create_dataset("reductions/PCA/cell.embeddings", data=np.arange(n)[None, :] + np.arange(2.0)[:, None])
    return fixtures.slot_cells(sources.read(spark, path, chunk_size=7))


@query(f"""WITH {COO}, t AS (SELECT (SELECT count(*) FROM ob) AS n, (SELECT count(*) FROM va) AS m, (SELECT count(*) FROM coo) AS z),
l AS (SELECT string_agg(o_orderstatus, ', ' ORDER BY o_orderstatus) || ' (' || count(*) || ' levels)' AS x FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT 'shape' AS slot, '' AS key, n || ' obs x ' || m || ' vars' AS detail FROM t UNION ALL SELECT 'X', '', 'dtype u32' UNION ALL SELECT 'obs', 'status', 'categorical: ' || x FROM l
UNION ALL SELECT * FROM (VALUES ('obs', 'total', 'float'), ('obs', 'urgent', 'bool'), ('obs', 'rank', 'int'), ('var', 'brand', 'string'), ('var', 'size', 'int'), ('uns', 'nested', 'dict(2 keys)'), ('uns', 'origin', 'orders and parts'))
UNION ALL SELECT 'layers', 'price_cents', n || ' x ' || m || ', ' || z || ' stored, f64' FROM t UNION ALL SELECT 'obsm', 'X_pca', n || ' x 3, ' || 3 * n || ' stored, f64' FROM t UNION ALL SELECT 'varm', 'X_pca', m || ' x 2, ' || 2 * m || ' stored, f64' FROM t
UNION ALL SELECT 'obsp', 'knn', n || ' x ' || n || ', ' || n || ' stored, f32' FROM t UNION ALL SELECT 'varp', 'near', m || ' x ' || m || ', ' || m || ' stored, f32' FROM t""")
def inspect_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.described(fixtures.rich_dataset(spark, sf_dir))


@query("SELECT CAST(k AS INTEGER) AS k, CASE WHEN k <= 60 THEN repeat('x', CAST(k AS INTEGER)) ELSE repeat('x', 57) || '...' END AS line FROM range(50, 70) AS t(k) UNION ALL SELECT * FROM (VALUES (1, 'array[3]'), (2, 'dict(1 keys)'), (3, 'null'), (4, 'true'), (5, '2.5'))")
def uns_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = {1: [1, "a", None], 2: {"a": [1]}, 3: None, 4: True, 5: 2.5}
    return spark.createDataFrame([(k, uns.summary("x" * k)) for k in range(50, 70)] + [(k, uns.summary(v)) for k, v in rest.items()], "k int, line string")


# Verbs and errors


@query("SELECT * FROM (VALUES ('convert', 0), ('inspect', 0), ('validate', 0), ('validate --min-obs', 1), ('validate --schema', 1), ('snapshot', 0), ('merge', 0), ('no file', 2)) AS t(verb, code)")
def cli_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line: 0, 1 for a failed validation, 2 for an error."""
    at = _scratch(spark)
    start = fixtures.small_dataset(spark, sf_dir).write(f"{at}.bundle")
    with open(f"{at}.json", "w", encoding="utf-8") as f:
        json.dump({"obs": ">= 1", "layers": ["absent"]}, f)
    asked = {
        "convert": ["convert", start, f"{at}.h5ad"], "inspect": ["inspect", f"{at}.h5ad"], "validate": ["validate", start, "--has-layer", "spliced", "--dtype", "u32"], "validate --min-obs": ["validate", start, "--min-obs", "100", "--json"],
        "validate --schema": ["validate", start, "--schema", f"{at}.json"], "snapshot": ["snapshot", start, f"{at}-snapshot", "--exclude", "layers"], "merge": ["merge", start, f"{at}-2.bundle", "--patch", f"{at}.h5ad:uns/origin", "--tag", "a=b", "--on-conflict", "overwrite"],
        "no file": ["inspect", f"{at}.h5"],
    }
    codes = []
    for name, words in asked.items():
        with contextlib.redirect_stdout(io.StringIO()):
            try:
                codes.append((name, cli.run(spark, cli.parser().parse_args(words))))
            except NotFoundError:
                codes.append((name, 2))
    return spark.createDataFrame(codes, "verb string, code int")


@query("""SELECT 'passed' AS field, 'False' AS value UNION ALL SELECT 'obs', CASE WHEN (SELECT count(*) FROM nation) >= 20 THEN 'pass' ELSE 'fail' END UNION ALL SELECT 'layers', 'fail' UNION ALL SELECT 'x_dtype', 'pass'
UNION ALL SELECT 'obs_index_unique', CASE WHEN (SELECT count(*) = count(DISTINCT n_name) FROM nation) THEN 'pass' ELSE 'fail' END""")
def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as JSON: whether all passed, and each check."""
    schema = validate.Schema.of({"obs": ">= 20", "layers": ["spliced", "absent"], "x_dtype": "u32", "obs_index_unique": True})
    found = json.loads(validate.run(fixtures.small_dataset(spark, sf_dir), schema).json("a", "b"))
    return spark.createDataFrame([("passed", str(found["passed"])), *((c["name"], c["status"]) for c in found["checks"])], "field string, value string")


@query("SELECT * FROM (VALUES ('no file', 'NotFoundError'), ('no format', 'InvalidFormatError'), ('packed version', 'UnsupportedVersionError'), ('array version', 'UnsupportedVersionError'), ('array type', 'DtypeMismatchError'), ('no field', 'MissingFieldError'), ('no layer', 'MissingFieldError'), ('both lists', 'InvalidFormatError'), ('dtype', 'ValueError'), ('qualifier', 'InvalidFormatError')) AS t(what, error)")
def errors_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is raised for inputs that are wrong in one way each."""
    at, data = _scratch(spark), fixtures.small_dataset(spark, sf_dir)
    bundle, snapshot, packed = data.write(f"{at}.bundle"), data.write(f"{at}-a", "npy"), data.write(f"{at}.bpcells", "bpcells")
    seurat = data.write(f"{at}.h5seurat", "h5seurat")
    os.makedirs(f"{at}-empty")
    with open(f"{packed}/version", "w") as f:
        f.write("packed-uint-matrix-v9")
    np.save(f"{at}-8.npy", np.arange(3.0))
    with open(f"{at}-8.npy", "rb") as f, open(f"{at}-9.npy", "wb") as g:
        g.write(f.read().replace(b"NUMPY\x01", b"NUMPY\x02", 1))
    os.remove(f"{snapshot}/meta.json")
    asked: dict[str, Callable[[], object]] = {
        "no file": lambda: api.read(spark, f"{at}.none"), "no format": lambda: api.read(spark, f"{at}-empty"), "packed version": lambda: api.read(spark, packed), "array version": lambda: npy.load(f"{at}-9.npy"), "array type": lambda: npy.load(f"{at}-8.npy", "<f4"),
        "no field": lambda: api.read(spark, snapshot, "npy"), "no layer": lambda: api.read(spark, seurat, layer="absent"), "both lists": lambda: api.snapshot(spark, bundle, f"{at}-b", only="X", exclude="X"), "dtype": lambda: api.convert(spark, bundle, f"{at}-c.bundle", dtype="f16"),
        "qualifier": lambda: validate.Qualifier.parse("about"),
    }
    out = []
    for what, verb in asked.items():
        try:
            verb()
            out.append((what, "none"))
        except (AnnotatedMatrixError, ValueError) as e:
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")

