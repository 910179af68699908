"""URL filters: fixed host and path rules, and for the rest a path-template tree learned for each host.

The tree is grown level by level with DataFrame operations, until all paths end or no node has urls enough for a branch. At a
node, segments that look like numbers or ids, and segments of fewer than ``LEAST`` urls, become wildcards. All others are
branches, however many; the largest takes those that are statistically like it (in the labelled block and allow shares and in how
many urls end or go on with a number, each within 1.96 standard errors), then the largest left does, until each is merged or
leads. Branches of equal counts are merged first, so a node is as large as its number of different counts.

The rules' verdicts are the labels. A template is rejected if the smoothed purity of its labels reaches the limit: the blocked
share, where an even prior of ``PRIOR`` urls and each unlabelled url, as a ``DOUBT`` of an allowed one, count as well. So a few
blocked urls among many unlabelled ones reject nothing, and unlabelled urls follow a template that is blocked almost throughout.

No stage is dealt by host or template but sums that are pre-aggregated: a level's branches, and the rejected templates, are
copied to the urls if they are few, and else joined with each key dealt to ``SALTS`` parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small

#: (verdict, rule): a rule is a host, and a path that starts at its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Purity from which a template is rejected, weights of the even prior and of an unlabelled url, urls of a branch.
PURITY, PRIOR, DOUBT, LEAST = 0.8, 2.0, 0.1, 5
#: Rows of branches or templates (a few short strings each) that are copied to every executor at most; parts of a key beyond.
LOCAL_ROWS, SALTS = 50_000, 16
_VARIABLE = r"^(?:[0-9]+(?:[-_.][0-9]+)*(?:\.[A-Za-z]+)?|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,36}|[^A-Za-z]*[0-9][^A-Za-z]*|.{33,})$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, char_length(substring_index(url, '://', 1)) + 4)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. The rules are a short list held in the plan."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        own, _, rest = r.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


_COUNTS = ("n", "block", "allow", "leaf", "number")


def _like(a: Column, b: Column) -> Column:
    """Whether no share of two branches differs by more than 1.96 standard errors of their pool."""
    n, m, alike = a["n"], b["n"], F.lit(True)
    for c in _COUNTS[1:]:
        pool = (a[c] + b[c]) / (n + m)
        alike = alike & (F.abs(a[c] / n - b[c] / m) <= 1.96 * F.sqrt(pool * (1 - pool) * (1 / n + 1 / m)) + 1e-9)
    return alike


def merged(branches: DataFrame) -> DataFrame:
    """``branches`` (host, template, _s and counts) with the branch ``_b`` that each is merged with, itself if none."""
    node = ["host", "template"]
    kinds = branches.groupBy(*node, *_COUNTS).agg(F.min("_s").alias("_s"))
    nodes = kinds.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "_s", *_COUNTS))).alias("_kinds"))
    lead = F.aggregate("_kinds", F.slice("_kinds", 1, 0), lambda led, k: F.when(F.exists(led, lambda x: _like(x, k)), led).otherwise(F.concat(led, F.array(k))))
    named = F.transform("_kinds", lambda k: F.struct(*[k[c].alias(c) for c in _COUNTS], F.get(F.filter("_led", lambda x: _like(x, k)), F.lit(0))["_s"].alias("_b")))
    found = nodes.withColumn("_led", lead).select(*node, F.inline(named))
    return branches.join(found, [*node, *_COUNTS])


def _met(rows: DataFrame, table: DataFrame, keys: list[str], local: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each of the keys once, or nulls; a hot key is no single task's."""
    table = checkpoint(table)
    if (few := small(table, local)) is not None:
        return rows.join(few, keys, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def grown(rows: DataFrame, local: int = LOCAL_ROWS) -> DataFrame:
    """``rows`` (page_id, host, path, block, allow, ...) with the template of each path."""
    names = rows.columns
    cut = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = checkpoint(rows.withColumn("_segments", cut).withColumn("template", F.lit("")))
    done, level = rows.where(F.size("_segments") == 0), 0
    rows = rows.where(F.size("_segments") > 0)
    while True:
        level += 1
        segment, after = F.get("_segments", F.lit(level - 1)), F.get("_segments", F.lit(level))
        rows = rows.withColumn("_s", F.when(segment.rlike(_VARIABLE), F.lit("*")).otherwise(segment))
        counts = checkpoint(rows.groupBy("host", "template", "_s").agg(
            F.count("*").alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow"),
            F.sum(after.isNull().cast("long")).alias("leaf"), F.coalesce(F.sum(after.rlike(_VARIABLE).cast("long")), F.lit(0)).alias("number"),
        ))
        branches = merged(counts.where((F.col("n") >= LEAST) & (F.col("_s") != "*"))).select("host", "template", "_s", "_b")
        named = _met(rows, branches, ["host", "template", "_s"], local)
        rows = checkpoint(named.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("_b", F.lit("*")))).drop("_b", "_s"))
        done = done.unionByName(rows.where(F.size("_segments") == level))
        rows = rows.where(F.size("_segments") > level)
        # Without a node of LEAST urls, all that follows is wildcards.
        if not rows.groupBy("host", "template").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).take(1):
            rest = rows.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.size("_segments") - level)))
            return done.unionByName(rest).select(*names, "template")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", local: int = LOCAL_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row.

    The verdict is the longest rule's, else ``block`` for urls of a rejected template, else ``allow``. A null url or one
    without ``://`` has empty host and path and is allowed. Repeated rows are all returned and count as often.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_verdict": verdict})
    is_ = lambda v: F.coalesce((F.col("_verdict") == v).cast("long"), F.lit(0))
    tree = grown(rows.withColumns({"block": is_("block"), "allow": is_("allow")}), local)
    known = F.sum("block") + F.sum("allow")
    purity = (F.sum("block") + PRIOR / 2) / (known + DOUBT * (F.count("*") - known) + PRIOR)
    rejected = tree.groupBy("host", "template").agg((purity >= PURITY).alias("_rejected")).where("_rejected")
    out = _met(tree, rejected, ["host", "template"], local)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_rejected"), F.lit("block")), F.lit("allow")).alias("verdict"), "template")
