"""Queries of this subpackage over the test tables by name, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import distinct, packing, pii, tokenize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


KEYS = """keys AS (SELECT (series, list_sort(list_distinct(tags_sorted))) AS key, CAST(DATE '1970-01-01' + CAST(ts // 86400000000000 AS INTEGER) AS DATE) AS day,
 coalesce(nullif(trim(tenant_scope), ''), 'default') AS scope,
 coalesce(list_sort(list_filter(tags_sorted, lambda t: t.k = 'region'))[1].v, '') AS region FROM series_keys)"""


@query
def p1_counts(spark, d):
    c = distinct.counts(distinct.partial(table(spark, d, "series_keys")))
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("calendar_day"), F.col("scope").alias("tenant_scope"), "region", "grouping", "keys")


SQL["p1_counts"] = f"""
WITH {KEYS} SELECT strftime(day, '%Y-%m-%d') AS calendar_day, scope AS tenant_scope, region,
 CAST(7 - grouping(day, scope, region) AS INTEGER) AS grouping, count(DISTINCT key) AS keys FROM keys GROUP BY CUBE (day, scope, region)"""


@query
def p1_weekly(spark, d):
    keys = table(spark, d, "series_keys")
    parts = [distinct.partial(keys.where(F.pmod(F.hash("reg_no"), F.lit(2)) == i)) for i in (0, 1)]
    c = distinct.counts(distinct.merge(*parts), (("day", "scope"), ("day",)), F.trunc("day", "week"))
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("week"), F.col("scope").alias("tenant_scope"), "keys")


SQL["p1_weekly"] = f"""
WITH {KEYS} SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, scope AS tenant_scope, count(DISTINCT key) AS keys
FROM keys GROUP BY GROUPING SETS ((date_trunc('week', day), scope), (date_trunc('week', day)))"""


@query
def p8_ids(spark, d):
    return tokenize.encode(table(spark, d, "documents"), "byte_bpe_50k")


@query
def p9_packed(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_targets"))


@query
def p9_invariants(spark, d):
    """Per target what a packing must keep: every document in it, none split without need, no container overfull, none to spare."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "pack_targets")
    p = packing.pack(docs, targets)
    capacity = F.broadcast(targets.select("target_id", "capacity").distinct())
    used = p.groupBy("target_id", "container_id").agg(F.sum("piece_tokens").alias("used")).join(capacity, "target_id")
    used = used.groupBy("target_id", "capacity").agg(
        F.count(F.when(F.col("used") > F.col("capacity"), 1)).alias("overfull"), (F.count(F.lit(1)) - F.ceil(F.sum("used") / F.col("capacity"))).alias("to_spare")
    )
    whole = p.groupBy("target_id", "doc_id").agg(F.sum("piece_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).join(capacity, "target_id")
    needed = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    whole = whole.groupBy("target_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("n") != needed, 1)).alias("split"))
    return used.join(whole, "target_id").select("target_id", "documents", "split", "overfull", "to_spare")


SQL["p9_invariants"] = """
SELECT DISTINCT target_id, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS overfull,
 CAST(0 AS BIGINT) AS to_spare FROM pack_targets WHERE tokenizer IS NOT NULL AND capacity > 0"""


@query
def p10_found(spark, d):
    return pii.found(table(spark, d, "documents"), table(spark, d, "known_names"), table(spark, d, "items"))


@query
def p10_sanitised(spark, d):
    return pii.sanitised(table(spark, d, "documents"), table(spark, d, "known_names"), table(spark, d, "items"))


@query
def p10_residue(spark, d):
    """What replacement must keep and leave: all documents, null texts as they are, and no plain address of mail or number with its country code."""
    r = pii.sanitised(table(spark, d, "documents"), table(spark, d, "known_names"), table(spark, d, "items"))
    left = lambda pattern, name: F.count(F.when(F.col("text").rlike(pattern), 1)).alias(name)
    return r.agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("text").isNull(), 1)).alias("null_texts"),
        left(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "mail_left"), left(r"\+[1-9][0-9]{0,2} [0-9]{2,4} [0-9]{3,}", "phones_left"),
    )


SQL["p10_residue"] = """SELECT count(*) AS documents, count(*) FILTER (text IS NULL) AS null_texts, CAST(0 AS BIGINT) AS mail_left, CAST(0 AS BIGINT) AS phones_left FROM documents"""
