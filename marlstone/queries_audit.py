"""Queries that check incoming data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.codes import denoted_code, denoted_sql
from marlstone.operators import audit
from marlstone.tables import table

def _status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "v4_2_train_pairs_a").select("pairid", "query", "label", "companycode", "evidence", "queryfamily")
    rules = [
        ("NO_QUERY", F.col("query").isNull() | (F.trim("query") == "")),
        ("NO_COMPANY", F.col("companycode").isNull()),
        ("NO_LABEL", F.col("label").isNull()),
        ("LABEL_RANGE", ~F.col("label").between(0, 3)),
        ("NO_EVIDENCE", F.col("evidence").isNull()),
        ("SHORT_QUERY", F.length("query") < 4),
    ]
    return audit.classified(rows, rules).groupBy("status").agg(F.count("*").alias("n"))


def audit_status(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs by the first thing that is wrong with them."""
    return _status(spark, d)


def audit_publishable(spark: SparkSession, d: str) -> DataFrame:
    return audit.publishable(_status(spark, d), ["VALID", "NO_EVIDENCE"], 0.9)


def audit_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Orders against the sums of their lines."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("o_totalprice"), F.min("l_shipdate").alias("first"))
    orders = table(spark, d, "orders")
    a = orders.select("o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"))
    b = sums.select("o_orderkey", "o_totalprice", F.datediff("first", F.lit("1970-01-01")).alias("day"))
    return audit.coherence(a, b, "o_orderkey", {"o_totalprice": 50000.0, "day": 30.0})


def audit_broken_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of parts from lines, of which those with a returned line have a close above the high."""
    lines = table(spark, d, "lineitem")
    bars = lines.groupBy(F.col("l_partkey").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(
        F.min("l_extendedprice").alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))).alias("close"), F.sum("l_quantity").alias("volume"),
    )
    return audit.broken_bars(bars, "entity", "day").select("entity", F.col("day").cast("string").alias("day"))


def audit_latest_period(spark: SparkSession, d: str) -> DataFrame:
    """Each company's facts of its latest date, five at most."""
    rows = table(spark, d, "facts").select("ingestid", denoted_code(F.col("companycode")).alias("code"), F.col("source.asof").alias("asof")).where(F.col("code").isNotNull())
    return audit.latest_period(rows, "code", "asof", [F.col("ingestid").desc()], 5)


def audit_merged(spark: SparkSession, d: str) -> DataFrame:
    """Loads of a company merged: all its concepts, and the name of the last load."""
    out = audit.merged(table(spark, d, "companies"), ["code"], ["concepts"], {"name": "loadedat"})
    return out.select("code", F.array_join("concepts", "|").alias("concepts"), "name")


def audit_overlaid(spark: SparkSession, d: str) -> DataFrame:
    """Companies' first names and industries under those of their last load."""
    rows = table(spark, d, "companies")
    base = rows.groupBy("code").agg(F.min_by("name", "loadedat").alias("name"), F.min_by("industry", "loadedat").alias("industry"))
    over = rows.where(F.col("removedat").isNull()).groupBy("code").agg(F.max_by("name", "loadedat").alias("name"))
    return audit.overlaid(base, over, "code", ["name"])


QUERIES = {f.__name__: f for f in (audit_status, audit_publishable, audit_coherence, audit_broken_bars, audit_latest_period, audit_merged, audit_overlaid)}

_STATUS = """SELECT status, count(*) AS n FROM (SELECT CASE WHEN query IS NULL OR trim(query) = '' THEN 'NO_QUERY' WHEN companycode IS NULL THEN 'NO_COMPANY' WHEN label IS NULL THEN 'NO_LABEL'
WHEN label NOT BETWEEN 0 AND 3 THEN 'LABEL_RANGE' WHEN evidence IS NULL THEN 'NO_EVIDENCE' WHEN length(query) < 4 THEN 'SHORT_QUERY' ELSE 'VALID' END AS status FROM v4_2_train_pairs_a) GROUP BY status"""
SQL = {
    "audit_status": _STATUS,
    "audit_publishable": f"SELECT r AS rows, floor(g / r * 100000 + 0.5) / 100000 AS coverage, g >= r * 0.9 AS publishable FROM (SELECT sum(n)::BIGINT AS r, sum(n) FILTER (status IN ('VALID', 'NO_EVIDENCE'))::BIGINT AS g FROM ({_STATUS}))",
    "audit_coherence": """WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS p, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1), j AS (SELECT abs(o_totalprice - p) <= 50000 AS a, abs(date_diff('day', d, o_orderdate::DATE)) <= 30 AS b FROM orders JOIN s ON k = o_orderkey)
SELECT 'o_totalprice' AS field, count(a) AS compared, count(*) FILTER (a) AS matched, floor(matched / compared * 100000 + 0.5) / 100000 AS rate FROM j UNION ALL SELECT 'day', count(b), count(*) FILTER (b), floor(count(*) FILTER (b) / count(b) * 100000 + 0.5) / 100000 FROM j""",
    "audit_broken_bars": "SELECT entity, day::VARCHAR AS day FROM (SELECT l_partkey AS entity, l_shipdate::DATE AS day, max(l_extendedprice) AS high, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice + 1 ELSE l_extendedprice END) AS close FROM lineitem GROUP BY ALL) WHERE high < close",
    "audit_latest_period": f"SELECT ingestid, code, dated AS \"asof\" FROM (SELECT ingestid, {denoted_sql('companycode')} AS code, source.\"asof\" AS dated FROM facts WHERE companycode IS NOT NULL) QUALIFY dated = max(dated) OVER (PARTITION BY code) AND row_number() OVER (PARTITION BY code ORDER BY dated DESC NULLS LAST, ingestid DESC) <= 5",
    "audit_merged": "SELECT code, coalesce(string_agg(DISTINCT c, '|' ORDER BY c), '') AS concepts, any_value(n) AS name FROM (SELECT code, unnest(CASE WHEN len(concepts) > 0 THEN concepts ELSE [NULL] END) AS c FROM companies) JOIN (SELECT code, arg_max(name, loadedat) AS n FROM companies GROUP BY code) USING (code) GROUP BY code",
    "audit_overlaid": "SELECT code, coalesce(l.name, b.name) AS name, industry FROM (SELECT code, arg_min(name, loadedat) AS name, arg_min(industry, loadedat) AS industry FROM companies GROUP BY code) b LEFT JOIN (SELECT code, arg_max(name, loadedat) AS name FROM companies WHERE removedat IS NULL GROUP BY code) l USING (code)",
}
