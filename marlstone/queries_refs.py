"""Queries on orphan references (problem 2) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.codes import denoted_code, denoted_sql, is_blank
from marlstone.operators.references import orphans
from marlstone.tables import table


def _orphans(spark: SparkSession, d: str, name: str, at: str, keep: list[str]) -> DataFrame:
    refs = table(spark, d, name).where(F.col("companycode").isNotNull() & ~is_blank(F.col("companycode")))
    refs = refs.select(*keep, at, denoted_code(F.col("companycode")).alias("code"))
    pool = table(spark, d, "companies").select("code", "loadedat", "removedat")
    return orphans(refs, pool, "code", at, "code", "loadedat", "removedat")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose denoted code is not in the pool at retrievedat."""
    return _orphans(spark, d, "facts", "retrievedat", ["ingestid"]).select("ingestid").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans, and distinct missing codes, per table and month of its time."""
    out = None
    for name, at, key in (("facts", "retrievedat", "ingestid"), ("v4_2_train_pairs_a", "createdat", "pairid"), ("documents", "publishedat", "doc_id")):
        one = _orphans(spark, d, name, at, [key]).groupBy("orphan_period").agg(F.count("*").alias("orphans"), F.countDistinct("code").alias("missing_codes"))
        one = one.select(F.lit(name).alias("table_name"), F.col("orphan_period").alias("period"), "orphans", "missing_codes")
        out = one if out is None else out.unionByName(one)
    return out


def _sql(name: str, at: str, select: str) -> str:
    code = denoted_sql("companycode")
    return (
        f"SELECT {select} FROM (SELECT *, {code} AS code FROM {name} WHERE companycode IS NOT NULL) r WHERE r.code <> '' AND NOT EXISTS "
        f"(SELECT 1 FROM companies c WHERE c.code = r.code AND c.loadedat <= r.{at} AND (c.removedat IS NULL OR r.{at} < c.removedat))"
    )


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _sql("facts", "retrievedat", "r.ingestid"),
    "p2_report": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, period, count(*) AS orphans, count(DISTINCT code) AS missing_codes FROM ("
        + _sql(n, at, f"strftime(r.{at}, '%Y-%m') AS period, r.code")
        + ") GROUP BY period"
        for n, at in (("facts", "retrievedat"), ("v4_2_train_pairs_a", "createdat"), ("documents", "publishedat"))
    ),
}
