"""Queries on validators, decisions kept for a while, vocabularies and small checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.codes import denoted_code, denoted_sql
from marlstone.operators import decisions as D
from marlstone.operators import validation as V
from marlstone.queries_text import SQL as TEXT_SQL
from marlstone.queries_text import vector_nearest
from marlstone.tables import table

DIMENSIONS = ["name", "industry", "businessdescription", "board", "swlevel1industry"]


def check_documents(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return V.issues(table(spark, d, "documents"), ["doc_id"], V.document_checks(c("text"), c("n_chars"), c("title"), c("publishedat"), c("fetchedat"), 5_000))


def check_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Companies' filled dimensions as a profile: what is missing, and whether that is exact."""
    rows = table(spark, d, "companies")
    covered = F.array_compact(F.array(*[F.when(F.length(c) > 0, F.lit(c)) for c in DIMENSIONS]))
    rows = rows.select("code", "loadedat", covered.alias("covered"), F.array_compact(F.array(F.when(F.col("swlevel1industry") == "unknown", "swlevel1industry"))).alias("excluded"))
    rows = rows.withColumn("missing", V.complement(DIMENSIONS, F.col("covered")))
    return V.issues(rows, ["code", "loadedat"], V.profile_checks(F.col("covered"), F.col("excluded"), F.array(*[F.lit(x) for x in DIMENSIONS]), F.col("covered"), F.col("missing")))


def check_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage3_semiconductor_benchmark")
    return V.issues(rows, ["query_id"], V.case_checks(F.col("query"), F.col("relevant3.code"), F.col("relevant2.code"), F.col("split"), ["validation", "blind"]))


def check_mean_price(spark: SparkSession, d: str) -> DataFrame:
    """Months of a supplier whose mean price lies outside its range of unit prices, or has no volume."""
    rows = table(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    bars = rows.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.min("unit").alias("low"), F.max("unit").alias("high"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"), F.sum("l_quantity").alias("volume"))
    return bars.where(~F.coalesce(V.mean_price_fits(F.col("low"), F.col("high"), F.col("amount"), F.col("volume")), F.lit(False))).select("l_suppkey", "month")


def check_page_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each stated query's ranked page."""
    rows = vector_nearest(spark, d).withColumn("milli", F.floor(F.col("score") * 1000 + 0.5).cast("long"))
    return V.ordered_hash(rows, "query", "rank", ["rank", "doc", "milli"])


def corpus_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return V.vocabulary(table(spark, d, "companies"), "industry", 250)


def decisions_looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the second half that find a label decided within ninety days on the same company and family."""
    rows = table(spark, d, "v4_2_train_pairs_a").select("pairid", denoted_code(F.col("companycode")).alias("code"), "queryfamily", "label", "createdat")
    now = rows.agg(F.max("createdat").alias("now")).first()["now"]
    taken = rows.where(F.col("pairid") % 2 == 1).select(D.digest_of(["code", "queryfamily"]).alias("key"), F.struct("label", "pairid").alias("decision"), F.struct("createdat", "pairid").alias("o"), F.col("createdat").alias("decided")).where(F.col("decision.label").isNotNull())
    newest = taken.groupBy("key").agg(F.max_by("decision", "o").alias("decision"), F.max("decided").alias("decided"))
    asked = rows.where(F.col("pairid") % 2 == 0).select("pairid", "code", "queryfamily")
    out = D.looked_up(asked, newest, ["code", "queryfamily"], F.lit(now), 90 * 86_400)
    return out.select("pairid", "known", F.col("decision.label").alias("label"))


QUERIES = {f.__name__: f for f in (check_documents, check_profiles, check_cases, check_mean_price, check_page_hashes, corpus_vocabulary, decisions_looked_up)}

_union = lambda rows, keys, checks: " UNION ALL ".join(f"SELECT {keys}, '{n}' AS issue FROM {rows} WHERE {c}" for n, c in checks.items())
_FILLED = "list_filter([" + ", ".join(f"CASE WHEN length({c}) > 0 THEN '{c}' END" for c in DIMENSIONS) + "], lambda x: x IS NOT NULL)"
SQL = {
    "check_documents": _union("documents", "doc_id", {"no_text": "text IS NULL OR trim(text, ' ') = ''", "too_long": "length(text) > 5000", "length_differs": "length(text) <> n_chars", "no_title": "title IS NULL OR trim(title, ' ') = ''", "title_is_text": "title = text", "no_date": "publishedat IS NULL", "fetched_before_published": "fetchedat < publishedat"}),
    "check_profiles": f"WITH p AS (SELECT code, loadedat, {_FILLED} AS c, swlevel1industry = 'unknown' AS x FROM companies) " + _union("p", "code, loadedat", {"contradiction": "coalesce(x, false) AND list_contains(c, 'swlevel1industry')", "no_label": "len(c) = 0"}),
    "check_cases": _union("stage3_semiconductor_benchmark", "query_id", {"no_query": "query IS NULL OR trim(query, ' ') = ''", "no_relevant": "coalesce(len(relevant3), 0) = 0", "in_two_grades": "list_has_any(list_transform(relevant3, lambda s: s.code), list_transform(relevant2, lambda s: s.code))", "repeated": "len(list_distinct(list_transform(relevant3, lambda s: s.code))) < len(relevant3)", "unknown_split": "split NOT IN ('validation', 'blind')"}),
    "check_mean_price": "WITH b AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, sum(l_extendedprice * (1 - l_discount)) AS amount, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL) SELECT l_suppkey, month FROM b WHERE NOT coalesce(amount / nullif(volume, 0) >= low * 0.99::DOUBLE AND amount / nullif(volume, 0) <= high * 1.01::DOUBLE, false)",
    "check_page_hashes": f"WITH n AS ({TEXT_SQL['vector_nearest']}) SELECT query, substr(sha256(string_agg(rank::VARCHAR || ',' || doc::VARCHAR || ',' || floor(score * 1000 + 0.5)::BIGINT::VARCHAR, ';' ORDER BY rank)), 1, 16) AS hash FROM n GROUP BY query",
    "corpus_vocabulary": "SELECT industry AS value, count(*) AS n FROM companies WHERE industry IS NOT NULL AND trim(industry, ' ') <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 250",
    "decisions_looked_up": f"WITH p AS (SELECT pairid, {denoted_sql('companycode')} AS code, queryfamily, label, createdat FROM v4_2_train_pairs_a), t AS (SELECT code, queryfamily, arg_max(label, (createdat, pairid)) AS label, max(createdat) AS decided FROM p WHERE pairid % 2 = 1 AND label IS NOT NULL GROUP BY ALL), n AS (SELECT max(createdat) AS now FROM p) "
    "SELECT p.pairid, t.label IS NOT NULL AS known, t.label FROM p LEFT JOIN (SELECT t.* FROM t, n WHERE decided BETWEEN now - INTERVAL 90 DAY AND now) t ON p.code IS NOT DISTINCT FROM t.code AND p.queryfamily IS NOT DISTINCT FROM t.queryfamily WHERE p.pairid % 2 = 0",
}
