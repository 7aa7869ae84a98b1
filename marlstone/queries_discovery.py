"""Queries on discovery: parsed queries, exclusions, audited fusion, nomination, the whole pipeline, and probes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import discovery as D
from marlstone.queries_text import _INDEX, _titles, text_bm25, text_idf_overlap, vector_nearest
from marlstone.runtime import staged
from marlstone.tables import table

CONCEPTS = ["光刻", "封装", "硅片", "材料", "设备", "芯片", "产能", "报告"]
EXPANSIONS = {"封装|封测": "引线框架 塑封料", "光刻": "光刻胶 掩膜版"}
EXCLUSIONS = {"trade": "不要.*贸易|不含贸易|排除贸易", "reports": "简介|产品"}
PATTERNS = {"trade": "贸易|经销", "reports": "产能"}


def discovery_specs(spark: SparkSession, d: str) -> DataFrame:
    out = D.query_specs(table(spark, d, "stage3_semiconductor_benchmark"), "query_id", "query", CONCEPTS, EXPANSIONS, EXCLUSIONS)
    return out.select("query", F.array_join("concepts", "|").alias("concepts"), "expanded", F.array_join("exclusions", "|").alias("exclusions"), "least_share")


def _channels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return staged(text_idf_overlap(spark, d), "words"), staged(vector_nearest(spark, d), "meaning")


def _dropped(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    specs = D.query_specs(_titles(spark, d), "query", "title", CONCEPTS, EXPANSIONS, EXCLUSIONS)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.lit(None).cast("double").alias("share"))
    return D.excluded(candidates, specs, docs, PATTERNS).where(F.col("dropped").isNotNull()).select("query", "doc", "dropped")


def discovery_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of either channel that an exclusion of the query drops, and which."""
    words, meaning = _channels(spark, d)
    return _dropped(spark, d, words.select("query", "doc").union(meaning.select("query", "doc")).distinct())


def discovery_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of words and meaning without what is excluded, with ranks and scores in each channel."""
    words, meaning = _channels(spark, d)
    gone = staged(_dropped(spark, d, words.select("query", "doc").union(meaning.select("query", "doc")).distinct()), "dropped")
    return D.fused_with_audit({"words": words, "meaning": meaning}, gone, 10)


def _nominees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words, meaning = _channels(spark, d)
    blend = staged(D.meaning_and_words(meaning, words), "blend")
    docs = table(spark, d, "documents")
    wanted = docs.where((F.col("doc_id") % 50 == 0) & F.col("source").isNotNull()).select(F.col("doc_id").alias("query"), F.col("source").alias("key"))
    members = docs.where(F.col("source").isNotNull()).select(F.col("doc_id").alias("doc"), F.col("source").alias("key"))
    return D.nominated([words, meaning, D.bucket(blend, wanted, members, 6)], 18), blend


def discovery_nominated(spark: SparkSession, d: str) -> DataFrame:
    """Nominees of words, meaning and the query's source, in order of first appearance."""
    return _nominees(spark, d)[0]


def discovery_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Nominees scored by the blend, dropped ones last, and how many match."""
    nominees, blend = _nominees(spark, d)
    nominees = staged(nominees, "nominees")
    return D.discovered(nominees, blend, _dropped(spark, d, nominees.select("query", "doc")), 0.3, 3, 12)


def discovery_targets(spark: SparkSession, d: str) -> DataFrame:
    """Where each stated document stands among the results of its own title."""
    targets = table(spark, d, "documents").where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query"), F.col("doc_id").alias("doc"))
    return D.target_ranks(targets, text_bm25(spark, d))


def discovery_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand anywhere in a company's record."""
    return D.terms_anywhere(table(spark, d, "companies").select("code", "name", "industry", "businessdescription", "concepts"), "code", CONCEPTS)


QUERIES = {f.__name__: f for f in (discovery_specs, discovery_dropped, discovery_audit, discovery_nominated, discovery_pipeline, discovery_targets, discovery_terms)}

_EXPANDED = "concat_ws(' ', coalesce(query, ''), " + ", ".join(f"CASE WHEN regexp_matches(query, '{p}') THEN '{w}' END" for p, w in EXPANSIONS.items()) + ")"
_OUT = "coalesce(concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(query, '{p}') THEN '{n}' END" for n, p in EXCLUSIONS.items()) + "), '')"
_GONE = f"""{_INDEX}, pairs AS (SELECT query, doc FROM overlap UNION SELECT query, doc FROM nearest), t AS (SELECT doc_id AS query, title FROM documents WHERE doc_id % 50 = 0),
gone AS (SELECT query, doc, CASE {' '.join(f"WHEN regexp_matches(t.title, '{EXCLUSIONS[n]}') AND regexp_matches(x.text, '{p}') THEN '{n}'" for n, p in PATTERNS.items())} END AS dropped FROM @of JOIN t USING (query) JOIN documents x ON x.doc_id = doc)"""
_KEPT = "SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {c} ANTI JOIN g USING (query, doc) QUALIFY rank <= 10"
_BLEND = """blend AS (SELECT query, doc, round(coalesce(n.score, 0) + coalesce(o.score, 0) * 0.35::DOUBLE, 9) AS score FROM nearest n FULL JOIN overlap o USING (query, doc)),
own AS (SELECT a.doc_id AS query, b.doc_id AS doc FROM documents a JOIN documents b USING (source) WHERE a.doc_id % 50 = 0),
bucket AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY coalesce(score, 0) + 1e-9 DESC, doc) AS rank FROM own LEFT JOIN blend USING (query, doc) QUALIFY rank <= 6),
ch AS (SELECT query, doc, 0 AS channel, rank FROM overlap UNION ALL SELECT query, doc, 1, rank FROM nearest UNION ALL SELECT query, doc, 2, rank FROM bucket),
fi AS (SELECT query, doc, min((channel, rank)) AS m FROM ch GROUP BY ALL),
nom AS MATERIALIZED (SELECT query, doc, m[1] AS channel, row_number() OVER (PARTITION BY query ORDER BY m, doc) AS place FROM fi QUALIFY place <= 18)"""
SQL = {
    "discovery_specs": "SELECT query_id AS query, coalesce(array_to_string(list_filter([" + ", ".join(f"'{c}'" for c in CONCEPTS) + f"], lambda x: contains(coalesce(query, ''), x)), '|'), '') AS concepts, {_EXPANDED} AS expanded, {_OUT} AS exclusions, try_cast(nullif(regexp_extract(query, '(海外|境外|出口)[^0-9]{{0,8}}([0-9]{{1,3}})\\s*[%％]', 2), '') AS DOUBLE) / 100 AS least_share FROM stage3_semiconductor_benchmark",
    "discovery_dropped": f"WITH {_GONE.replace('@of', 'pairs')} SELECT query, doc, dropped FROM gone WHERE dropped IS NOT NULL",
    "discovery_audit": f"WITH {_GONE.replace('@of', 'pairs')}, g AS (SELECT query, doc FROM gone WHERE dropped IS NOT NULL), a AS ({_KEPT.format(c='overlap')}), b AS ({_KEPT.format(c='nearest')}), f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM a UNION ALL SELECT query, doc, rank FROM b) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 10) SELECT r.query, r.doc, r.score, r.rank, a.rank AS words_rank, a.score AS words_score, b.rank AS meaning_rank, b.score AS meaning_score FROM r LEFT JOIN a USING (query, doc) LEFT JOIN b USING (query, doc)",
    "discovery_nominated": f"WITH {_INDEX}, {_BLEND} SELECT query, doc, channel, place FROM nom",
    "discovery_pipeline": f"WITH {_GONE.replace('@of', 'nom').replace('pairs AS (SELECT query, doc FROM overlap UNION SELECT query, doc FROM nearest)', _BLEND)}, s AS (SELECT nom.query, nom.doc, place, CASE WHEN dropped IS NOT NULL THEN 0.0 ELSE coalesce(score, 0.0) END AS final FROM nom LEFT JOIN blend USING (query, doc) LEFT JOIN gone USING (query, doc)), "
    "m AS (SELECT query, least(12, greatest(least(3, count(*)), count(*) FILTER (final >= 0.3))) AS matches FROM s GROUP BY query) SELECT query, doc, final, row_number() OVER (PARTITION BY query ORDER BY final DESC, place) AS final_rank, matches FROM s JOIN m USING (query)",
    "discovery_targets": f"WITH {_INDEX} SELECT d.doc_id AS query, d.doc_id AS doc, b.rank FROM documents d LEFT JOIN bm25 b ON b.query = d.doc_id AND b.doc = d.doc_id WHERE d.doc_id % 50 = 0",
    "discovery_terms": "SELECT term, count(*) AS n FROM (SELECT to_json({'a': code, 'b': name, 'c': industry, 'd': businessdescription, 'e': concepts})::VARCHAR AS j FROM companies) JOIN (SELECT unnest([" + ", ".join(f"'{c}'" for c in CONCEPTS) + "]) AS term) ON contains(j, term) GROUP BY term",
}
