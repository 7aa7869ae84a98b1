"""Queries on text and vectors: retrieval, fusion, corpus building, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions.codes import denoted_code, denoted_sql
from marlstone.operators import corpus, extract, retrieval
from marlstone.tables import table

#: Rules as (dimension, label, pattern, pattern that vetoes).
RULES = [
    ("process", "capacity", "产能由每年[0-9]+吨", None),
    ("trade", "export", "境外销售占比", "同比减少"),
    ("risk", "concentration", "前五名客户合计销售", None),
    ("finance", "margin", "毛利率为[0-9.]+%", "计提跌价准备"),
    ("research", "patents", "新增授权专利[0-9]+项", None),
]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries: titles of the documents whose id 50 divides."""
    return table(spark, d, "documents").where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query"), "title")


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = C.lex_tokens(F.col("query"))
    return table(spark, d, "stage3_semiconductor_benchmark").select("query_id", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n"))


def text_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents of each title by BM25."""
    return retrieval.bm25(_docs(spark, d), _titles(spark, d), "doc_id", "text", "query", "title", 10)


def text_idf_overlap(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.idf_overlap(_docs(spark, d), _titles(spark, d), "doc_id", "text", "query", "title", 10)


def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest rows of every vector whose id 50 divides, against all rows."""
    rows = table(spark, d, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))
    return retrieval.nearest(rows, asked, "vec_id", "embedding", "query", "asked", 10)


def fused_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion([vector_nearest(spark, d), text_bm25(spark, d)], 15)


def fused_blend(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.blended(vector_nearest(spark, d), text_idf_overlap(spark, d))


def fused_constraints(spark: SparkSession, d: str) -> DataFrame:
    """BM25 results by source under constraints: another source than the annual reports' counts nothing."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("place"), F.col("n_chars").alias("size"), "lang")
    scored = text_bm25(spark, d).withColumn("score", F.col("score") / 100).join(docs, "doc")
    out = retrieval.constrained(scored, "filing_annual_report", F.col("lang") == "en")
    return out.select("query", "doc", F.round("final", 6).alias("final"), "final_rank")


def fused_match_count(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.match_count(fused_constraints(spark, d), 0.1, 3, 8)


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies")


def corpus_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_frequency(_companies(spark, d), "code", "concepts")


def corpus_gate(spark: SparkSession, d: str) -> DataFrame:
    return corpus.gate(_companies(spark, d), "code", "concepts", 0.05).select(F.col("doc").alias("code"), "term")


def corpus_rule_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.rule_tags(table(spark, d, "facts").select("ingestid", "rawtext"), "rawtext", RULES)
    return rows.select("ingestid", F.explode("tags").alias("t")).select("ingestid", "t.dimension", "t.label", "t.evidence")


def corpus_newest_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "facts").select("ingestid", denoted_code(F.col("companycode")).alias("code"), F.col("source.asof").alias("asof")).where(F.col("code").isNotNull())
    return corpus.newest_first(rows, "code", "asof", "ingestid", 3).select("code", "ingestid", "position")


def corpus_evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "facts").select("ingestid", "rawtext", denoted_code(F.col("companycode")).alias("code"), F.col("source.asof").alias("asof"))
    return corpus.evidence_spans(rows, "code", "rawtext", "asof", "ingestid")


def corpus_fact_issues(spark: SparkSession, d: str) -> DataFrame:
    return corpus.facts_issues(table(spark, d, "facts"), _companies(spark, d))


def corpus_changes(spark: SparkSession, d: str) -> DataFrame:
    """Fields that differ between the first and the last load of a company."""
    rows = _companies(spark, d)
    fields = ["name", "industry", "board", "marketcap", "swlevel1industry"]
    first = rows.groupBy("code").agg(*[F.min_by(F.struct(F.col(f)), "loadedat")[f].alias(f) for f in fields])
    last = rows.where(F.col("removedat").isNull()).groupBy("code").agg(*[F.max_by(F.struct(F.col(f)), "loadedat")[f].alias(f) for f in fields])
    return corpus.changes(first, last, "code", fields)


def corpus_coverage(spark: SparkSession, d: str) -> DataFrame:
    return corpus.coverage(
        _companies(spark, d),
        {
            "with_description": F.length("businessdescription") > 0,
            "with_products": F.size("mainproducts") > 0,
            "with_concepts": F.size("concepts") > 0,
            "with_province": F.col("region.province").isNotNull(),
            "unknown_industry": F.col("swlevel1industry") == "unknown",
        },
    )


def corpus_duplicate_triples(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of the same fact text for the same company more than once."""
    rows = table(spark, d, "facts").where(F.col("companycode").isNotNull())
    return rows.groupBy("companycode", "facttype", F.sha2("rawtext", 256).alias("digest")).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def text_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows around the first trigger, snapped to sentence ends, and its snippet."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.call_function("locate", F.lit("产能"), F.col("text")).alias("at")).where(F.col("at") > 0)
    return rows.select("doc_id", "at", C.snap_window(F.col("text"), F.col("at"), F.lit(2)).alias("window"), C.snippet(F.col("text"), F.lit("产能")).alias("snippet"))


def text_signals(spark: SparkSession, d: str) -> DataFrame:
    """Hash, Han share, and how many of four terms it has."""
    f = table(spark, d, "facts")
    return f.select(
        "ingestid",
        C.short_hash(F.col("rawtext")).alias("hash16"),
        F.round(C.han_ratio(F.col("rawtext")), 6).alias("han_ratio"),
        F.size(C.term_hits(F.col("rawtext"), F.array(*[F.lit(x) for x in ("产线", "专利", "客户", "毛利率")]))).alias("hits"),
    )


TRIGGERS = {"capacity": "产能", "share": "市场份额", "patent": "授权专利"}
REJECTS = {"forecast": "预计", "decline": "同比减少"}


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return extract.trigger_windows(_docs(spark, d), "doc_id", "text", TRIGGERS, REJECTS)


def extract_windows(spark: SparkSession, d: str) -> DataFrame:
    """Accepted windows of each document, at most six."""
    return extract.chosen_windows(_windows(spark, d)).select(F.col("entity").alias("doc_id"), F.array_join("windows", "|").alias("windows"))


def extract_trigger_counts(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).groupBy(F.col("entity").alias("doc_id"), "category").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def extract_cell_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every fact, read as a cell of a table."""
    cells = table(spark, d, "facts").select("ingestid", "rawtext")
    return cells.select("ingestid", F.array_join(extract.terms_of(F.col("rawtext")), "|").alias("terms"), extract.cell_term(F.col("rawtext")).alias("cell_term"))


def extract_field_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _companies(spark, d).groupBy("code").agg(F.max_by(F.struct("businessdescription", "industry", "name"), "loadedat").alias("c")).select("code", "c.*")
    return extract.field_hits(rows, "code", ["businessdescription", "industry", "name"], ["材料", "设备", "电子"]).withColumnRenamed("key", "code")


def extract_context(spark: SparkSession, d: str) -> DataFrame:
    return extract.in_context(_docs(spark, d), "doc_id", "text", "产能").withColumnRenamed("key", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        text_tokens, text_bm25, text_idf_overlap, vector_nearest, fused_rrf, fused_blend, fused_constraints, fused_match_count, corpus_document_frequency, corpus_gate, corpus_rule_tags,
        corpus_newest_facts, corpus_evidence_spans, corpus_fact_issues, corpus_changes, corpus_coverage, corpus_duplicate_triples, text_windows, text_signals, extract_windows, extract_trigger_counts,
        extract_cell_terms, extract_field_hits, extract_context,
    )
}


def _tokens_sql(table_: str, key: str, x: str, where: str = "true") -> str:
    """key, tokens of a table; the Han characters are extracted once a row."""
    return (
        f"(SELECT k, list_concat(list_concat(w, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])), c) AS tokens FROM "
        f"(SELECT {key} AS k, regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+') AS w, regexp_extract_all(lower(coalesce({x}, '')), '[\\x{{3400}}-\\x{{9fff}}]') AS c FROM {table_} WHERE {where}))"
    )


_INDEX = f"""docs AS MATERIALIZED (SELECT k AS doc, tokens FROM {_tokens_sql('documents', 'doc_id', 'text')}),
tot AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_size FROM docs),
tf AS (SELECT doc, size, term, count(*) AS tf FROM (SELECT doc, len(tokens) AS size, unnest(tokens) AS term FROM docs) GROUP BY ALL),
q AS (SELECT DISTINCT query, term FROM (SELECT k AS query, unnest(tokens) AS term FROM {_tokens_sql('documents', 'doc_id', 'title', 'doc_id % 50 = 0')})),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * size / mean_size))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), tot GROUP BY query, doc),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 10),
w AS (SELECT query, term, CASE WHEN df IS NULL THEN ln(n + 1) ELSE ln((n + 1) / (df + 0.5)) END AS w FROM q LEFT JOIN df USING (term), tot),
whole AS (SELECT query, sum(w) AS total FROM w GROUP BY query),
ov AS (SELECT query, doc, round(sum(w) / any_value(total), 6) AS score FROM w JOIN tf USING (term) JOIN whole USING (query) GROUP BY query, doc),
overlap AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ov WHERE score > 0 QUALIFY rank <= 10),
near AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM near QUALIFY rank <= 10),
fin AS (SELECT query, b.doc, CASE WHEN lang = 'en' THEN 0.0 WHEN source IS NULL OR source = '' THEN score / 100 * 0.35 WHEN source <> 'filing_annual_report' THEN 0.0 ELSE score / 100 END AS final, n_chars, rank FROM bm25 b JOIN documents d ON d.doc_id = b.doc),
con AS (SELECT query, doc, round(final, 6) AS final, row_number() OVER (PARTITION BY query ORDER BY floor(final * 100 + 0.5) DESC, coalesce(n_chars, 0) DESC, rank) AS final_rank FROM fin)"""
_CODE = denoted_sql("companycode")

_FIELDS = ("name", "industry", "board", "marketcap", "swlevel1industry")
#: One row a character: its bracket depth, floored at 0, is the running sum less its least so far; terms are what stands between separators at depth 0.
_CELLS = """ch AS (SELECT ingestid, i, substr(t, i::INT, 1) AS c FROM (SELECT ingestid, rawtext || '、' AS t, unnest(range(1, length(rawtext) + 2)) AS i FROM facts WHERE rawtext IS NOT NULL)),
st AS (SELECT *, sum(CASE WHEN c IN ('（', '(', '[', '【') THEN 1 WHEN c IN ('）', ')', ']', '】') THEN -1 ELSE 0 END) OVER (PARTITION BY ingestid ORDER BY i) AS s FROM ch),
dp AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY ingestid ORDER BY i)) AS depth FROM st),
cu AS (SELECT *, (depth = 0 AND c IN ('、', '，', ',', '；', ';', '/', '|', chr(10))) AS cut FROM dp),
pa AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY ingestid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cu),
te AS (SELECT ingestid, part, trim(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT cut), ''), chr(10) || chr(9) || chr(13) || ' 　') AS term FROM pa GROUP BY ALL),
ok AS (SELECT ingestid, term, min(part) AS part FROM te WHERE length(term) BETWEEN 2 AND 24 AND NOT regexp_full_match(term, '其[他它].*|合计|小计') GROUP BY ALL)"""
_CELL_TERM = "CASE WHEN length(t) >= 2 AND NOT regexp_matches(t, '^其[他它]') THEN t END"
_TAIL = "trim(regexp_extract(b, '([^\\-－—]*)$', 1), ' ')"
#: The window around the first trigger, step by step as columns.
_SNAPPED = """w1 AS (SELECT doc_id, text, strpos(text, '产能') AS pos, greatest(1, strpos(text, '产能') - 60) AS l, least(length(text), strpos(text, '产能') + 101) AS r FROM documents WHERE contains(text, '产能')),
w2 AS (SELECT *, substr(text, greatest(1, l - 40), l - greatest(1, l - 40)) AS ahead, substr(text, r + 1, 40) AS behind FROM w1),
w3 AS (SELECT *, length(regexp_extract(ahead, '([^。！？；]*)$', 1)) AS tail, length(regexp_extract(behind, '^([^。！？；]*[。！？；])', 1)) AS stop FROM w2),
w4 AS (SELECT *, CASE WHEN length(ahead) > tail THEN l - tail WHEN l - 40 <= 1 THEN 1 ELSE l END AS b, CASE WHEN stop > 0 THEN r + stop WHEN r + 40 >= length(text) THEN length(text) ELSE r END AS e FROM w3),
f1 AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM documents), f2 AS (SELECT *, strpos(flat, '产能') AS p FROM f1 WHERE contains(flat, '产能')),
f3 AS (SELECT *, greatest(1, p - 16) AS s, least(length(flat), p + 17) AS z FROM f2)"""

SQL = {
    "extract_cell_terms": f"WITH {_CELLS}, ag AS (SELECT ingestid, string_agg(term, '|' ORDER BY part) AS terms FROM ok GROUP BY ingestid), b AS (SELECT ingestid, rawtext, regexp_replace(trim(rawtext, ' '), '^其中[:：]', '') AS b FROM facts), "
    f"t AS (SELECT ingestid, rawtext, CASE WHEN {_TAIL} = '' THEN trim(regexp_extract(b, '^([^\\-－—]*)', 1), ' ') ELSE {_TAIL} END AS t FROM b) SELECT t.ingestid, coalesce(terms, '') AS terms, {_CELL_TERM} AS cell_term FROM t LEFT JOIN ag USING (ingestid)",
    "extract_context": "SELECT doc_id, n, substr(text, greatest(0, pos - 90) + 1, pos - greatest(0, pos - 90) + 2 + 170) AS quote FROM (SELECT doc_id, text, unnest(range(0, least(4, len(spots)))) AS n, unnest(spots[1:4]) AS pos FROM (SELECT doc_id, text, list_transform(list_filter(range(1, length(text)), lambda i: substr(text, i::INT, 2) = '产能'), lambda i: i - 1) AS spots FROM documents WHERE contains(text, '产能')))",
    "text_windows": f"WITH {_SNAPPED} SELECT w4.doc_id, pos AS \"at\", substr(text, b, e - b + 1) AS \"window\", CASE WHEN s > 1 THEN '…' ELSE '' END || substr(flat, s, z - s + 1) || CASE WHEN z < length(flat) THEN '…' ELSE '' END AS snippet FROM w4 JOIN f3 USING (doc_id)",
    "corpus_changes": "WITH f AS (SELECT code, " + ", ".join(f"arg_min_null({c}, loadedat) AS {c}" for c in _FIELDS) + " FROM companies GROUP BY code), l AS (SELECT code, " + ", ".join(f"arg_max_null({c}, loadedat) AS {c}" for c in _FIELDS) + " FROM companies WHERE removedat IS NULL GROUP BY code), "
    + "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field FROM f JOIN l USING (code) WHERE f.{c} IS DISTINCT FROM l.{c}" for c in _FIELDS) + " UNION ALL SELECT 'GONE' FROM f ANTI JOIN l USING (code) UNION ALL SELECT 'NEW' FROM l ANTI JOIN f USING (code)) SELECT field, count(*) AS changed FROM m GROUP BY field",
    "text_tokens": f"SELECT k AS query_id, array_to_string(tokens, '|') AS tokens, len(tokens) AS n FROM {_tokens_sql('stage3_semiconductor_benchmark', 'query_id', 'query')}",
    "text_bm25": f"WITH {_INDEX} SELECT query, doc, score, rank FROM bm25",
    "text_idf_overlap": f"WITH {_INDEX} SELECT query, doc, score, rank FROM overlap",
    "vector_nearest": f"WITH {_INDEX} SELECT query, doc, score, rank FROM nearest",
    "fused_rrf": f"WITH {_INDEX}, f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM nearest UNION ALL SELECT query, doc, rank FROM bm25) GROUP BY query, doc) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 15",
    "fused_blend": f"WITH {_INDEX}, r AS (SELECT query, doc, coalesce(a.score, 0) * 0.65::DOUBLE + coalesce(b.score, 0) AS raw FROM nearest a FULL JOIN overlap b USING (query, doc)) SELECT query, doc, floor(raw / greatest(max(raw) OVER (PARTITION BY query), 1e-6) * (0.92::DOUBLE * 100) + 0.5) / 100 AS score FROM r",
    "fused_constraints": f"WITH {_INDEX} SELECT query, doc, final, final_rank FROM con",
    "fused_match_count": f"WITH {_INDEX} SELECT query, least(8, greatest(least(3, count(*)), count(*) FILTER (final >= 0.1))) AS matches FROM con GROUP BY query",
    "corpus_document_frequency": "SELECT term, count(DISTINCT code) AS df FROM (SELECT code, unnest(concepts) AS term FROM companies) WHERE term IS NOT NULL AND term <> '' GROUP BY term",
    "corpus_gate": "WITH e AS (SELECT DISTINCT code, unnest(concepts) AS term FROM companies), g AS (SELECT term FROM e WHERE term <> '' GROUP BY term HAVING count(DISTINCT code) / (SELECT count(DISTINCT code) FROM companies) <= 0.05) SELECT code, term FROM e JOIN g USING (term)",
    "corpus_rule_tags": " UNION ALL ".join(
        f"SELECT ingestid, '{dim}' AS dimension, '{label}' AS label, regexp_extract(rawtext, '{p}', 0) AS evidence FROM facts WHERE regexp_matches(rawtext, '{p}')" + (f" AND NOT regexp_matches(rawtext, '{v}')" if v else "") for dim, label, p, v in RULES
    ),
    "corpus_newest_facts": f"SELECT code, ingestid, row_number() OVER (PARTITION BY code ORDER BY coalesce(dated, '9999-12-31') DESC, ingestid) AS position FROM (SELECT ingestid, {_CODE} AS code, source.\"asof\" AS dated FROM facts WHERE companycode IS NOT NULL) QUALIFY position <= 3",
    "corpus_fact_issues": """SELECT f.ingestid, issue FROM (
SELECT ingestid, 'fact_id_form' AS issue FROM facts WHERE NOT regexp_full_match(factid, 'sf_[0-9]{6}_[0-9]{6,8}')
UNION ALL SELECT DISTINCT ingestid, 'term_not_in_text' FROM (SELECT ingestid, rawtext, unnest(terms) AS t FROM facts) WHERE NOT contains(rawtext, t)
UNION ALL SELECT ingestid, 'unknown_company' FROM facts WHERE companycode IS NULL OR companycode NOT IN (SELECT code FROM companies)
UNION ALL SELECT ingestid, 'digest_form' FROM facts WHERE NOT regexp_full_match(artifactsha256, '[0-9a-f]{64}')
UNION ALL SELECT ingestid, 'no_digest' FROM facts WHERE artifactsha256 IS NULL
UNION ALL SELECT ingestid, 'no_date' FROM facts WHERE source."asof" IS NULL
UNION ALL SELECT ingestid, 'text_too_short' FROM facts WHERE length(rawtext) < 2) f""",
    "corpus_coverage": "SELECT count(*) AS rows, count(*) FILTER (length(businessdescription) > 0) AS with_description, count(*) FILTER (len(mainproducts) > 0) AS with_products, count(*) FILTER (len(concepts) > 0) AS with_concepts, count(*) FILTER (region.province IS NOT NULL) AS with_province, count(*) FILTER (swlevel1industry = 'unknown') AS unknown_industry FROM companies",
    "corpus_duplicate_triples": "SELECT companycode, facttype, sha256(rawtext) AS digest, count(*) AS n FROM facts WHERE companycode IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "extract_trigger_counts": " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS category, len(regexp_extract_all(text, '{t}')) AS n, strpos(text, '{t}') - 1 AS first_at FROM documents WHERE contains(text, '{t}')" for k, t in TRIGGERS.items()
    ),
    "extract_field_hits": "WITH c AS (SELECT code, arg_max({'b': businessdescription, 'i': industry, 'n': name}, loadedat) AS c FROM companies GROUP BY code), f AS (SELECT code, 'businessdescription' AS field, c.b AS t FROM c UNION ALL SELECT code, 'industry', c.i FROM c UNION ALL SELECT code, 'name', c.n FROM c) "
    "SELECT code, field, min(term) AS term, quote FROM (SELECT code, field, term, substr(t, greatest(1, strpos(t, term) - 18), strpos(t, term) - greatest(1, strpos(t, term) - 18) + length(term) + 18) AS quote FROM f, (SELECT unnest(['材料', '设备', '电子']) AS term) WHERE contains(t, term)) GROUP BY code, field, quote",
    "text_signals": "SELECT ingestid, substr(sha256(rawtext), 1, 16) AS hash16, round(length(regexp_replace(rawtext, '[^\\x{3400}-\\x{9fff}]', '', 'g')) / nullif(length(rawtext), 0), 6) AS han_ratio, (contains(rawtext, '产线')::INT + contains(rawtext, '专利')::INT + contains(rawtext, '客户')::INT + contains(rawtext, '毛利率')::INT) AS hits FROM facts",
}
