"""Queries on names, places, clauses, assembled texts and display values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import wording as W
from marlstone.tables import table

NOISE = "概念$|板块$|^其他"
TAGS = {"equipment": ["设备", "机台"], "material": ["材料", "硅片", "光刻胶"], "packaging": ["封装", "封测"], "design": ["设计", "芯片"]}
TERMS = ["产能", "专利", "客户"]


def wording_places(spark: SparkSession, d: str) -> DataFrame:
    """Province and city that a company's name and description give."""
    t = F.concat_ws(" ", "fullname", "businessdescription")
    rows = table(spark, d, "companies").select("code", "loadedat", t.alias("t")).withColumn("province", W.first_listed(F.col("t"), W.PROVINCES))
    return rows.select("code", "loadedat", "province", W.city_after(F.col("t"), F.col("province")).alias("city"))


def wording_names(spark: SparkSession, d: str) -> DataFrame:
    """Other names of a company, and the base form of its industry."""
    rows = table(spark, d, "companies")
    return rows.select("code", "loadedat", F.array_join(W.aliases(F.coalesce("fullname", "name"), W.former_names(F.col("businessdescription"))), "|").alias("aliases"), W.base_form(F.col("industry")).alias("base"))


def wording_clauses(spark: SparkSession, d: str) -> DataFrame:
    """The clause of the first mention of capacity, the sentence on customer shares, and surroundings of three terms."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.call_function("locate", F.lit("产能"), F.col("text")).alias("p"))
    return rows.select(
        "doc_id",
        F.when(F.col("p") > 0, W.clause_at(F.col("text"), F.col("p"))).alias("clause"),
        W.up_to_percent(F.col("text"), "前五名客户").alias("concentration"),
        F.array_join(W.snippets(F.col("text"), F.array(*[F.lit(t) for t in TERMS])), "|").alias("snippets"),
    )


def wording_pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts that lose page noise, by how much."""
    rows = table(spark, d, "documents").select("doc_id", (F.length("text") - F.length(W.without_page_noise(F.col("text")))).alias("lost"))
    return rows.where(F.col("lost") > 0)


def wording_assembled(spark: SparkSession, d: str) -> DataFrame:
    """A company's searchable text: labelled lines, and its concepts in what room is left."""
    concepts = F.array_join("concepts", "、")
    parts = [("名称", F.col("name")), ("行业", F.col("industry")), ("主营", F.col("businessdescription"))]
    return table(spark, d, "companies").select("code", "loadedat", W.labelled_lines(parts, 120, ("概念", concepts), 60).alias("text"))


def wording_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts without noise, each once, at most twelve."""
    return table(spark, d, "companies").select("code", "loadedat", F.array_join(W.ordered_once([F.col("concepts")], NOISE, 12), "|").alias("concepts"))


def wording_display(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", W.display(F.col("l_extendedprice"), "money").alias("price"), W.display(F.col("l_discount") * 100, "percent").alias("discount"), W.display(F.col("l_quantity"), "ratio").alias("quantity"))


def wording_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stage3_semiconductor_benchmark").select("query_id", W.first_needle(F.col("query"), TAGS).alias("tag"))


def wording_times(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last week of the stream, in local time."""
    rows = table(spark, d, "events")
    now = F.broadcast(rows.agg(F.max("ts").alias("now")))  # one row
    return rows.join(now, F.col("ts") >= W.relative_start(F.col("now"), "7d")).select("event_id", W.local_time(F.col("ts")).alias("local"))


QUERIES = {f.__name__: f for f in (wording_places, wording_names, wording_clauses, wording_pages, wording_assembled, wording_concepts, wording_display, wording_tags, wording_times)}

_T = "concat_ws(' ', fullname, businessdescription)"
_PROVINCE = "CASE " + " ".join(f"WHEN contains(t, '{p}') THEN '{p}'" for p in W.PROVINCES) + " ELSE '' END"
_BARE = "regexp_replace(regexp_replace(n, '^\\*?(ST|st)', ''), '[-－](U|W|UW)$', '')"
_LINE = "CASE WHEN length(trim({c}, ' ')) > 0 THEN '{label}：' || substr({c}, 1, 60) END"
_HEAD = f"substr(concat_ws(chr(10), {_LINE.format(c='name', label='名称')}, {_LINE.format(c='industry', label='行业')}, {_LINE.format(c='businessdescription', label='主营')}), 1, 120)"
_SNIP = "CASE WHEN contains(f, '{t}') THEN (CASE WHEN greatest(1, strpos(f, '{t}') - 16) > 1 THEN '…' ELSE '' END) || substr(f, greatest(1, strpos(f, '{t}') - 16), least(length(f), strpos(f, '{t}') + 17) - greatest(1, strpos(f, '{t}') - 16) + 1) || (CASE WHEN least(length(f), strpos(f, '{t}') + 17) < length(f) THEN '…' ELSE '' END) END"
_NOISY = "regexp_matches(x, '^\\s*(第?\\s*[0-9]+\\s*(页|/\\s*[0-9]+)?|[-—]\\s*[0-9]+\\s*[-—])\\s*$') OR (contains(x, '年度报告') AND length(trim(x, ' ')) <= 30)"
_TWO = "printf('%.2f', floor(({x}) * 100.0 + 0.5) / 100.0)"
_P = "l_extendedprice"
_MONEY = f"CASE WHEN {_P} IS NULL THEN '—' WHEN abs({_P}) >= 1e8 THEN {_TWO.format(x=_P + ' / 1e8')} || '亿' WHEN abs({_P}) >= 1e4 THEN {_TWO.format(x=_P + ' / 1e4')} || '万' ELSE {_TWO.format(x=_P)} END"
SQL = {
    "wording_places": f"WITH a AS (SELECT code, loadedat, {_T} AS t FROM companies), b AS (SELECT *, {_PROVINCE} AS p FROM a) SELECT code, loadedat, p AS province, CASE WHEN p <> '' THEN regexp_extract(regexp_replace(substr(t, strpos(t, p) + length(p), 200), '^(省|市|自治区|壮族自治区|回族自治区|维吾尔自治区)', ''), '^([\\x{{4e00}}-\\x{{9fff}}]{{1,7}}?市)', 1) ELSE '' END AS city FROM b",
    "wording_names": f"WITH a AS (SELECT code, loadedat, industry, coalesce(fullname, name) AS n, list_filter(list_transform(regexp_extract_all(coalesce(businessdescription, ''), '(由|曾用名[:：]?)[“\"「]?([\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9*]{{2,12}}?)[”\"」]?(变更为|更名为|，|。|；)', 2), lambda x: x), lambda x: NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '公司')) AS f FROM companies), "
    f"b AS (SELECT *, {_BARE} AS b FROM a), c AS (SELECT *, list_concat([b, regexp_replace(b, '(股份有限公司|有限责任公司|有限公司|集团|股份)$', '')], list_filter(f, lambda x, i: list_position(f, x) = i)[1:2]) AS l FROM b), "
    "e AS (SELECT *, list_filter(l, lambda x: length(x) > 1 AND x <> n AND NOT contains(x, '公司')) AS k FROM c) SELECT code, loadedat, coalesce(array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:8], '|'), '') AS aliases, regexp_replace(industry, '(业务|产品|类|行业|收入|板块|及扩展)$', '') AS base FROM e",
    "wording_clauses": "WITH a AS (SELECT doc_id, text, strpos(text, '产能') AS p, regexp_replace(text, '\\s+', ' ', 'g') AS f, regexp_extract(text, '(前五名客户[^%％]{0,180}[%％])', 1) AS c FROM documents) SELECT doc_id, CASE WHEN p > 0 THEN regexp_extract(substr(text, 1, p - 1), '([^。！？；]*)$', 1) || regexp_extract(substr(text, p), '^([^。！？；]*)', 1) END AS clause, "
    "CASE WHEN length(c) >= 20 AND regexp_matches(c, '比例|总额') THEN c END AS concentration, coalesce(concat_ws('|', " + ", ".join(_SNIP.format(t=t) for t in TERMS) + "), '') AS snippets FROM a",
    "wording_pages": f"SELECT doc_id, length(text) - length(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT ({_NOISY})), chr(10))) AS lost FROM documents WHERE lost > 0",
    "wording_assembled": f"WITH a AS (SELECT code, loadedat, {_HEAD} AS h, array_to_string(concepts, '、') AS c FROM companies) SELECT code, loadedat, h || CASE WHEN 120 - length(h) - 4 > 0 AND length(trim(c, ' ')) > 0 THEN chr(10) || '概念：' || substr(c, 1, 120 - length(h) - 4) ELSE '' END AS text FROM a",
    "wording_concepts": f"WITH a AS (SELECT code, loadedat, list_filter(list_transform(coalesce(concepts, []), lambda x: trim(x, ' ')), lambda x: length(x) > 0 AND NOT regexp_matches(x, '{NOISE}')) AS l FROM companies) SELECT code, loadedat, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], '|'), '') AS concepts FROM a",
    "wording_display": f"SELECT l_orderkey, l_linenumber, {_MONEY} AS price, CASE WHEN l_discount * 100 > 0 THEN '+' ELSE '' END || {_TWO.format(x='l_discount * 100')} || '%' AS discount, {_TWO.format(x='l_quantity')} || '倍' AS quantity FROM lineitem",
    "wording_tags": "SELECT query_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(query, '{n}')" for n in needles) + f" THEN '{tag}'" for tag, needles in TAGS.items()) + " ELSE 'other' END AS tag FROM stage3_semiconductor_benchmark",
    "wording_times": "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '+08:00' AS local FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
}
