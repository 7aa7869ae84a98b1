"""The queries of the training-data problems, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.codes import denoted_code, denoted_sql, family_key
from marlstone.llm.caps import cap_contributors
from marlstone.llm.mixing import mix, quality_weight
from marlstone.llm.mojibake import detector, restore_garbled
from marlstone.llm.near_duplicates import pairs_of_items, similar_texts
from marlstone.llm.overlap import cross_split_overlaps
from marlstone.llm.packing import pack
from marlstone.llm.residue import find_residue
from marlstone.llm.tokens import token_count
from marlstone.operators.datasets import connected
from marlstone.runtime import join_lookup, spread
from marlstone.tables import table

CAP = 12


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    evaluation = table(spark, d, "stage3_semiconductor_benchmark").select("query_id", "query")
    training = table(spark, d, "v4_2_train_pairs_a").select("pairid", "query")
    return cross_split_overlaps(evaluation, training, "query_id", "pairid")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every overlap of a benchmark query and a training query."""
    return _overlaps(spark, d).select("query_id", "pairid").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per benchmark split and training source: pairs, and rows of either side."""
    splits = table(spark, d, "stage3_semiconductor_benchmark").select("query_id", F.col("split").alias("benchmark_split"))
    sources = table(spark, d, "v4_2_train_pairs_a").select("pairid", F.col("source").alias("training_source"))
    found = join_lookup(_overlaps(spark, d).drop("similarity"), splits, ["query_id"]).join(sources, "pairid")
    return found.groupBy("benchmark_split", "training_source").agg(
        F.count("*").alias("pairs"), F.countDistinct("query_id").alias("benchmark_rows"), F.countDistinct("pairid").alias("training_rows")
    )


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return restore_garbled(table(spark, d, "facts").select("ingestid", "rawtext"), "rawtext")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose rawtext holds the result of a wrong decoding."""
    return _judged(spark, d).where("garbled").select("ingestid").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled facts with their text as far as it can be restored."""
    return _judged(spark, d).where("garbled").select("ingestid", "rawtext", "restored", "complete")


def _capped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "v4_2_train_pairs_a").select("pairid", "label", denoted_code(F.col("companycode")).alias("code"), family_key(F.col("queryfamily")).alias("family"))
    return cap_contributors(rows, [F.col("code"), F.col("family")], F.col("label"), F.col("pairid"), cap=CAP, bin_of=F.col("label"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond the first 12 of their contributor."""
    return _capped(spark, d).where(~F.col("kept")).select("pairid").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Contributors that lose rows: rows before, kept and cut."""
    rows = _capped(spark, d).where(F.col("code").isNotNull() & F.col("family").isNotNull())
    out = rows.groupBy("code", "family").agg(F.count("*").alias("rows_before"), F.count_if("kept").alias("rows_kept"), F.count_if(~F.col("kept")).alias("rows_cut"))
    return out.where(F.col("rows_cut") > 0)


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts = table(spark, d, "facts").select("factid", "rawtext")
    return similar_texts(facts, "factid", "rawtext", leave_out=detector(facts, "rawtext").is_garbled)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts with nearly the same text, garbled texts left aside."""
    return pairs_of_items(*_similar(spark, d)).select(F.col("item_a").alias("factid_a"), F.col("item_b").alias("factid_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each fact's group, named by its least class, and its classes' links. A fact whose texts have no relatives is a group of its
    own; one of two texts joins the groups of both. Facts without a text of 40 cleaned characters, or with garbled ones only, have no row."""
    members, links = _similar(spark, d)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    bound = members.groupBy("item").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n")).where(F.col("n") > 1)
    bound = members.join(bound, "item").select("a", F.col("key").alias("b")).where(F.col("a") != F.col("b"))
    roots = connected(links.select("a", "b").unionByName(bound)).select(F.col("node").alias("key"), "component")
    each = members.join(roots, "key", "left").join(degree, "key", "left")
    groups = each.groupBy(F.col("item").alias("factid")).agg(F.min(F.coalesce("component", "key")).alias("group_id"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    return groups.withColumn("group_id", F.lower(F.hex("group_id")))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container for each size of pack_capacities."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", token_count(F.col("text")).alias("tokens"))
    packed = pack(docs, table(spark, d, "pack_capacities"), "doc_id", "tokens", "packname", "capacitytokens")
    return packed.withColumnsRenamed({"pack": "packname", "item": "doc_id", "group": "pack_group"})


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and fill of each pack."""
    used = p6_packed(spark, d).groupBy("packname", "pack_group", "container").agg(F.sum("tokens").alias("tokens"))
    used = used.groupBy("packname").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(table(spark, d, "pack_capacities"), "packname").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacitytokens")))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text")).alias("tokens"), quality_weight(F.col("text")).alias("weight"))
    return mix(docs, table(spark, d, "mix_targets"), "doc_id", "source", "tokens", "weight")


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mixed(spark, d)[0].withColumnRenamed("record", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, d)[1]


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents").select("doc_id", "source", "text"), "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold residue in place of content."""
    return _residue(spark, d).where("residue").select("doc_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and those with each kind of residue, per source."""
    rows = _residue(spark, d)
    kinds = [F.count_if(F.array_contains("kinds", k)).alias(f"with_{k}") for k in ("slot", "notice", "filler")]
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("residue").alias("with_residue"), *kinds, F.count_if(F.col("coverage") >= 0.5).alias("mostly_residue"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_report": p8_report,
}

_FAMILY = "regexp_replace(upper(queryfamily), '[^\\p{L}\\p{N}]+', '', 'g')"
_RANKED = (
    f"SELECT pairid, code, family, row_number() OVER (PARTITION BY code, family ORDER BY label DESC NULLS LAST, pairid) AS rn FROM "
    f"(SELECT pairid, label, {denoted_sql('companycode')} AS code, {_FAMILY} AS family FROM v4_2_train_pairs_a WHERE companycode IS NOT NULL AND queryfamily IS NOT NULL)"
)
#: Cleaned queries for DuckDB, which has no NFKC: full-width signs are what the queries hold of it.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_CLEAN = f"regexp_replace(lower(translate(nfc_normalize(query), '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_GRAMS = "SELECT id, list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i::INT, 2))) AS g FROM (SELECT {id} AS id, {clean} AS c FROM {table} WHERE query IS NOT NULL) WHERE length(c) >= 4"
_OVERLAPS = (
    f"a AS MATERIALIZED ({_GRAMS.format(id='query_id', clean=_CLEAN, table='stage3_semiconductor_benchmark')}), b AS MATERIALIZED ({_GRAMS.format(id='pairid', clean=_CLEAN, table='v4_2_train_pairs_a')}), "
    "x AS (SELECT a.id AS query_id, b.id AS pairid, count(*) AS n FROM (SELECT id, unnest(g) AS t FROM a) a JOIN (SELECT id, unnest(g) AS t FROM b) b USING (t) GROUP BY ALL), "
    "o AS (SELECT query_id, pairid FROM x JOIN a ON a.id = query_id JOIN b ON b.id = pairid WHERE n / (len(a.g) + len(b.g) - n) >= 0.6 - 1e-12)"
)
SQL = {
    "p1_found": f"WITH {_OVERLAPS} SELECT query_id, pairid FROM o",
    "p1_report": f"WITH {_OVERLAPS} SELECT e.split AS benchmark_split, t.source AS training_source, count(*) AS pairs, count(DISTINCT o.query_id) AS benchmark_rows, count(DISTINCT o.pairid) AS training_rows FROM o JOIN stage3_semiconductor_benchmark e USING (query_id) JOIN v4_2_train_pairs_a t USING (pairid) GROUP BY ALL",
    "p4_found": f"SELECT pairid FROM ({_RANKED}) WHERE rn > {CAP}",
    "p4_report": f"SELECT code, family, count(*) AS rows_before, count(*) FILTER (rn <= {CAP}) AS rows_kept, count(*) FILTER (rn > {CAP}) AS rows_cut FROM ({_RANKED}) GROUP BY code, family HAVING count(*) > {CAP}",
}
