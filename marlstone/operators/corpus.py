"""Building a corpus: rule tags, frequency gates, budgeted selection, statistics, integrity, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import spans_within
from marlstone.runtime import join_lookup


def document_frequency(rows: DataFrame, doc: str, terms: str) -> DataFrame:
    """term, df: documents that hold each term of the array column at least once; null and empty terms don't count."""
    each = rows.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(terms)).alias("term")).where(F.col("term").isNotNull() & (F.col("term") != ""))
    return each.groupBy("term").agg(F.countDistinct("doc").alias("df"))


def gate(rows: DataFrame, doc: str, terms: str, most: float = 0.05) -> DataFrame:
    """doc, term: the terms found in at most the share ``most`` of all documents (of all rows' distinct ids)."""
    each = rows.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(terms)).alias("term")).where(F.col("term").isNotNull() & (F.col("term") != ""))
    total = F.broadcast(rows.agg(F.countDistinct(doc).alias("total")))  # one row
    common = document_frequency(rows, doc, terms).crossJoin(total).where(F.col("df") / F.col("total") > most).select("term")
    return each.distinct().join(common, "term", "left_anti")


def rule_tags(rows: DataFrame, text: str, rules: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """Adds tags, an array of (dimension, label, evidence): the first match of each rule's pattern, unless its veto
    pattern matches as well. One alternation of all patterns decides first whether a text has any."""
    any_rule = "|".join(f"(?:{p})" for _, _, p, _ in rules)
    c = F.col(text)
    made = []
    for dimension, label, pattern, veto in rules:
        hit = F.regexp_extract(c, f"({pattern})", 1)
        fires = c.rlike(pattern) & (~c.rlike(veto) if veto else F.lit(True))
        made.append(F.when(fires, F.struct(F.lit(dimension).alias("dimension"), F.lit(label).alias("label"), hit.alias("evidence"))))
    empty = F.array().cast("array<struct<dimension:string,label:string,evidence:string>>")
    return rows.withColumn("tags", F.when(F.coalesce(c.rlike(any_rule), F.lit(False)), F.array_compact(F.array(*made))).otherwise(empty))


def newest_first(rows: DataFrame, entity: str, date: str, tie: str, most: int | None = None) -> DataFrame:
    """Adds position within the entity, by date descending, unknown dates first, then ``tie``; at most ``most`` rows each."""
    w = Window.partitionBy(entity).orderBy(F.coalesce(F.col(date).cast("string"), F.lit("9999-12-31")).desc(), F.col(tie).asc())
    out = rows.withColumn("position", F.row_number().over(w))
    return out if most is None else out.where(F.col("position") <= most)


def evidence_spans(rows: DataFrame, entity: str, text: str, date: str, tie: str, cap: int = 280, most: int = 5) -> DataFrame:
    """entity, spans: each entity's texts, newest first, that fit what is left of ``cap`` characters and neither contain
    nor are contained in one kept before, at most ``most``. Only a kept text takes a slot.

    Equal texts count once, at their first place, and texts longer than ``cap`` can't be kept; both go before the lists are made. An entity of only such texts has no spans.
    """
    when = F.coalesce(F.col(date).cast("string"), F.lit("9999-12-31"))
    usable = rows.where(F.col(entity).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    fits = F.when(F.length(text) <= cap, F.col(text))
    newest = lambda x, y: F.when(x["d"] > y["d"], -1).when(x["d"] < y["d"], 1).when(x["tie"] < y["tie"], -1).when(x["tie"] > y["tie"], 1).otherwise(0)
    dated = usable.groupBy(F.col(entity).alias("entity"), fits.alias("t"), when.alias("d")).agg(F.min(tie).alias("tie"))
    first = dated.groupBy("entity", "t").agg(F.max("d").alias("d"), F.max_by("tie", "d").alias("tie"))
    lists = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("d", "tie", "t"))), newest).alias("x"))
    return lists.select("entity", spans_within(F.transform("x", lambda s: s["t"]), cap, most).alias("spans"))


def facts_issues(facts: DataFrame, known: DataFrame) -> DataFrame:
    """ingestid, issue: a row for each broken rule of a fact: its id's form, terms not in the text, unknown company,
    the digest's form, a locator of another kind, no date."""
    checks = [
        (~F.col("factid").rlike(r"^sf_[0-9]{6}_[0-9]{6,8}$"), "fact_id_form"),
        (~F.forall(F.col("terms"), lambda t: F.contains(F.col("rawtext"), t)), "term_not_in_text"),
        (F.col("_known").isNull(), "unknown_company"),
        (~F.col("artifactsha256").rlike("^[0-9a-f]{64}$"), "digest_form"),
        (F.col("artifactsha256").isNull(), "no_digest"),
        (F.col("source.asof").isNull(), "no_date"),
        (F.length("rawtext") < 2, "text_too_short"),
    ]
    names = known.select(F.col("code").alias("companycode"), F.lit(True).alias("_known")).distinct()
    rows = join_lookup(facts.select("ingestid", "factid", "terms", "rawtext", "companycode", "artifactsha256", "source"), names, ["companycode"], "left")
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in checks]))
    return rows.select("ingestid", F.explode(issues).alias("issue"))


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, changed: by field the keys on both sides whose value differs, null being a value; and keys NEW and GONE."""
    old = before.select(F.col(key).alias("_k"), *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(1).alias("_old"))
    new = after.select(F.col(key).alias("_k"), *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(1).alias("_new"))
    both = old.join(new, "_k", "full_outer")
    shared = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    marks = [F.when(F.col("_old").isNull(), "NEW"), F.when(F.col("_new").isNull(), "GONE")]
    marks += [F.when(shared & ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), f) for f in fields]
    return both.select(F.explode(F.array_compact(F.array(*marks))).alias("field")).groupBy("field").agg(F.count("*").alias("changed"))


def coverage(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row: rows, and for each named condition how many meet it, in one pass."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in groups.items()])


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
