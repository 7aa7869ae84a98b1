"""Discovery over several channels: parsed queries, exclusions, nomination, fusion with an audit trail, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import term_hits
from marlstone.operators.retrieval import match_count, reciprocal_rank_fusion, top
from marlstone.runtime import join_lookup

#: How much of the word score is added to the meaning score where both are blended, and what a bucket's member has at least.
WORDS, MEMBER = 0.35, 1e-9


def query_specs(queries: DataFrame, query: str, text: str, concepts: list[str], expansions: dict[str, str], exclusions: dict[str, str]) -> DataFrame:
    """query, text, concepts (those named, in the list's order), expanded (the text with the words of each expansion whose pattern
    it meets), exclusions (names whose pattern it meets), least_share (a share it demands of abroad, between 0 and 1, else null)."""
    queries = queries.select(F.col(query).alias("_query"), F.col(text).alias("_text"))
    t = F.coalesce("_text", F.lit(""))
    more = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(t.rlike(p), F.lit(words)) for p, words in expansions.items()]))
    out = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(t.rlike(p), F.lit(name)) for name, p in exclusions.items()]))
    share = F.regexp_extract(t, r"(?:海外|境外|出口)[^0-9]{0,8}([0-9]{1,3})\s*[%％]", 1)
    return queries.select(
        F.col("_query").alias("query"), F.col("_text").alias("text"), term_hits(t, F.array(*[F.lit(c) for c in concepts])).alias("concepts"),
        F.array_join(F.concat(F.array(t), more), " ").alias("expanded"), out.alias("exclusions"), F.when(share != "", share.cast("double") / 100).alias("least_share"),
    )


def excluded(candidates: DataFrame, specs: DataFrame, docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``candidates`` (query, doc, ...) with ``dropped``: why a document may not be shown, the first of the query's exclusions whose
    pattern its text meets, or ``share`` where the query demands one that the document lacks; null keeps it. ``docs`` has doc, text, share;
    patterns are looked for where texts are read, so no text is joined."""
    met = {n: f"_met_{i}" for i, n in enumerate(patterns)}
    held = docs.select("doc", F.col("share").alias("_s"), *[F.col("text").rlike(p).alias(met[n]) for n, p in patterns.items()])
    rows = join_lookup(candidates, specs.select("query", "exclusions", "least_share"), ["query"], "left").join(held, "doc", "left")
    named = F.coalesce(*[F.when(F.array_contains("exclusions", n) & F.col(m), F.lit(n)) for n, m in met.items()], F.lit(None).cast("string"))
    short = F.col("least_share").isNotNull() & F.coalesce(F.col("_s") < F.col("least_share"), F.lit(True))
    return rows.withColumn("dropped", F.coalesce(named, F.when(short, "share"))).drop(*met.values(), "_s", "exclusions", "least_share")


def fused_with_audit(channels: dict[str, DataFrame], dropped: DataFrame | None = None, k: int = 200, constant: int = 60) -> DataFrame:
    """query, doc, score, rank of the reciprocal-rank fusion, and of each channel its rank and score, null where it lacks the
    document. Pairs of ``dropped`` (query, doc) are left out of every channel before ranks are taken."""
    kept = {}
    for name, c in channels.items():
        rest = c if dropped is None else c.join(dropped.select("query", "doc"), ["query", "doc"], "left_anti")
        kept[name] = top(rest.select("query", "doc", "score"), k)
    out = reciprocal_rank_fusion(list(kept.values()), k, constant)
    for name, c in kept.items():
        out = out.join(c.select("query", "doc", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score")), ["query", "doc"], "left")
    return out


def meaning_and_words(meaning: DataFrame, words: DataFrame) -> DataFrame:
    """query, doc, score: the meaning score plus a part of the word score; a channel without the document counts 0."""
    both = meaning.select("query", "doc", F.col("score").alias("m")).join(words.select("query", "doc", F.col("score").alias("w")), ["query", "doc"], "full_outer")
    return both.select("query", "doc", F.round(F.coalesce("m", F.lit(0.0)) + F.coalesce("w", F.lit(0.0)) * WORDS, 9).alias("score"))


def bucket(blend: DataFrame, wanted: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """query, doc, score, rank: of the documents in a query's buckets the ``cap`` best by blend, those without any blend last, by id.

    ``wanted`` has query, key; ``members`` doc, key. Only documents with a blend, and the first ``cap`` of each bucket, can be
    among them, so no bucket meets a query whole.
    """
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("doc"))).where(F.col("_r") <= cap).select("key", "doc")
    plain = join_lookup(first, wanted.groupBy("key").agg(F.collect_set("query").alias("queries")), ["key"]).select(F.explode("queries").alias("query"), "doc", F.lit(0.0).alias("s"))
    held = blend.join(members, "doc").join(wanted, ["query", "key"]).select("query", "doc", F.col("score").alias("s"))
    scored = plain.unionByName(held).groupBy("query", "doc").agg((F.max("s") + MEMBER).alias("score"))
    return top(scored, cap)


def nominated(channels: list[DataFrame], most: int = 240) -> DataFrame:
    """query, doc, channel, place: the channels' documents one channel after another, each where it appears first, at most ``most`` a query."""
    every = None
    for i, c in enumerate(channels):
        one = c.select("query", "doc", F.struct(F.lit(i).alias("channel"), "rank").alias("at"))
        every = one if every is None else every.unionByName(one)
    firsts = every.groupBy("query", "doc").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at", "doc"))
    return firsts.withColumn("place", place).where(F.col("place") <= most).select("query", "doc", F.col("at.channel").alias("channel"), "place")


def discovered(nominees: DataFrame, scores: DataFrame, dropped: DataFrame, shown: float = 0.3, fewest: int = 9, most: int = 120) -> DataFrame:
    """query, doc, final, final_rank, matches: nominees by score, dropped ones at 0, ties by place; and how many of a query's count as matches."""
    gone = dropped.select("query", "doc", F.lit(True).alias("_gone"))
    rows = nominees.join(scores.select("query", "doc", "score"), ["query", "doc"], "left").join(gone, ["query", "doc"], "left")
    final = rows.withColumn("final", F.when(F.col("_gone"), 0.0).otherwise(F.coalesce("score", F.lit(0.0))))
    ranked = final.withColumn("final_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("final").desc(), "place")))
    return join_lookup(ranked.select("query", "doc", "final", "final_rank"), match_count(final, shown, fewest, most), ["query"])


def target_ranks(targets: DataFrame, ranked: DataFrame) -> DataFrame:
    """query, doc, rank: where each target stands, null where it is absent."""
    return targets.select("query", "doc").join(ranked.select("query", "doc", "rank"), ["query", "doc"], "left")


def terms_anywhere(rows: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """term, n: in how many rows a term stands anywhere in the record, as JSON."""
    text = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    hit = rows.select(F.explode(term_hits(text, F.array(*[F.lit(t) for t in terms]))).alias("term"))
    return hit.groupBy("term").agg(F.count("*").alias("n"))


def share_of(part: Column, whole: Column, digits: int = 3) -> Column:
    """Sum of ``part`` over sum of ``whole``, null unless the latter is positive; for aggregates."""
    return F.when(F.sum(whole) > 0, F.round(F.sum(part) / F.sum(whole), digits))
