"""Ranking quality: metrics over ranked, labelled results, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import rank_position
from marlstone.operators.ranks import numbered, running_counts
from marlstone.runtime import js_round


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10, relevant: int = 2) -> DataFrame:
    """query, and at ``k``: dcg with gains 2^label - 1, ndcg, precision, recall, first_relevant, reciprocal_rank, bad (label 0 shown).

    ``ranked`` has query, item, rank; ``truth`` query, item, label, one row each.
    Unlabelled results count as label 0; a query without labelled relevant items
    has null recall and ndcg; a query with no results has zeros.
    """
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    shown = ranked.where(F.col("rank") <= k).join(truth, ["query", "item"], "left")
    got = shown.groupBy("query").agg(
        F.sum(F.coalesce(gain, F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.count_if(F.col("label") >= relevant).alias("hits"),
        F.min(F.when(F.col("label") >= relevant, F.col("rank"))).alias("first_relevant"),
        F.count_if(F.col("label") == 0).alias("bad"),
    )
    w = Window.partitionBy("query").orderBy(F.col("label").desc(), "item")
    ideal = truth.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("ideal"))
    wanted = truth.groupBy("query").agg(F.count_if(F.col("label") >= relevant).alias("wanted"))
    out = wanted.join(ideal, "query").join(got, "query", "left").fillna(0, ["dcg", "hits", "bad"])
    return out.select(
        "query",
        F.round("dcg", 6).alias("dcg"),
        F.round(F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.col("hits") / k, 6).alias("precision"),
        F.round(F.col("hits") / F.nullif(F.col("wanted"), F.lit(0)), 6).alias("recall"),
        "first_relevant",
        F.round(F.coalesce(1 / F.col("first_relevant"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        "bad",
    )


def weighted_label(ranked: DataFrame, labels: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """query, judged, mean: mean weight of the labelled among the first ``k``; labels without a weight count 0."""
    pairs = [F.lit(x) for item in weights.items() for x in item]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("label")), F.lit(0.0))
    shown = ranked.where(F.col("rank") <= k).join(labels, ["query", "item"])
    return shown.groupBy("query").agg(F.count("*").alias("judged"), js_round(F.avg(weight), 4).alias("mean"))


def inversions(scored: DataFrame, query: str, label: str, score: str, high: int) -> DataFrame:
    """query, pairs, inverted, rate: pairs of a row labelled ``high`` and one labelled lower, and how many of these the score has the wrong way round.

    Pairs are counted, never made: rows are counted by score, and the lower-labelled
    rows that score more are what a running count lacks of their total.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & (F.col(label) <= high))
    counts = rows.groupBy(F.col(query).alias("query"), F.col(score).alias("_s")).agg(F.count_if(F.col(label) < high).alias("_low"), F.count_if(F.col(label) == high).alias("_high"))
    run = running_counts(counts, ["query"], "_s", "_low")
    out = run.groupBy("query").agg(F.sum(F.col("_high") * F.col("total")).alias("pairs"), F.sum(F.col("_high") * (F.col("total") - F.col("upto"))).alias("inverted"))
    return out.withColumn("rate", F.round(F.col("inverted") / F.nullif(F.col("pairs"), F.lit(0)), 6))


def rank_correlation(rows: DataFrame, group: str, a: str, b: str, tie: str) -> DataFrame:
    """group, n, rho: Spearman's correlation of ordinal ranks, ties by ``tie``; null for fewer than two rows."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    plain = known.select(F.col(group).alias("group"), F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(tie).alias("_tie"))
    ranks = numbered(numbered(plain, ["group"], ["_a", "_tie"], "x"), ["group"], ["_b", "_tie"], "y").select("group", F.col("x").cast("double"), F.col("y").cast("double"))
    return ranks.groupBy("group").agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.round(F.corr("x", "y"), 6)).alias("rho"))


def run_comparison(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """query, overlap, entered, left, top_changed, mean_rank_shift, mean_score_shift of two runs with query, item, rank, score.

    Overlap is shared items over the smaller of k and the first run's size, at least 1.
    """
    lists = lambda r, n: r.where(F.col("rank") <= k).groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias(n))
    both = lists(before, "x").join(lists(after, "y"), "query", "full_outer")
    x, y = (F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in ("x", "y"))
    moved = before.select("query", "item", F.col("rank").alias("r"), F.col("score").alias("s")).join(after.select("query", "item", "rank", "score"), ["query", "item"])
    shifts = moved.groupBy("query").agg(F.round(F.avg(F.abs(F.col("rank") - F.col("r"))), 6).alias("mean_rank_shift"), F.round(F.avg(F.abs(F.col("score") - F.col("s"))), 6).alias("mean_score_shift"))
    out = both.select(
        "query",
        F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.lit(k))), 6).alias("overlap"),
        F.sort_array(F.array_except(y, x)).alias("entered"),
        F.sort_array(F.array_except(x, y)).alias("left_"),
        (~F.get(x, F.lit(0)).eqNullSafe(F.get(y, F.lit(0)))).alias("top_changed"),
    )
    return out.join(shifts, "query", "left")


def transitions(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """old, new, n: how labels of the same key moved between two sets."""
    return before.select(key, F.col(label).alias("old")).join(after.select(key, F.col(label).alias("new")), key).groupBy("old", "new").agg(F.count("*").alias("n"))


def variance_share(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the variance of group means over the variance of all values; null where that is 0."""
    means = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("m")).agg(F.var_pop("m").alias("between"))
    whole = rows.agg(F.var_pop(value).alias("total"))
    return means.crossJoin(F.broadcast(whole)).select(F.round(F.col("between") / F.nullif(F.col("total"), F.lit(0.0)), 6).alias("share"))


def wrongly_above(ranked: DataFrame, wrong: str, label: str, relevant: int = 2) -> DataFrame:
    """Rows flagged ``wrong`` that are ranked above their query's first relevant row; all of them where none is relevant."""
    first = F.min(F.when(F.col(label) >= relevant, F.col("rank"))).over(Window.partitionBy("query"))
    marked = ranked.withColumn("_first", first)
    return marked.where(F.coalesce(F.col(wrong), F.lit(False)) & (F.col("_first").isNull() | (F.col("rank") < F.col("_first")))).drop("_first")


def grade_summary(graded: DataFrame, group: str, grade: str, rank: str, shown: int = 20) -> DataFrame:
    """By group: rows, mean, median and p90 grade (the elements at floor(n / 2) and floor(0.9 n)), shares of at least 1.5 and 2,
    the mean of the first ``shown``, and how far that lies above the mean."""
    rows = graded.where(F.col(grade).isNotNull())
    counts = rows.groupBy(F.col(group).alias("group"), F.col(grade).cast("double").alias("g")).agg(F.count("*").alias("c"))
    run = running_counts(counts, ["group"], "g", "c")
    high = run.groupBy("group").agg(*[F.min(F.when(F.col("upto") > rank_position(F.col("total"), p, "floor"), F.col("g"))).alias(n) for n, p in (("median", 0.5), ("p90", 0.9))])
    sums = rows.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("rows"),
        F.round(F.avg(grade), 6).alias("mean"),
        F.round(F.avg((F.col(grade) >= 1.5).cast("int")), 6).alias("from_1_5"),
        F.round(F.avg((F.col(grade) >= 2).cast("int")), 6).alias("from_2"),
        F.round(F.avg(F.when(F.col(rank) <= shown, F.col(grade))), 6).alias("shown_mean"),
    )
    return sums.join(high, "group").withColumn("margin", F.round(F.col("shown_mean") - F.col("mean"), 6))


def binary_dcg(ranked: DataFrame, truth: DataFrame, k: int = 10, relevant: int = 2) -> DataFrame:
    """query, dcg at ``k`` with gain 1 for a label of at least ``relevant``; queries without results are left out."""
    shown = ranked.where(F.col("rank") <= k).join(truth, ["query", "item"], "left")
    gain = F.when(F.col("label") >= relevant, 1.0).otherwise(0.0)
    return shown.groupBy("query").agg(F.round(F.sum(gain / F.log2(F.col("rank") + 1)), 6).alias("dcg"))


def cohort_margin(graded: DataFrame, group: str, mine: str, foil: str, grade: str) -> DataFrame:
    """group, best and mean grade of the rows flagged ``mine`` and of those flagged ``foil``, and how far the means lie apart."""
    of = lambda f, flag: f(F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(grade)))
    out = graded.groupBy(group).agg(of(F.max, mine).alias("mine_best"), F.round(of(F.avg, mine), 6).alias("mine_mean"), of(F.max, foil).alias("foil_best"), F.round(of(F.avg, foil), 6).alias("foil_mean"))
    return out.withColumn("margin", F.round(F.col("mine_mean") - F.col("foil_mean"), 6))


def case_summary(ranked: DataFrame, wanted: DataFrame, unwanted: DataFrame, ks: tuple[int, ...] = (1, 5, 10), intrudes: float = 0.6) -> DataFrame:
    """query, for each k whether a wanted item stands within it, and whether an unwanted one intrudes: within the last k, or anywhere at ``intrudes`` or more."""
    rows = ranked.join(wanted.select("query", "item", F.lit(True).alias("_w")), ["query", "item"], "left").join(unwanted.select("query", "item", F.lit(True).alias("_u")), ["query", "item"], "left")
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    hits = [yes(F.col("_w") & (F.col("rank") <= k)).alias(f"hit_{k}") for k in ks]
    return rows.groupBy("query").agg(*hits, yes(F.col("_u") & ((F.col("rank") <= ks[-1]) | (F.col("score") >= intrudes))).alias("intruded"))


def list_sizes(rows: DataFrame, lists: list[str]) -> DataFrame:
    """list, rows with any member, members, distinct members a row at most, and their mean over rows with any."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).cast("array<string>").alias("x")) for c in lists])).alias("l")
    sized = rows.select(each).select("l.list", F.size(F.coalesce("l.x", F.array().cast("array<string>"))).alias("n"), F.size(F.array_distinct(F.coalesce("l.x", F.array().cast("array<string>")))).alias("d"))
    return sized.groupBy("list").agg(F.count_if(F.col("n") > 0).alias("rows"), F.sum("n").alias("members"), F.max("d").alias("most"), F.round(F.avg(F.when(F.col("n") > 0, F.col("d"))), 6).alias("mean"))
