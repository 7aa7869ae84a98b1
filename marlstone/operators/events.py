"""Analytics over an event stream: sessions, windows, percentiles, rollups, correlation by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import null_if_any, rank_position, rate
from marlstone.operators.ranks import running_counts
from marlstone.runtime import join_lookup


def payload_number(payload: Column, path: str) -> Column:
    """A finite number at a JSON path, else null; broken JSON is null too."""
    v = F.get_json_object(payload, path).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def reformulations(events: DataFrame, user: str, at: str, event: str, text: str, gap_seconds: float = 120.0) -> DataFrame:
    """event, group_id, previous_id, edits, gap: consecutive events of a user at most ``gap_seconds`` apart are a chain.

    The first of a chain has no group; the others carry ``rg_`` and the first's
    id, their predecessor, the edit distance of the texts, and the seconds
    between. Order is (time, event); events without user or time stand alone.
    """
    w = Window.partitionBy(user).orderBy(at, event)
    rows = events.where(F.col(user).isNotNull() & F.col(at).isNotNull())
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    linked = rows.select(
        F.col(event).alias("event"), F.col(user).alias("_u"), F.col(at).alias("_t"), F.col(text).alias("_x"), F.lag(event).over(w).alias("_pe"), F.lag(text).over(w).alias("_px"), ((micros - F.lag(micros).over(w)) / 1e6).alias("_gap")
    )
    near = F.coalesce(F.col("_gap") <= gap_seconds, F.lit(False))
    run = Window.partitionBy("_u").orderBy("_t", "event").rowsBetween(Window.unboundedPreceding, 0)
    out = linked.withColumn("_near", near).withColumn("_first", F.last(F.when(~F.col("_near"), F.col("event")), ignorenulls=True).over(run))
    chain = [F.when(F.col("_near"), c) for c in (F.concat(F.lit("rg_"), F.col("_first").cast("string")), F.col("_pe"), F.levenshtein("_x", "_px"), F.col("_gap"))]
    joined = out.select("event", *[c.alias(n) for c, n in zip(chain, ("group_id", "previous_id", "edits", "gap"), strict=True)])
    alone = events.where(F.col(user).isNull() | F.col(at).isNull()).select(F.col(event).alias("event"), *[F.lit(None).cast(t).alias(n) for n, t in joined.dtypes[1:]])
    return joined.unionByName(alone)


def repeats_within(events: DataFrame, user: str, at: str, event: str, value: str, last: int = 30) -> DataFrame:
    """event, repeats: how many of the user's ``last`` events up to and with this one have this one's value."""
    w = Window.partitionBy(user).orderBy(at, event).rowsBetween(-(last - 1), 0)
    own = events.withColumn("_recent", F.collect_list(value).over(w))
    return own.select(F.col(event).alias("event"), F.size(F.filter("_recent", lambda x: x == F.col(value))).alias("repeats"))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], variant: str = "round_up") -> DataFrame:
    """key, n, and one column a share: exact nearest-rank percentiles of the positive finite values.

    A key's values are counted per distinct value first; positions are found in
    the running counts, which are summed over ranges, so no key is gathered.
    """
    v = F.col(value).cast("double")
    counts = rows.where((v > 0) & (v != float("inf")) & ~F.isnan(v)).groupBy(F.col(key).alias("key"), v.alias("v")).agg(F.count("*").alias("c"))
    run = running_counts(counts, ["key"], "v", "c")
    found = [F.min(F.when(F.col("upto") > rank_position(F.col("total"), p, variant), F.col("v"))).alias(name) for name, p in shares.items()]
    return run.groupBy("key").agg(F.max("total").alias("n"), *found)


def distribution(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, p50, p75, p90, p95, p99, max of the positive finite values; a key without any has zeros."""
    shares = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = percentiles(rows, key, value, shares, "round_span")
    v = F.col(value).cast("double")
    most = rows.groupBy(F.col(key).alias("key")).agg(F.max(F.when((v > 0) & (v != float("inf")) & ~F.isnan(v), v)).alias("max"))
    return most.join(found, most["key"].eqNullSafe(found["key"]), "left").select(most["key"], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *shares, "max")])


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median (the element at floor(n / 2)) of the positive finite values."""
    return percentiles(rows, key, value, {"median": 0.5}, "floor")


def percentile_variants(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the same percentile by four nearest-rank rules and interpolated between neighbours, from running counts of distinct values."""
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.lit(0).alias("key"), v.alias("v")).agg(F.count("*").alias("c"))
    run = running_counts(counts, ["key"], "v", "c")
    at = lambda position: F.min(F.when(F.col("upto") > position, F.col("v")))
    span = (F.col("total") - 1) * F.lit(share)
    each = {k: at(rank_position(F.col("total"), share, k)) for k in ("round_up", "ceil", "round_span", "floor")}
    found = run.agg(*[c.alias(k) for k, c in each.items()], at(F.floor(span)).alias("_low"), at(F.ceil(span)).alias("_high"), F.max(span - F.floor(span)).alias("_part"))
    return found.select(*each, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("linear"))


def daily_rollup(events: DataFrame, at: str, kind: str, user: str, value: str, error_kind: str) -> DataFrame:
    """By UTC day: events, users, distinct kinds, errors, their rate, p50 and p95 of the positive values, counts by kind.

    Counts by (day, kind) come from one partial aggregation; the map of kinds is built from those.
    """
    days = events.where(F.col(at).isNotNull()).withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    totals = days.groupBy("day").agg(F.count("*").alias("events"), F.countDistinct(user).alias("users"), F.count_if(F.col(kind) == error_kind).alias("errors"))
    kinds = days.groupBy("day", F.coalesce(kind, F.lit("unknown")).alias("k")).agg(F.count("*").alias("n")).groupBy("day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("by_kind"))
    shares = percentiles(days, "day", value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed("key", "day").drop("n")
    return totals.join(kinds, "day").join(shares, "day", "left").withColumn("error_rate", rate(F.col("errors"), F.col("events")))


def last_per_key(events: DataFrame, key: str, at: str, event: str, value: str) -> DataFrame:
    """key, value: each key's value at its last event by (time, event); mergeable, so nothing is sorted."""
    return events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(value, F.struct(at, event)).alias("value"))


def union_without(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` and those rows of ``second`` whose key ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def cost_summary(calls: DataFrame, by: str, tokens: str, cost: str) -> DataFrame:
    """By group: calls, tokens, and a cost that is unknown as soon as one call's is."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), null_if_any(F.sum(F.col(cost).cast("decimal(28,9)")).cast("double"), F.count("*"), F.count(cost)).alias("cost"))


def offenders(shown: DataFrame, item: str, query: str, least: int = 5, most: int = 10) -> DataFrame:
    """The ``most`` items shown for the most distinct queries, of at least ``least``."""
    return shown.groupBy(item).agg(F.countDistinct(query).alias("queries")).where(F.col("queries") >= least).orderBy(F.col("queries").desc(), F.col(item)).limit(most)


def correlated(asked: DataFrame, answered: DataFrame, key: str, at: str, event: str, columns: list[str]) -> DataFrame:
    """``asked`` with the columns of the key's last answer by (time, event), null where there is none; null keys have none."""
    last = answered.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, event)).alias("_a"))
    return join_lookup(asked, last, [key], "left").withColumns({f"answer_{c}": F.col("_a")[c] for c in columns}).drop("_a")


def clicked_ranks(clicks: DataFrame, snapshots: DataFrame, key: str, item: str, shown: str) -> DataFrame:
    """``clicks`` with rank: where, from 1, the clicked item stands in the key's list of shown items, null where it doesn't."""
    places = snapshots.select(key, F.posexplode(shown).alias("_p", item)).groupBy(key, item).agg((F.min("_p") + 1).alias("rank"))
    return clicks.join(places, [key, item], "left")


def offenders_by_grade(shown: DataFrame, item: str, query: str, grade: str, rank: str, least: int = 5, below: float = 1.5, within: int = 20) -> DataFrame:
    """Items shown within the first ranks for at least ``least`` distinct queries at a mean grade below ``below``: queries and mean grade."""
    rows = shown.where((F.col(rank) <= within) & F.col(grade).isNotNull())
    out = rows.groupBy(item).agg(F.countDistinct(query).alias("queries"), F.round(F.avg(grade), 6).alias("mean_grade"))
    return out.where((F.col("queries") >= least) & (F.col("mean_grade") < below))


def plainly_irrelevant(shown: DataFrame, item: str, family: str, label: str, rank: str, score: str) -> DataFrame:
    """By item shown with a label of 0 or 1: how often, mean rank and score, families, and how many of either label."""
    rows = shown.where(F.col(label) <= 1)
    return rows.groupBy(item).agg(
        F.count("*").alias("n"), F.round(F.avg(rank), 6).alias("mean_rank"), F.round(F.avg(score), 6).alias("mean_score"), F.countDistinct(family).alias("families"), F.count_if(F.col(label) == 0).alias("l0"), F.count_if(F.col(label) == 1).alias("l1")
    )


def unclean_runs(events: DataFrame, run: str, kind: str, start: str, ends: list[str], current: str | None = None) -> DataFrame:
    """Runs that began and neither stopped nor crashed, but for the current one."""
    began, ended = F.bool_or(F.coalesce(F.col(kind) == start, F.lit(False))), F.bool_or(F.coalesce(F.col(kind).isin(ends), F.lit(False)))
    rows = events.where(F.col(run).isNotNull() & (F.col(run) != F.lit(current)) if current is not None else F.col(run).isNotNull())
    return rows.groupBy(run).agg(began.alias("_b"), ended.alias("_e")).where(F.col("_b") & ~F.col("_e")).select(run)


def call_statistics(calls: DataFrame, path: str, at: str, event: str, ms: str, failed: Column, last: int = 50) -> DataFrame:
    """By path: calls, failures, p95 of the durations, and p50 of the last ``last`` calls by (time, event)."""
    base = calls.groupBy(F.col(path).alias("key")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    recent = calls.withColumn("_r", F.row_number().over(Window.partitionBy(path).orderBy(F.col(at).desc(), F.col(event).desc()))).where(F.col("_r") <= last)
    whole, late = percentiles(calls, path, ms, {"p95": 0.95}, "ceil").drop("n"), percentiles(recent, path, ms, {"recent_p50": 0.5}, "ceil").drop("n")
    return base.join(whole, "key", "left").join(late, "key", "left")


def state_changes(events: DataFrame, entity: str, at: str, event: str, healthy: Column) -> DataFrame:
    """entity, event, change: rows at which the state turns, FAILED or RECOVERED; unknown states don't count."""
    w = Window.partitionBy(entity).orderBy(at, event)
    known = events.withColumn("_ok", healthy).where(F.col("_ok").isNotNull())
    turned = known.withColumn("_was", F.coalesce(F.lag("_ok").over(w), F.lit(True))).where(F.col("_ok") != F.col("_was"))
    return turned.select(F.col(entity).alias("entity"), F.col(event).alias("event"), F.when(F.col("_ok"), "RECOVERED").otherwise("FAILED").alias("change"))


def silences(events: DataFrame, entity: str, at: str, event: str, longest_seconds: float) -> DataFrame:
    """entity, event, seconds: gaps between an entity's events beyond ``longest_seconds``, at the event that ends them."""
    w = Window.partitionBy(entity).orderBy(at, event)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    out = events.where(F.col(at).isNotNull()).select(F.col(entity).alias("entity"), F.col(event).alias("event"), ((micros - F.lag(micros).over(w)) / 1e6).alias("seconds"))
    return out.where(F.col("seconds") > longest_seconds)


def suspects(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, kind: a row for each rule a row meets, unknown being not met."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return rows.select(F.col(key).alias("key"), F.explode(marks).alias("kind"))
