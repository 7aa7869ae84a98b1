"""Queries on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import rate
from marlstone.operators import events as E
from marlstone.runtime import shared_path
from marlstone.streaming import events as stream
from marlstone.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def events_reformulations(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a user's events at most an hour apart."""
    out = E.reformulations(_events(spark, d), "user_id", "ts", "event_id", "event_type", 3600.0)
    return out.withColumnRenamed("event", "event_id")


def events_repeats(spark: SparkSession, d: str) -> DataFrame:
    return E.repeats_within(_events(spark, d), "user_id", "ts", "event_id", "event_type").withColumnRenamed("event", "event_id")


def events_daily(spark: SparkSession, d: str) -> DataFrame:
    out = E.daily_rollup(_events(spark, d), "ts", "event_type", "user_id", "value", "error")
    return out.select("day", "events", "users", "errors", "error_rate", "p50", "p95", F.size("by_kind").alias("kinds"), F.element_at("by_kind", F.lit("click")).alias("clicks"))


def events_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return E.percentiles(_events(spark, d), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "ceil")


def events_percentile_variants(spark: SparkSession, d: str) -> DataFrame:
    return E.percentile_variants(_events(spark, d), "value", 0.9)


def events_last_value(spark: SparkSession, d: str) -> DataFrame:
    return E.last_per_key(_events(spark, d), "user_id", "ts", "event_id", "event_type")


def events_union_without(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "event_type")
    out = E.union_without(e.where(F.col("event_type") == "error"), e.where(F.col("event_type") == "signup"), "user_id")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def events_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", E.payload_number(F.col("props"), "$.k").alias("tokens"), F.when(F.col("event_id") % 997 != 0, F.col("value")).alias("cost"))
    return E.cost_summary(rows, "user_id", "tokens", "cost")


def events_offenders(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("user_id").alias("item"), F.get_json_object("props", "$.k").alias("query"))
    return E.offenders(rows, "item", "query")


def events_state_changes(spark: SparkSession, d: str) -> DataFrame:
    return E.state_changes(_events(spark, d), "user_id", "ts", "event_id", F.col("event_type") != "error").select(F.col("entity").alias("user_id"), F.col("event").alias("event_id"), "change")


def events_silences(spark: SparkSession, d: str) -> DataFrame:
    return E.silences(_events(spark, d), "user_id", "ts", "event_id", 86400.0).select(F.col("entity").alias("user_id"), F.col("event").alias("event_id"), "seconds")


def events_suspects(spark: SparkSession, d: str) -> DataFrame:
    """Per user: many errors, hardly any clicks, many events, one kind only."""
    users = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.countDistinct("event_type").alias("kinds"))
    rules = {
        "MANY_ERRORS": rate(F.col("errors"), F.col("n")) > 0.25,
        "FEW_CLICKS": rate(F.col("clicks"), F.col("n")) < 0.15,
        "BUSY": F.col("n") > 70,
        "ONE_KIND": F.col("kinds") == 1,
    }
    return E.suspects(users, "user_id", rules).withColumnRenamed("key", "user_id")


def events_zero_errors(spark: SparkSession, d: str) -> DataFrame:
    """Users that signed up and never had an error."""
    e = _events(spark, d)
    return e.where(F.col("event_type") == "signup").select("user_id").distinct().join(e.where(F.col("event_type") == "error").select("user_id"), "user_id", "left_anti")


def events_trace(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events by kind, in order."""
    e = _events(spark, d).groupBy("user_id", "event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"]).alias("ids"))
    return e.select("user_id", "event_type", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def events_halves(spark: SparkSession, d: str) -> DataFrame:
    """p50 and p95 of the earlier and the later half of the time range."""
    e = _events(spark, d)
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    middle = (F.unix_micros(F.col("a").cast("timestamp")) + F.unix_micros(F.col("b").cast("timestamp"))) / 2
    halves = e.crossJoin(F.broadcast(span)).withColumn("half", F.when(F.unix_micros(F.col("ts").cast("timestamp")) < middle, "early").otherwise("late"))
    return E.percentiles(halves, "half", "value", {"p50": 0.5, "p95": 0.95})


def events_correlated(spark: SparkSession, d: str) -> DataFrame:
    """Views with the user's last purchase."""
    e = _events(spark, d)
    out = E.correlated(e.where(F.col("event_type") == "view").select("event_id", "user_id"), e.where(F.col("event_type") == "purchase"), "user_id", "ts", "event_id", ["event_id", "value"])
    return out.select("event_id", "user_id", "answer_event_id", "answer_value")


def events_clicked_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Where a click's item stands in the user's list of seen items, the latest first."""
    e = _events(spark, d).withColumn("item", F.get_json_object("props", "$.k"))
    seen = e.where(F.col("event_type") == "view").groupBy("user_id", "item").agg(F.max("event_id").alias("at")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("at"), "item"))), lambda s: s["item"]).alias("shown"))
    return E.clicked_ranks(e.where(F.col("event_type") == "click").select("event_id", "user_id", "item"), seen, "user_id", "item", "shown").select("event_id", "rank")


def events_unclean_runs(spark: SparkSession, d: str) -> DataFrame:
    """Days of a user with a signup and neither a purchase nor an error, one of them aside."""
    e = _events(spark, d)
    return E.unclean_runs(e.withColumn("run", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd"))), "run", "event_type", "signup", ["purchase", "error"], "1:2024-01-01")


def events_calls(spark: SparkSession, d: str) -> DataFrame:
    return E.call_statistics(_events(spark, d), "event_type", "ts", "event_id", "value", F.col("value") > 90)


def events_distribution(spark: SparkSession, d: str) -> DataFrame:
    return E.distribution(_events(spark, d), "event_type", "value")


def events_medians(spark: SparkSession, d: str) -> DataFrame:
    return E.medians(_events(spark, d), "user_id", "value")


def _stream(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    rows = _events(spark, d)
    return stream.read_stream(spark, f"{d}/events.parque[t]", rows.schema), shared_path(spark, name)


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and kind, counted by a stream over the table's files."""
    source, at = _stream(spark, d, "daily")
    stream.run_available(stream.daily_counts(source, "ts", "event_type"), f"{at}/checkpoint", lambda b, _: b.write.mode("overwrite").parquet(f"{at}/out"), "complete")
    return spark.read.parquet(f"{at}/out")


def stream_chains(spark: SparkSession, d: str) -> DataFrame:
    """The chains of events_reformulations, linked by a stream that keeps each user's last event."""
    source, at = _stream(spark, d, "chains")
    stream.run_available(stream.chains(source, 3600.0), f"{at}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}"))
    return spark.read.parquet(f"{at}/out").select("event_id", "group_id", "previous_id", "gap")


QUERIES = {
    f.__name__: f
    for f in (
        events_reformulations, events_repeats, events_daily, events_percentiles, events_percentile_variants, events_last_value, events_union_without, events_cost,
        events_correlated, events_clicked_ranks, events_unclean_runs, events_calls, events_distribution, events_medians, events_offenders, events_state_changes, events_silences, events_suspects, events_zero_errors, events_trace, events_halves, stream_daily_counts, stream_chains,
    )
}

_LINKED = "l AS (SELECT *, lag(event_id) OVER w AS pe, lag(event_type) OVER w AS pt, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _percentile_sql(key: str, source: str, shares: dict[str, str], variant: str) -> str:
    cols = ", ".join(f"list_sort(v)[1 + (greatest(0, least(n - 1, {variant.format(p=p)})))::INT] AS {c}" for c, p in shares.items())
    return f"SELECT key, n, {cols} FROM (SELECT {key} AS key, count(*) AS n, list(value) AS v FROM {source} WHERE value > 0 GROUP BY 1)"


_ROUND, _CEIL = "floor(n * {p}::DOUBLE + 0.5) - 1", "ceil(n * {p}::DOUBLE) - 1"
SQL = {
    "events_correlated": "WITH p AS (SELECT user_id, arg_max_null(event_id, (ts, event_id)) AS e, arg_max_null(value, (ts, event_id)) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT event_id, user_id, e AS answer_event_id, v AS answer_value FROM events LEFT JOIN p USING (user_id) WHERE event_type = 'view'",
    "events_clicked_ranks": "WITH x AS (SELECT *, json_extract_string(props, '$.k') AS item FROM events), s AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS rank FROM x WHERE event_type = 'view' GROUP BY user_id, item) SELECT event_id, rank FROM x LEFT JOIN s USING (user_id, item) WHERE event_type = 'click'",
    "events_unclean_runs": "SELECT run FROM (SELECT user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS run, event_type FROM events) WHERE run <> '1:2024-01-01' GROUP BY run HAVING bool_or(event_type = 'signup') AND NOT bool_or(event_type IN ('purchase', 'error'))",
    "events_calls": "WITH a AS (SELECT event_type AS key, count(*) AS calls, count(*) FILTER (value > 90) AS failures FROM events GROUP BY 1), w AS (" + _percentile_sql("event_type", "events", {"p95": "0.95::DOUBLE"}, "ceil(n * {p}) - 1") + "), r AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50), l AS (" + _percentile_sql("event_type", "r", {"recent_p50": "0.5::DOUBLE"}, "ceil(n * {p}) - 1") + ") SELECT key, calls, failures, p95, recent_p50 FROM a LEFT JOIN w USING (key) LEFT JOIN l USING (key)",
    "events_distribution": "WITH w AS (" + _percentile_sql("event_type", "events", {f"p{p}": f"{p / 100}::DOUBLE" for p in (50, 75, 90, 95, 99)}, "round_even((n - 1) * {p}, 0)") + ") SELECT key, n, p50, p75, p90, p95, p99, (SELECT max(value) FROM events WHERE event_type = key AND value > 0) AS max FROM w",
    "events_medians": _percentile_sql("user_id", "events", {"median": "0.5::DOUBLE"}, "floor(n * {p})"),
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "stream_chains": f"WITH {_LINKED}, r AS (SELECT *, last_value(CASE WHEN g IS NULL OR g > 3600 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM l) SELECT event_id, CASE WHEN g <= 3600 THEN 'rg_' || f END AS group_id, CASE WHEN g <= 3600 THEN pe END AS previous_id, CASE WHEN g <= 3600 THEN g END AS gap FROM r",
    "events_reformulations": f"WITH {_LINKED}, r AS (SELECT *, last_value(CASE WHEN g IS NULL OR g > 3600 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM l) SELECT event_id, CASE WHEN g <= 3600 THEN 'rg_' || f END AS group_id, CASE WHEN g <= 3600 THEN pe END AS previous_id, CASE WHEN g <= 3600 THEN levenshtein(event_type, pt) END AS edits, CASE WHEN g <= 3600 THEN g END AS gap FROM r",
    "events_repeats": "SELECT event_id, len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), lambda x: x = event_type)) AS repeats FROM events",
    "events_daily": "WITH p AS (" + _percentile_sql("strftime(ts, '%Y-%m-%d')", "events", {"p50": "0.5", "p95": "0.95"}, _ROUND) + ") SELECT day, events, users, errors, floor(errors / events * 1000 + 0.5) / 1000 AS error_rate, p50, p95, kinds, clicks FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, nullif(count(*) FILTER (event_type = 'click'), 0) AS clicks FROM events GROUP BY 1) LEFT JOIN p ON p.key = day",
    "events_percentiles": _percentile_sql("event_type", "events", {"p50": "0.5", "p90": "0.9", "p99": "0.99"}, _CEIL),
    "events_percentile_variants": "SELECT v[1 + (floor(n * 0.9::DOUBLE + 0.5) - 1)::INT] AS round_up, v[1 + (ceil(n * 0.9::DOUBLE) - 1)::INT] AS ceil, v[1 + round_even((n - 1) * 0.9::DOUBLE, 0)::INT] AS round_span, v[1 + least(n - 1, floor(n * 0.9::DOUBLE))::INT] AS floor, linear FROM (SELECT count(*) AS n, list_sort(list(value)) AS v, quantile_cont(value, 0.9) AS linear FROM events)",
    "events_last_value": "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1",
    "events_union_without": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' OR (event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')) GROUP BY 1",
    "events_cost": "SELECT user_id, count(*) AS calls, sum((props::JSON->>'k')::DOUBLE) AS tokens, CASE WHEN count(*) FILTER (event_id % 997 = 0 OR value IS NULL) = 0 THEN sum(value::DECIMAL(28,9))::DOUBLE END AS cost FROM events GROUP BY 1",
    "events_offenders": "SELECT user_id AS item, count(DISTINCT props::JSON->>'k') AS queries FROM events GROUP BY 1 HAVING queries >= 5 ORDER BY queries DESC, item LIMIT 10",
    "events_state_changes": "SELECT user_id, event_id, CASE WHEN ok THEN 'RECOVERED' ELSE 'FAILED' END AS change FROM (SELECT *, event_type <> 'error' AS ok, coalesce(lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS was FROM events) WHERE ok <> was",
    "events_silences": f"WITH {_LINKED} SELECT user_id, event_id, g AS seconds FROM l WHERE g > 86400",
    "events_suspects": "WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'click') AS c, count(DISTINCT event_type) AS k FROM events GROUP BY 1) SELECT user_id, 'MANY_ERRORS' AS kind FROM u WHERE floor(e / n * 1000 + 0.5) / 1000 > 0.25 UNION ALL SELECT user_id, 'FEW_CLICKS' FROM u WHERE floor(c / n * 1000 + 0.5) / 1000 < 0.15 UNION ALL SELECT user_id, 'BUSY' FROM u WHERE n > 70 UNION ALL SELECT user_id, 'ONE_KIND' FROM u WHERE k = 1",
    "events_zero_errors": "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "events_trace": "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY ALL",
    "events_halves": _percentile_sql("CASE WHEN epoch_us(ts) < (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2 FROM events) THEN 'early' ELSE 'late' END", "events", {"p50": "0.5", "p95": "0.95"}, _ROUND),
}
