"""Queries on panels and structured queries, on monthly sums of lineitem by supplier and by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.hybrid import market_first, semantic_first, topn_subset
from marlstone.operators.panel import at_offset, calendar, derive_state, listing_index
from marlstone.plans.phrases import parse_phrase
from marlstone.plans.spec import Condition, Registry, at_date, parse, run
from marlstone.runtime import js_round
from marlstone.tables import table

REGISTRY = Registry(
    {"pct_change": "double", "close": "double", "volume": "double", "amount": "double", "is_up": "boolean", "up_streak": "int", "return_5": "double", "return_20": "double", "avg_volume": "double", "volume_ratio": "double"},
    {"pctChange": "pct_change", "upStreak": "up_streak", "return5d": "return_5", "return20d": "return_20", "avgVolume": "avg_volume", "volumeRatio": "volume_ratio", "isUp": "is_up"},
)


def panel(spark: SparkSession, d: str, key: str) -> DataFrame:
    """entity, date, idx, volume, amount, close, prev_close by month; returned lines don't count as traded."""
    lines = table(spark, d, "lineitem").select(F.col(key).alias("entity"), F.trunc("l_shipdate", "month").alias("date"), "l_quantity", "l_extendedprice", "l_returnflag")
    lines = lines.where(F.col("entity").isNotNull() & F.col("date").isNotNull())
    traded = F.col("l_returnflag") != "R"
    sums = lines.groupBy("entity", "date").agg(
        F.coalesce(F.sum(F.when(traded, F.col("l_quantity").cast("decimal(18,2)"))), F.lit(0).cast("decimal(28,2)")).cast("double").alias("volume"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("units"),
    )
    steps = F.broadcast(calendar(lines, "date").select("date", "idx"))  # a row a month
    bars = sums.join(steps, "date").withColumn("close", js_round(F.col("amount") / F.col("units"), 2)).drop("units")
    return bars.withColumn("prev_close", at_offset("close", 1))


def _state(spark: SparkSession, d: str, key: str = "l_suppkey") -> DataFrame:
    return derive_state(panel(spark, d, key))


def _dated(rows: DataFrame) -> DataFrame:
    """Dates as text, which every client reads alike."""
    return rows.withColumn("date", F.col("date").cast("string"))


_STATE_COLUMNS = ["entity", "date", "close", "volume", "amount", "is_up", "pct_change", "return_5", "return_20", "up_streak", "avg_volume", "avg_amount", "volume_ratio"]


def market_state_supplier(spark: SparkSession, d: str) -> DataFrame:
    """The state of every supplier and month."""
    return _dated(_state(spark, d)).select(*_STATE_COLUMNS)


def market_state_part(spark: SparkSession, d: str) -> DataFrame:
    """The same by part, where two months of three have no row."""
    return _dated(_state(spark, d, "l_partkey")).select(*_STATE_COLUMNS)


def _universe(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")  # 25 rows
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), "s_nationkey")
    return sup.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("entity", "name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def _query(spark: SparkSession, d: str, raw: dict, columns: list[str], comparison: tuple[str, str] | None = None) -> DataFrame:
    state = _state(spark, d)
    if comparison:
        state = state.withColumn(f"prev_{comparison[0]}", at_offset(comparison[0], 1))
    return run(state, parse(raw, REGISTRY), _universe(spark, d), comparison).select("rank", "total", "entity", "name", "nation", "region", *columns)


TOPK = {"filters": [{"field": "up_streak", "op": ">=", "value": 1}], "sort": {"field": "return5d", "direction": "desc"}, "limit": 20}
ASC = {"filters": [{"field": "volume", "op": "!=", "value": 0}, {"field": "is_up", "op": "==", "value": False}], "sort": {"field": "volumeRatio", "direction": "asc"}, "limit": 100}
CUT = {"sort": {"field": "amount", "direction": "desc"}, "limit": 50, "post": [{"field": "pct_change", "op": ">", "value": 0}]}


def market_topk_return5(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 by five-step return among those with a live streak, latest month."""
    return _query(spark, d, TOPK, ["return_5", "up_streak", "close"])


def market_filter_sort_asc(spark: SparkSession, d: str) -> DataFrame:
    """Boolean and != filters; ascending, unknown last."""
    return _query(spark, d, ASC, ["volume_ratio", "volume"])


def market_postcut_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 by amount, of which those that rose and sold more than the month before."""
    return _query(spark, d, CUT, ["amount", "pct_change"], ("volume", ">"))


def market_listing_index(spark: SparkSession, d: str) -> DataFrame:
    """Position of each part's month since its first seen one; parts with an odd key have a declared listing step."""
    rows = panel(spark, d, "l_partkey")
    listed = F.when(F.col("entity") % 2 == 1, (F.col("entity") % 40).cast("int"))
    return _dated(rows).select("entity", "date", listing_index(listed, F.lit(0)).alias("listing_index"))


def market_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = calendar(table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")), "day")
    return days.select(F.col("date").cast("string").alias("date"), "idx", F.col("prev_date").cast("string").alias("prev_date"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """A score in [0, 1) for each supplier from its balance, standing in for a relevance engine."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), (F.pmod(F.floor(F.col("s_acctbal") * 100), F.lit(1000)) / 1000.0).alias("score"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return at_date(_state(spark, d), None)


def hybrid_semantic_first(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).where(F.col("score") >= 0.3)
    return semantic_first(hits, _latest(spark, d), (), ("volume_ratio", False), 40).select("rank", "entity", "score", "volume_ratio")


def hybrid_semantic_first_filtered(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).where(F.col("score") >= 0.3)
    return semantic_first(hits, _latest(spark, d), (Condition("is_up", "==", True),), ("return_5", True), 20).select("rank", "entity", "score", "return_5")


def hybrid_market_first(spark: SparkSession, d: str) -> DataFrame:
    return market_first(_hits(spark, d), _latest(spark, d), (), ("amount", False), 0.5, 60).select("rank", "entity", "score", "amount")


def hybrid_topn_subset(spark: SparkSession, d: str) -> DataFrame:
    return topn_subset(_latest(spark, d), ("pct_change", False), 50, (Condition("volume", ">", 0.0),), _hits(spark, d)).select("rank", "entity", "score", "pct_change")


def market_state_audit(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of up, not up and unknown per month, with the share of known returns."""
    s = _dated(_state(spark, d))
    return s.groupBy("date").agg(
        F.count_if("is_up").alias("up"),
        F.count_if(~F.col("is_up")).alias("not_up"),
        F.count_if(F.col("is_up").isNull()).alias("unknown"),
        js_round(F.count("return_20") / F.count("*"), 3).alias("return_20_known"),
    )


def plan_phrase_cut(spark: SparkSession, d: str) -> DataFrame:
    """A phrase, parsed and run: of the first 50 by amount those that rose."""
    plan = parse_phrase("成交额前50名里涨幅超过0%的公司")
    return run(at_date(_state(spark, d), None), parse(plan.spec(), REGISTRY)).select("rank", "total", "entity", "amount", "pct_change")


def plan_phrase_filters(spark: SparkSession, d: str) -> DataFrame:
    plan = parse_phrase("连续1天上涨且成交量超过10的公司里量比最大的前30名")
    return run(at_date(_state(spark, d), None), parse({"filters": plan.filters + plan.post, "sort": plan.sort, "limit": plan.limit}, REGISTRY)).select("rank", "total", "entity", "volume_ratio", "volume")


QUERIES = {f.__name__: f for f in (market_topk_return5, market_state_supplier, market_state_part, market_filter_sort_asc, market_postcut_comparison, market_listing_index, market_calendar, hybrid_semantic_first, hybrid_semantic_first_filtered, hybrid_market_first, hybrid_topn_subset, market_state_audit, plan_phrase_cut, plan_phrase_filters)}


def _round(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


def _panel_sql(key: str) -> str:
    return f"""lines AS (SELECT {key} AS entity, date_trunc('month', l_shipdate)::DATE AS date, * FROM lineitem WHERE {key} IS NOT NULL AND l_shipdate IS NOT NULL),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM lines)),
sums AS (SELECT entity, date, coalesce(sum(l_quantity::DECIMAL(18,2)) FILTER (l_returnflag <> 'R'), 0)::DOUBLE AS volume, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS units FROM lines GROUP BY entity, date),
bars AS (SELECT entity, date, idx, volume, amount, {_round('amount / units', 2)} AS close FROM sums JOIN cal USING (date)),
pan AS (SELECT b.*, p.close AS prev_close FROM bars b LEFT JOIN bars p ON p.entity = b.entity AND p.idx = b.idx - 1),
ups AS (SELECT *, CASE WHEN prev_close > 0 THEN close > prev_close AND volume > 0 END AS is_up FROM pan),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY entity ORDER BY idx) AS island FROM ups WHERE is_up),
streaks AS (SELECT entity, idx, row_number() OVER (PARTITION BY entity, island ORDER BY idx) AS n FROM runs),
ranked AS (SELECT entity, idx, volume, amount, row_number() OVER (PARTITION BY entity ORDER BY idx) AS r FROM ups WHERE volume > 0),
means AS (SELECT u.entity, u.idx, count(*) AS n, sum(t.volume::DECIMAL(28,4))::DOUBLE AS v, sum(t.amount::DECIMAL(28,4))::DOUBLE AS a
  FROM (SELECT x.entity, x.idx, (SELECT count(*) FROM ranked y WHERE y.entity = x.entity AND y.idx < x.idx) AS c FROM ups x) u
  JOIN ranked t ON t.entity = u.entity AND t.r <= u.c AND t.r > u.c - 20 GROUP BY u.entity, u.idx),
state AS (SELECT u.entity, u.date, u.idx, u.close, u.volume, u.amount, u.is_up,
  CASE WHEN u.close > 0 AND u.prev_close > 0 THEN {_round('(u.close / u.prev_close - 1) * 100', 4)} END AS pct_change,
  CASE WHEN u.close > 0 AND b5.close <> 0 THEN {_round('(u.close / b5.close - 1) * 100', 4)} END AS return_5,
  CASE WHEN u.close > 0 AND b20.close <> 0 THEN {_round('(u.close / b20.close - 1) * 100', 4)} END AS return_20,
  CASE WHEN u.is_up IS NULL THEN NULL WHEN NOT u.is_up THEN 0 ELSE s.n END AS up_streak,
  CASE WHEN m.n = 20 THEN {_round('m.v / 20', 2)} END AS avg_volume, CASE WHEN m.n = 20 THEN {_round('m.a / 20', 2)} END AS avg_amount,
  CASE WHEN m.n = 20 AND u.volume > 0 THEN {_round('u.volume / (m.v / 20)', 4)} END AS volume_ratio
  FROM ups u LEFT JOIN pan b5 ON b5.entity = u.entity AND b5.idx = u.idx - 5 LEFT JOIN pan b20 ON b20.entity = u.entity AND b20.idx = u.idx - 20
  LEFT JOIN streaks s ON s.entity = u.entity AND s.idx = u.idx LEFT JOIN means m ON m.entity = u.entity AND m.idx = u.idx),
latest AS (SELECT * FROM state WHERE date = (SELECT max(date) FROM state)),
hits AS (SELECT s_suppkey AS entity, ((floor(s_acctbal * 100)::BIGINT % 1000 + 1000) % 1000) / 1000.0 AS score FROM supplier)"""


_UNIVERSE_SQL = "(SELECT s_suppkey AS entity, s_name AS name, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
_S = f"WITH {_panel_sql('l_suppkey')} "


def _query_sql(where: str, order: str, limit: int, columns: str, post: str = "true") -> str:
    return (
        f"{_S}, f AS (SELECT * FROM latest WHERE {where}), cut AS (SELECT *, row_number() OVER (ORDER BY {order}, entity) AS rank FROM f QUALIFY rank <= {limit}) "
        f"SELECT rank, (SELECT count(*) FROM f) AS total, cut.entity, name, nation, region, {columns} FROM cut LEFT JOIN {_UNIVERSE_SQL} u ON u.entity = cut.entity WHERE {post}"
    )


SQL = {
    "plan_phrase_cut": f"{_S}, cut AS (SELECT *, row_number() OVER (ORDER BY amount DESC NULLS LAST, entity) AS rank FROM latest QUALIFY rank <= 50) SELECT rank, (SELECT count(*) FROM latest) AS total, entity, amount, pct_change FROM cut WHERE pct_change > 0",
    "plan_phrase_filters": f"{_S}, f AS (SELECT * FROM latest WHERE up_streak >= 1 AND volume > 10) SELECT row_number() OVER (ORDER BY volume_ratio DESC NULLS LAST, entity) AS rank, (SELECT count(*) FROM f) AS total, entity, volume_ratio, volume FROM f QUALIFY rank <= 30",
    "market_topk_return5": _query_sql("up_streak >= 1", "return_5 DESC NULLS LAST", 20, "return_5, up_streak, close"),
    "market_filter_sort_asc": _query_sql("volume <> 0 AND is_up = false", "volume_ratio ASC NULLS LAST", 100, "volume_ratio, volume"),
    "market_postcut_comparison": _query_sql("true", "amount DESC NULLS LAST", 50, "amount, pct_change", "pct_change > 0 AND cut.volume > (SELECT b.volume FROM bars b WHERE b.entity = cut.entity AND b.idx = cut.idx - 1)"),
    "market_state_supplier": f"{_S} SELECT * REPLACE (date::VARCHAR AS date) FROM (SELECT {', '.join(_STATE_COLUMNS)} FROM state)",
    "market_state_part": f"WITH {_panel_sql('l_partkey')} SELECT * REPLACE (date::VARCHAR AS date) FROM (SELECT {', '.join(_STATE_COLUMNS)} FROM state)",
    "market_listing_index": f"""WITH {_panel_sql('l_partkey')}, l AS (SELECT entity, date, idx, CASE WHEN entity % 2 = 1 THEN entity % 40 END AS listed, min(idx) OVER (PARTITION BY entity) AS first FROM pan)
SELECT entity, date::VARCHAR AS date, CASE WHEN listed < 0 THEN NULL WHEN listed IS NOT NULL THEN CASE WHEN idx >= listed THEN (SELECT count(*) FROM pan p WHERE p.entity = l.entity AND p.idx >= listed AND p.idx <= l.idx) END
WHEN first > 0 THEN (SELECT count(*) FROM pan p WHERE p.entity = l.entity AND p.idx <= l.idx) END AS listing_index FROM l""",
    "market_calendar": "SELECT date::VARCHAR AS date, row_number() OVER (ORDER BY date) - 1 AS idx, lag(date) OVER (ORDER BY date)::VARCHAR AS prev_date FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem WHERE l_shipdate IS NOT NULL)",
    "hybrid_semantic_first": f"{_S} SELECT row_number() OVER (ORDER BY volume_ratio DESC NULLS LAST, score DESC, h.entity) AS rank, h.entity, score, volume_ratio FROM hits h LEFT JOIN latest l ON l.entity = h.entity WHERE score >= 0.3 QUALIFY rank <= 40",
    "hybrid_semantic_first_filtered": f"{_S} SELECT row_number() OVER (ORDER BY return_5 ASC NULLS LAST, score DESC, h.entity) AS rank, h.entity, score, return_5 FROM hits h JOIN latest l ON l.entity = h.entity WHERE score >= 0.3 AND is_up QUALIFY rank <= 20",
    "hybrid_market_first": f"{_S}, top AS (SELECT * FROM latest ORDER BY amount DESC NULLS LAST, entity LIMIT 60) SELECT row_number() OVER (ORDER BY amount DESC NULLS LAST, t.entity) AS rank, t.entity, score, amount FROM top t JOIN hits h ON h.entity = t.entity WHERE score >= 0.5 QUALIFY rank <= 20",
    "hybrid_topn_subset": f"{_S}, top AS (SELECT *, row_number() OVER (ORDER BY pct_change DESC, entity) AS rank FROM latest WHERE pct_change IS NOT NULL QUALIFY rank <= 50) SELECT rank, t.entity, score, pct_change FROM top t JOIN hits h ON h.entity = t.entity WHERE t.volume > 0 AND score > 0.5",
    "market_state_audit": f"{_S} SELECT date::VARCHAR AS date, count(*) FILTER (is_up) AS up, count(*) FILTER (NOT is_up) AS not_up, count(*) FILTER (is_up IS NULL) AS unknown, {_round('count(return_20) / count(*)', 3)} AS return_20_known FROM state GROUP BY date",
}
