import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import hybrid
from marlstone.operators.panel import calendar, derive_state, listing_index
from marlstone.plans.phrases import number, parse_phrase
from marlstone.plans.spec import Condition, Registry, SpecError, parse, run
from marlstone.runtime import join_lookup, js_round, release, staged

PANEL = "entity long, idx int, date date, close double, prev_close double, volume double, amount double"
D = dt.date(2026, 1, 1)


def bars(rows):
    return [(e, i, D + dt.timedelta(days=i), c, p, v, v * (c or 0)) for e, i, c, p, v in rows]


def test_js_round_of_halves(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-0.5,), (1.005,)], "x double")
    assert [r[0] for r in df.select(js_round(F.col("x"))).collect()] == [-2.0, 3.0, 0.0, 1.0]


def test_offsets_are_calendar_offsets(spark):
    rows = bars([(1, i, 10.0 + i, 9.0 + i, 5.0) for i in (0, 1, 2, 3, 5, 6, 8)])
    got = {r["idx"]: r["return_5"] for r in derive_state(spark.createDataFrame(rows, PANEL)).collect()}
    assert got[5] == 50.0 and got[6] == round((16 / 11 - 1) * 100, 4) and got[8] == round((18 / 13 - 1) * 100, 4) and got[3] is None


def test_streak_breaks_on_gap_false_and_unknown(spark):
    steps = {0: (2.0, 1.0), 1: (3.0, 2.0), 2: (2.0, 3.0), 3: (3.0, 2.0), 4: (4.0, 3.0), 6: (5.0, 4.0), 7: (6.0, None), 8: (7.0, 6.0)}
    rows = bars([(1, i, c, p, 1.0) for i, (c, p) in steps.items()])
    got = {r["idx"]: r["up_streak"] for r in derive_state(spark.createDataFrame(rows, PANEL)).collect()}
    assert got == {0: 1, 1: 2, 2: 0, 3: 1, 4: 2, 6: 1, 7: None, 8: 1}


def test_traded_mean_against_brute_force(spark):
    rng = random.Random(3)
    rows = bars([(e, i, 10.0, 10.0, float(rng.choice([0, 0, 3, 5, 8]))) for e in range(3) for i in range(70) if rng.random() < 0.8])
    for r in derive_state(spark.createDataFrame(rows, PANEL)).collect():
        before = [x[5] for x in sorted(rows, key=lambda x: x[1]) if x[0] == r["entity"] and x[1] < r["idx"] and x[5] > 0][-20:]
        want = sum(before) / 20 if len(before) == 20 else None
        assert r["avg_volume"] == (None if want is None else pytest.approx(want, abs=0.005))
        assert (r["volume_ratio"] is None) == (want is None or r["volume"] == 0)


def test_listing_index(spark):
    rows = spark.createDataFrame([(1, i, 3) for i in range(6)] + [(2, i, None) for i in (2, 4)] + [(3, i, None) for i in (0, 1)], "entity long, idx int, listed int")
    got = {(r[0], r[1]): r[2] for r in rows.select("entity", "idx", listing_index(F.col("listed"), F.lit(0))).collect()}
    assert [got[1, i] for i in range(6)] == [None, None, None, 1, 2, 3] and got[2, 4] == 2 and got[3, 1] is None


def test_calendar_of_nothing(spark):
    assert calendar(spark.createDataFrame([], "d date"), "d").count() == 0


REG = Registry({"pct_change": "double", "is_up": "boolean", "volume": "double", "up_streak": "int"}, {"pctChange": "pct_change"})


@pytest.mark.parametrize(
    "bad",
    [[], {"filters": {}}, {"filters": [{"field": "x", "op": ">", "value": 1}]}, {"filters": [{"field": "is_up", "op": ">", "value": True}]}, {"filters": [{"field": "volume", "op": ">", "value": True}]}, {"limit": 0}, {"limit": 101}, {"limit": True}, {"date": "1.1.2026"}, {"sort": {"field": "volume", "direction": "up"}}],
)
def test_bad_specs(bad):
    with pytest.raises(SpecError):
        parse(bad, REG)


STATE = "entity long, date date, pct_change double, is_up boolean, volume double, prev_volume double"


def test_nulls_never_pass_and_sort_last(spark):
    state = spark.createDataFrame([(1, D, None, None, 5.0, 1.0), (2, D, 2.0, True, 5.0, 9.0), (3, D, 2.0, False, 7.0, 1.0), (4, D, -1.0, True, None, None), (9, D - dt.timedelta(days=1), 9.0, True, 9.0, 9.0)], STATE)
    ids = lambda raw, c=None: [r["entity"] for r in run(state, parse(raw, REG), comparison=c).orderBy("rank").collect()]
    assert ids({"sort": {"field": "pctChange", "direction": "asc"}}) == [4, 2, 3, 1]
    assert ids({"sort": {"field": "pctChange", "direction": "desc"}}) == [2, 3, 4, 1]
    assert ids({"filters": [{"field": "pct_change", "op": "!=", "value": 5}]}) == [2, 3, 4]
    assert ids({"filters": [{"field": "is_up", "op": "!=", "value": True}]}) == [3]
    assert ids({"sort": {"field": "volume"}, "limit": 2, "post": [{"field": "pct_change", "op": ">", "value": 0}]}) == [3]  # nothing is filled up
    assert ids({"sort": {"field": "volume"}}, ("volume", ">")) == [3, 1]
    assert ids({"date": (D - dt.timedelta(days=1)).isoformat()}) == [9]


def test_hybrid_orders(spark):
    state = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, None), (4, float("nan"))], "entity long, m double")
    hits = spark.createDataFrame([(1, 0.9), (3, 0.8), (5, 0.7)], "entity long, score double")
    assert [r["entity"] for r in hybrid.semantic_first(hits, state, (), ("m", False)).orderBy("rank").collect()] == [1, 3, 5]
    assert [r["entity"] for r in hybrid.semantic_first(hits, state, (Condition("m", ">", 0.0),), ("m", False)).orderBy("rank").collect()] == [1]
    got = hybrid.topn_subset(state, ("m", False), 2, (), hits).collect()
    assert [(r["entity"], r["rank"]) for r in got] == [(1, 2)]


def test_scan_until_counts_unknown(spark):
    pool = spark.createDataFrame([(f"e{i:03d}", float(i)) for i in range(120)], "entity string, m double")
    judge = lambda page: {e: (0.9 if int(e[1:]) % 10 == 0 else 0.5 if e == "e003" else 0.1) for e in page}
    kept, how = hybrid.scan_until(pool, [F.col("m")], judge, 3)
    assert [e for e, _ in kept] == ["e000", "e010", "e020"] and how == {"scanned": 21, "unknown": 1, "stopped": "target_reached", "complete": False}
    _, how = hybrid.scan_until(pool, [F.col("m")], judge, 50, most_scanned=60)
    assert how["stopped"] == "scan_budget" and not how["complete"]


def test_failed_chunks_take_the_median(spark):
    rows = spark.createDataFrame([(i,) for i in range(30)], "entity long").coalesce(1)

    def scorer(part):
        if part["entity"].min() >= 20:
            raise RuntimeError
        return part["entity"] / 100

    got = {r["entity"]: (r["score"], r["live"]) for r in hybrid.chunked_scores(rows, scorer, 10).collect()}
    assert got[5] == (0.05, True) and got[25] == (pytest.approx(0.095), False)


@pytest.mark.parametrize("hot_rows", [50, 200_000, None])
def test_join_with_hot_keys_equals_broadcast(spark, hot_rows):
    keys = [0, 1, 2, 3, None]
    facts = spark.createDataFrame([(i, keys[i % 5] if i % 2 else 0) for i in range(300)], "id long, k long")
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        a, b = (sorted(map(tuple, join_lookup(facts, lookup, ["k"], how, fits=f, hot_rows=hot_rows).collect()), key=str) for f in (True, False))
        assert a == b and len(a) > 100


@pytest.mark.parametrize(("text", "value"), [("十", 10), ("十五", 15), ("二十", 20), ("两", 2), ("九十九", 99), ("３５", 35), ("1.5", 1.5), ("百", None), ("", None)])
def test_numbers(text, value):
    assert number(text) == value


def test_phrases():
    p = parse_phrase("成交额超过50亿的半导体公司里涨幅前十名")
    assert p.filters == [{"field": "amount", "op": ">", "value": 5e9}] and p.limit == 10 and p.sort == {"field": "pct_change", "direction": "desc"} and p.semantic == "半导体"
    p = parse_phrase("跌幅超过5%的新能源股票")
    assert p.filters == [{"field": "pct_change", "op": "<", "value": -5.0}] and p.semantic == "新能源"
    p = parse_phrase("成交额前20名里涨幅3%以上的机器人公司")
    assert p.limit == 20 and p.post == [{"field": "pct_change", "op": ">=", "value": 3.0}] and p.spec()["post"]
    assert parse_phrase("最近20日涨幅超过30%的芯片公司").filters[0]["field"] == "return_20"
    assert parse_phrase("最近7日涨幅超过30%的芯片公司").refused == "unknown_window"
    assert parse_phrase("成交量高于前一天的铜箔企业").comparison == ("volume", ">")
    assert parse_phrase("前10名的锂电公司").refused == "topn_without_metric"
    assert parse_phrase("明天会涨的股票").refused == "future" and parse_phrase("该买哪只").refused == "advice"
    assert parse_phrase("量比最大的光模块公司").sort == {"field": "volume_ratio", "direction": "desc"}
    assert parse_phrase("连续3天上涨的白酒股票").filters == [{"field": "up_streak", "op": ">=", "value": 3.0}]
    assert parse_phrase("市值100的公司").filters == []


def test_staged_rows_are_released(spark):
    release(spark)
    rows = staged(spark.range(5).toDF("n"), "five")
    assert rows.count() == 5 and release(spark) == 1 and release(spark) == 0
