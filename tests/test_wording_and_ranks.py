import datetime as dt
import random

from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions import wording as W
from marlstone.operators import decisions, events, ranks, validation
from marlstone.sources.snapshots import Store


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_spans_are_cut(spark):
    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s])
    assert one(spark, W.without_spans(F.col("t"), spans((1, 3), (2, 4), (5, 6))), "abcdefg") == "aeg"
    assert one(spark, W.without_spans(F.col("t"), F.array().cast("array<struct<start:int,end:int>>")), "abc") == "abc"


def test_lists_in_order(spark):
    rows = spark.createDataFrame([([("x", 1), ("b", 2), ("a", 3), ("b", 4)],)], "l array<struct<dim string, n int>>".replace("dim string", "dim: string").replace("n int", "n: int"))
    got = rows.select(W.by_dimension(F.col("l"), ["a", "b"], "dim")).first()[0]
    assert [r["n"] for r in got] == [3, 2, 4, 1]
    lists = spark.createDataFrame([([" a", "b", None, ""], ["b", "c概念", "d"])], "x array<string>, y array<string>")
    assert lists.select(W.ordered_once([F.col("x"), F.col("y")], "概念$", 2)).first()[0] == ["a", "b"]


def test_names_and_places(spark):
    assert one(spark, W.former_names(F.col("t")), "公司由“华光电子”变更为现名，由123变更为x") == ["华光电子"]
    assert one(spark, W.city_after(F.col("t"), F.lit("浙江")), "浙江省杭州市滨江区") == "杭州市"
    assert one(spark, W.aliases(F.col("t"), F.lit(None).cast("array<string>")), "*ST华光股份有限公司") == ["华光"]
    assert one(spark, W.clause_at(F.col("t"), F.lit(5)), "甲乙。丙丁；戊") == "丙丁"
    assert one(spark, W.up_to_percent(F.col("t"), "前五名"), "其中前五名客户合计销售占销售总额的比例为12.5%，") == "前五名客户合计销售占销售总额的比例为12.5%"


def test_display_and_masks(spark):
    shown = spark.createDataFrame([(1.5e8, None)], "a double, b double").select(W.display(F.col("a"), "money"), W.display(F.col("b"), "percent"), W.display(F.lit(3), "streak")).first()
    assert tuple(shown) == ("1.50亿", "—", "3连板")
    masked = one(spark, C.mask(F.col("t")), r"GET /x?api_key=abc123&n=1 token=zz9 C:\Users\li\a mail a@b.cn")
    assert "abc123" not in masked and "zz9" not in masked and "li" not in masked.split("[home]")[0][-5:] and "a@b.cn" not in masked and "n=1" in masked


def test_ranks_and_running_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r["i"]): r["rank"] for r in ranks.numbered(df, ["g"], ["v", "i"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in ranks.running_counts(counts, ["g"], "v", "n").collect():
        assert r["upto"] == sum(h == r["g"] and v <= r["v"] for h, v, _ in rows) and r["total"] == sum(h == r["g"] for h, _, _ in rows)
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_decisions_age_and_are_bounded(spark):
    now = dt.datetime(2024, 1, 2)
    old = spark.createDataFrame([("k1", 1, now - dt.timedelta(hours=1)), ("k1", 2, now - dt.timedelta(hours=9)), ("k2", None, now)], "key string, decision int, decided timestamp")
    asked = spark.createDataFrame([("x", None), ("x", "")], "a string, b string")
    keys = [r[0] for r in asked.select(decisions.digest_of(["a", "b"])).collect()]
    assert keys[0] != keys[1]
    known = old.withColumn("key", F.when(F.col("key") == "k1", keys[0]).otherwise(keys[1]))
    got = {r["b"]: (r["known"], r["decision"]) for r in decisions.looked_up(asked, known, ["a", "b"], F.lit(now)).collect()}
    assert got == {None: (True, 1), "": (False, None)}
    kept = decisions.remembered(old, spark.createDataFrame([("k3", 5, now)], old.schema), 1).collect()
    assert [(r["key"], r["decision"]) for r in kept] == [("k3", 5)]
    fresh = spark.range(1).select(decisions.is_fresh(F.lit(now - dt.timedelta(seconds=90)), F.lit(now), 120), decisions.is_fresh(F.lit(now + dt.timedelta(seconds=1)), F.lit(now), 120), decisions.graded(F.lit(2)), decisions.graded(F.lit(4))).first()
    assert tuple(fresh) == (True, False, 2 / 3, None)


def test_pointers_are_renamed_over(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for n in (1, 2):
        store.publish(spark.range(n), f"v{n}")
        assert store.load().count() == n


def test_validators_and_clicks(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "k int, t string")
    assert [tuple(r) for r in validation.issues(rows, ["k"], {"null": F.col("t").isNull(), "other": F.col("t") == "y"}).collect()] == [(1, "null")]
    clicks = spark.createDataFrame([(1, "s", "b"), (2, "s", "z"), (3, None, "b")], "id int, s string, item string")
    shown = spark.createDataFrame([("s", ["a", "b", "b"])], "s string, shown array<string>")
    assert {r["id"]: r["rank"] for r in events.clicked_ranks(clicks, shown, "s", "item", "shown").collect()} == {1: 2, 2: None, 3: None}
