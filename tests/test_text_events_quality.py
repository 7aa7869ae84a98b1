import datetime as dt
import math
import random
import re
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import columns as C
from marlstone.functions.text import cleaned
from marlstone.operators import corpus, datasets, events, quality, retrieval
from marlstone.sources import files
from marlstone.sources.snapshots import Store
from marlstone.streaming import events as stream


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_tokens_bridge_what_is_between(spark):
    assert one(spark, C.lex_tokens(F.col("t")), "AI芯x片") == ["ai", "x", "芯片", "芯", "片"]
    assert one(spark, C.lex_tokens(F.col("t")), None) == [] and one(spark, C.lex_tokens(F.col("t")), "片") == ["片"]


def test_masks_and_corruption(spark):
    assert one(spark, C.mask(F.col("t")), "写给 a.b@c.cn 或 13812345678，Bearer abc.def") == "写给 [email] 或 [phone]，[token]"
    assert one(spark, C.is_corrupt(F.col("t")), "a�b") and not one(spark, C.is_corrupt(F.col("t")), "ok") and not one(spark, C.is_corrupt(F.col("t")), None)


def test_window_snaps_to_sentences(spark):
    text = "甲" * 30 + "。" + "乙" * 50 + "产能" + "丙" * 110 + "。" + "丁" * 30
    got = one(spark, C.snap_window(F.col("t"), F.call_function("locate", F.lit("产能"), F.col("t")), F.lit(2)), text)
    assert got == "甲" * 30 + "。" + "乙" * 50 + "产能" + "丙" * 110 + "。"


def test_folds(spark):
    df = spark.createDataFrame([(["aaaa", "bbbbbb", "cc", "aa"],)], "x array<string>")
    assert df.select(C.budgeted(F.col("x"), 8, True)).first()[0] == ["aaaa", "cc", "aa"]
    assert df.select(C.budgeted(F.col("x"), 8, False)).first()[0] == ["aaaa"]
    assert df.select(C.uncontained(F.col("x"), 5)).first()[0] == ["aaaa", "bbbbbb", "cc"]


@pytest.mark.parametrize(("variant", "want"), [("round_up", 3), ("ceil", 3), ("round_span", 3), ("floor", 4)])
def test_percentile_variants(spark, variant, want):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(C.nearest_rank(F.col("v"), 0.6, variant)).collect()] == [want, None]


def test_bm25_against_formula(spark):
    docs = spark.createDataFrame([(1, "铜箔 copper foil"), (2, "铜"), (3, None), (4, "foil foil")], "doc long, text string")
    asked = spark.createDataFrame([(7, "foil foil"), (8, None)], "q long, t string")
    got = {(r["query"], r["doc"]): r["score"] for r in retrieval.bm25(docs, asked, "doc", "text", "q", "t").collect()}
    sizes = {1: 5, 2: 1, 3: 0, 4: 2}
    w = math.log(1 + (4 - 2 + 0.5) / 2.5)
    score = lambda d, tf: round(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[d] / 2.0)), 6)
    assert got == {(7, 1): score(1, 1), (7, 4): score(4, 2)}


def test_nearest_leaves_odd_vectors_out(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0])], "id long, v array<float>")
    asked = spark.createDataFrame([(9, [1.0, 1.0])], "q long, w array<float>")
    assert [(r["doc"], r["score"]) for r in retrieval.nearest(rows, asked, "id", "v", "q", "w", 5, block=1).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]


def test_blend_and_match_count(spark):
    m = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.4)], "query long, doc long, score double")
    w = spark.createDataFrame([(1, 2, 0.5)], "query long, doc long, score double")
    got = {r["doc"]: r["score"] for r in retrieval.blended(m, w).collect()}
    assert got[2] == 0.92 and got[1] == math.floor(0.52 / 0.76 * 92 + 0.5) / 100
    many = spark.createDataFrame([(1, i / 100) for i in range(60)], "query long, final double")
    assert retrieval.match_count(many).first()["matches"] == 30


def test_gate_and_changes(spark):
    rows = spark.createDataFrame([(i, ["all", f"t{i}"] if i else ["all", None, ""]) for i in range(20)], "id long, terms array<string>")
    assert {r["term"] for r in corpus.gate(rows, "id", "terms", 0.05).collect()} == {f"t{i}" for i in range(1, 20)}
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k long, s string, n int"), spark.createDataFrame([(1, "x", 5), (3, "z", 1)], "k long, s string, n int")
    assert {r["field"]: r["changed"] for r in corpus.changes(a, b, "k", ["s", "n"]).collect()} == {"n": 1, "NEW": 1, "GONE": 1}


def sample_events(seed=1, n=400):
    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    return [(i, rng.randint(1, 12), start + dt.timedelta(seconds=rng.randint(0, 40_000)), rng.choice(["click", "view", "error"]), rng.random() * 10) for i in range(n)]


EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def brute_chains(rows, gap):
    last, out = {}, {}
    for e, u, t, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if u in last and (t - last[u][1]).total_seconds() <= gap:
            group = last[u][2] or f"rg_{last[u][0]}"
            out[e] = (group, last[u][0])
            last[u] = (e, t, group)
        else:
            out[e] = (None, None)
            last[u] = (e, t, None)
    return out


def test_chains_batch_and_stream(spark, tmp_path):
    rows = sample_events()
    df = spark.createDataFrame(rows, EVENTS)
    want = brute_chains(rows, 600)
    got = events.reformulations(df, "user_id", "ts", "event_id", "event_type", 600.0)
    assert {r["event"]: (r["group_id"], r["previous_id"]) for r in got.collect()} == want
    for k, part in enumerate((df.where("ts < '2026-01-01 05:00:00'"), df.where("ts >= '2026-01-01 05:00:00'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        source = stream.read_stream(spark, str(tmp_path / "in/*"), df.schema)
        stream.run_available(stream.chains(source, 600.0), str(tmp_path / "ck"), lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")))
    assert {r["event_id"]: (r["group_id"], r["previous_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_daily_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    df = spark.createDataFrame(sample_events(2), EVENTS)
    df.union(df.limit(50)).coalesce(2).write.parquet(str(tmp_path / "in"))
    out = stream.daily_counts(stream.read_stream(spark, str(tmp_path / "in"), df.schema), "ts", "event_type", event="event_id")
    for _ in range(2):
        stream.run_available(out, str(tmp_path / "ck"), stream.overwrite_days(str(tmp_path / "out")))
    # append emits a day once it is over; a later event closes it
    spark.createDataFrame([(9999, 1, dt.datetime(2026, 1, 9), "view", 1.0)], EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.run_available(out, str(tmp_path / "ck"), stream.overwrite_days(str(tmp_path / "out")))
    got = {r["kind"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).where("day = '2026-01-01'").collect()}
    assert got == {r["event_type"]: r["count"] for r in df.groupBy("event_type").count().collect()}


def test_percentiles_rates_and_costs(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in [5, 1, 3, 3, -1]] + [("b", None)], "k string, v double")
    got = events.percentiles(rows, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()
    assert [tuple(r) for r in got] == [("a", 4, 3.0, 5.0)]
    calls = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", None, 0.25)], "by string, tokens int, cost double")
    assert {r["by"]: (r["calls"], r["tokens"], r["cost"]) for r in events.cost_summary(calls, "by", "tokens", "cost").collect()} == {"a": (2, 3, None), "b": (1, 0, 0.25)}


def test_inversions_against_pairs(spark):
    rng = random.Random(4)
    rows = [("q", rng.randint(0, 3), rng.randint(0, 6)) for _ in range(60)] + [("none", 1, 1)]
    got = {r["query"]: (r["pairs"], r["inverted"]) for r in quality.inversions(spark.createDataFrame(rows, "q string, label int, score int"), "q", "label", "score", 3).collect()}
    top, low = [s for q, l, s in rows if q == "q" and l == 3], [s for q, l, s in rows if q == "q" and l < 3]
    assert got == {"q": (len(top) * len(low), sum(a < b for a in top for b in low)), "none": (0, 0)}


def test_ranking_metrics_without_results(spark):
    truth = spark.createDataFrame([("a", 1, 3), ("a", 2, 0), ("b", 1, 0)], "query string, item long, label int")
    ranked = spark.createDataFrame([("a", 2, 1), ("a", 1, 2)], "query string, item long, rank int")
    got = {r["query"]: r for r in quality.ranking_metrics(ranked, truth, 10).collect()}
    assert got["a"]["reciprocal_rank"] == 0.5 and got["a"]["ndcg"] == pytest.approx(1 / math.log2(3), abs=1e-6) and got["a"]["bad"] == 1
    assert got["b"]["recall"] is None and got["b"]["ndcg"] is None and got["b"]["dcg"] == 0


def test_isolated_splits_leak_nothing(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, rng.choice([None, f"c{rng.randint(0, 60)}"]), rng.choice([None, f"s{rng.randint(0, 60)}"])) for i in range(150)], "id long, company string, src string")
    split = datasets.isolated_splits(rows, "id", ["company", "src"])
    both = rows.join(split, rows["id"] == split["row"])
    assert split.count() == 150 and datasets.leaks(both, "split", ["company", "src"]).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)] + [("x", "x"), (None, "y")], "a string, b string")
    got = {r["node"]: r["component"] for r in datasets.connected(edges).collect()}
    assert len(got) == 302 and {v for k, v in got.items() if k != "x"} == {"n0000"} and got["x"] == "x"


def test_files(spark, tmp_path):
    schema = T.StructType().add("date", "date").add("v", "integer")
    (tmp_path / "days").mkdir()
    (tmp_path / "days/2026-01-01.jsonl").write_text('{"date":"2026-01-01","v":1}\n')
    (tmp_path / "days/2026-01-02.jsonl").write_text('{"date":"2026-01-03","v":2}\n')
    assert files.read_day_files(spark, str(tmp_path / "days"), schema, until="2026-01-01").count() == 1
    with pytest.raises(Exception, match="another date"):
        files.read_day_files(spark, str(tmp_path / "days"), schema).collect()
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev/2026-01-01.jsonl").write_text('{"v":1}\n\nnot json\n{"v":2}\n')
    good, bad = files.read_events(spark, str(tmp_path / "ev"), T.StructType().add("v", "integer"))
    assert sorted(r["v"] for r in good.collect()) == [1, 2] and bad.first()["corrupt"] == 1
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/log.jsonl").write_text('{"timestamp":"2026-01-01T00","query":"铜箔","codes":["600001"]}\n{"timestamp":"2026-01-02T00","query":"x"}\n{"torn')
    runs = lambda **k: files.search_runs(spark, str(tmp_path / "runs"), **k).count()
    assert (runs(), runs(date="2026-01-02"), runs(contains="铜"), runs(code="600001"), runs(code="1")) == (2, 1, 1, 1, 0)
    (tmp_path / "x.cod").write_bytes(struct.pack("<6s8sI", b"600001", "铜箔".encode("gbk"), 7) * 3)
    got = files.read_fixed(spark, str(tmp_path / "x.cod"), "<6s8sI", [("code", "string"), ("name", "string"), ("n", "int")]).collect()
    assert len(got) == 3 and got[0]["name"] == "铜箔" and got[0]["n"] == 7


def test_increment_and_snapshots(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, s string")
    built = a.withColumn("hash16", files.content_hash(a, ["s"]))
    keep, todo = files.increment(spark.createDataFrame([(1, "x"), (2, ""), (3, "z")], "k long, s string"), built, "k", ["s"])
    assert [r["k"] for r in keep.collect()] == [1] and sorted(r["k"] for r in todo.collect()) == [2, 3]
    assert files.differences(a, a.orderBy(F.desc("k"))).count() == 0 and files.differences(a, a.limit(1)).count() == 1
    store = Store(spark, f"file://{tmp_path}/store")
    for i, refers in enumerate([[], ["s0"], [], ["s1"]]):
        store.publish(a.withColumn("i", F.lit(i)), f"s{i}", refers=refers)
    assert store.load(verify=True).first()["i"] == 3 and store.prune(1) == ["s2"]
    assert store.prune(1, leased={"s2"}) == [] and store.prune(1, apply=True) == ["s2"] and store.snapshots() == ["s0", "s1", "s3"]
    with pytest.raises(Exception, match="exist"):
        store.publish(a, "s3")


def test_cleaning_equals_its_plain_form():
    rng = random.Random(41)
    pool = [chr(c) for c in (*range(0x20, 0x3400), *range(0xAC00, 0xAC40), *range(0xF900, 0x10000), 0x1D400, 0x20000, 0x1F600) if not 0xD800 <= c < 0xE000]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))
        assert cleaned(text) == re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).lower()), ascii(text)
