"""Word retrieval writes no pair of a query and a document besides the best: plans of the queries, and results against brute force."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone import queries_discovery
from marlstone.functions import lexical
from marlstone.functions.columns import lex_tokens
from marlstone.operators import discovery, retrieval

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["text_bm25", "fused_constraints", "fused_rrf", "discovery_nominated", "discovery_audit", "discovery_pipeline", "fused_blend", "text_idf_overlap", "discovery_dropped", "discovery_targets", "fused_match_count"])
def test_documents_and_queries_arent_joined_by_term(spark, monkeypatch, name):
    seen, staged = [], retrieval.staged

    def noted(df, kind):
        seen.append(df)
        return staged(df, kind)

    monkeypatch.setattr(queries_discovery, "staged", noted)
    seen.append(entry.queries()[name](spark, FOLDER))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert any("MapInArrow" in p for p in plans)
    assert not any(re.search(r"Join \[term#", p) for p in plans)


def tables(spark):
    """Documents over few characters, so that scores tie; ids come again with other and with the same texts."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["甲", "乙", "丙", "丁", "戊", " ab ", "7", "X9，", "é"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 9))) for i in range(300)] + [(400, "甲乙"), (400, "甲乙"), (400, "甲乙丙"), (401, None), (402, ""), (403, "甲乙" * 50)]
    asked = [(i, text(rng.randrange(1, 6))) for i in range(60)] + [(7, "甲 x9"), (90, "己庚 zz"), (91, None), (92, "甲己")]
    sets = {r["q"]: {*r["t"]} for r in spark.createDataFrame(asked, "q long, t string").groupBy("q").agg(F.flatten(F.collect_list(lex_tokens(F.col("t")))).alias("t")).collect()}
    rows = [(r["doc"], r["t"]) for r in spark.createDataFrame(docs, "doc long, t string").select("doc", lex_tokens(F.col("t")).alias("t")).collect()]
    tf = Counter((d, len(t), x) for d, t in rows for x in t)
    return docs, asked, sets, tf, Counter(x for _, _, x in tf), len(rows), sum(len(t) for _, t in rows) / len(rows)


def best(scores, k):
    out = {}
    for q in {q for q, _ in scores}:
        rest = sorted((-round(s, 6), d) for (p, d), s in scores.items() if p == q and round(s, 6) > 0)
        out |= {(q, d): (-s, i + 1) for i, (s, d) in enumerate(rest[:k])}
    return out


def ranked(spark, f, docs, asked, kind="long", **more):
    got = f(spark.createDataFrame(docs, f"doc {kind}, text string").repartition(3), spark.createDataFrame(asked, "q long, t string"), "doc", "text", "q", "t", 4, **more).collect()
    assert len(got) == len({(r["query"], r["doc"]) for r in got})
    return {(r["query"], r["doc"]): (r["score"], r["rank"]) for r in got}


def near(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_bm25_equals_brute_force(spark, monkeypatch):
    docs, asked, sets, tf, df, n, mean = tables(spark)
    scores = Counter()
    for q, terms in sets.items():
        for (d, size, x), f in tf.items():
            if x in terms:
                scores[q, d] += math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))
    want = best(scores, 4)
    near(ranked(spark, retrieval.bm25, docs, asked), want)
    near(ranked(spark, retrieval.bm25, docs, asked, block=7), want)  # several blocks of sets
    named = [(f"d{d:05}", t) for d, t in docs]
    near({(q, int(d[1:])): s for (q, d), s in ranked(spark, retrieval.bm25, named, asked, "string").items()}, want)
    assert ranked(spark, retrieval.bm25, [(1, None), (2, "")], asked) == {} and ranked(spark, retrieval.bm25, docs, [(1, None)]) == {}


def test_idf_overlap_equals_brute_force(spark):
    docs, asked, sets, tf, df, n, _ = tables(spark)
    weight = {x: math.log((n + 1) / (df[x] + 0.5)) if df[x] else math.log(n + 1) for t in sets.values() for x in t}
    scores = Counter()
    for q, terms in sets.items():
        for d, _size, x in tf:
            if x in terms:
                scores[q, d] += weight[x] / sum(weight[t] for t in terms)
    want = best(scores, 4)
    near(ranked(spark, retrieval.idf_overlap, docs, asked), want)
    near(ranked(spark, retrieval.idf_overlap, docs, asked, block=7), want)
    assert ranked(spark, retrieval.idf_overlap, [(1, None), (2, "")], asked) == {} and ranked(spark, retrieval.idf_overlap, docs, [(1, None)]) == {}


def test_best_is_kept_over_batches():
    """The bound that leaves sets out, and ties between batches that come in any order of ids."""
    import numpy as np

    rng = np.random.default_rng(3)
    weights = rng.integers(0, 3, (500, 6)) * rng.random(6).round(1)
    ids = rng.permutation(500)
    for rows in (64, 7):
        b = lexical.Best([[0, 1], [2], [3, 4, 5], [0, 1, 2, 3, 4, 5]], np.ones(4), 6, 5)
        b.rows = rows
        for part in np.array_split(np.arange(500), 9):
            b.add(ids[part], np.full(len(part), 6), np.tile(np.arange(6), len(part)), weights[part].ravel())
        got = [(int(q), int(d), float(s)) for qs, ds, ss in b.found() for q, d, s in zip(qs, ds, ss, strict=True)]
        want = [(q, d, -s) for q, own in enumerate(b.sets) for s, d in sorted((-round(float(w[own].sum()), 6), int(i)) for i, w in zip(ids, weights, strict=True) if w[own].sum() > 0)[:5]]
        assert [(q, d) for q, d, _ in got] == [(q, d) for q, d, _ in want] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["discovery_dropped", "discovery_audit", "discovery_pipeline"])
def test_no_text_is_joined(spark, monkeypatch, name):
    """Whether a document meets a pattern is told where its text is read; joins and their shuffles get that, not the text."""
    seen, staged = [], queries_discovery.staged

    def noted(df, kind):
        seen.append(df)
        return staged(df, kind)

    monkeypatch.setattr(queries_discovery, "staged", noted)
    seen.append(entry.queries()[name](spark, FOLDER))
    plans = [df._jdf.queryExecution().optimizedPlan() for df in seen]
    assert any("RLIKE" in p.toString() for p in plans)
    for join in (n for p in plans for n in nodes(p) if n.nodeName() == "Join"):
        kept = join.output()
        assert not {"text", "_t"} & {kept.apply(i).name() for i in range(kept.size())}


def test_excluded_tells_the_first_pattern_met(spark):
    pairs = spark.createDataFrame([(q, d) for q in (1, 2, 3, 4) for d in (10, 11, 12, 13)], "query long, doc long")
    specs = spark.createDataFrame([(1, ["b", "a"], None), (2, ["b"], 0.5), (3, [], None)], "query long, exclusions array<string>, least_share double")
    docs = spark.createDataFrame([(10, "x y", 0.7), (11, "y", 0.2), (12, None, None)], "doc long, text string, share double")
    got = {(r["query"], r["doc"]): r["dropped"] for r in discovery.excluded(pairs, specs, docs, {"a": "x", "b": "y|z"}).collect()}
    want = {(1, 10): "a", (1, 11): "b", (2, 10): "b", (2, 11): "b", (2, 12): "share", (2, 13): "share"}
    assert got == {(q, d): want.get((q, d)) for q in (1, 2, 3, 4) for d in (10, 11, 12, 13)}
