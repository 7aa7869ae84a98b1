import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.codes import denoted_code, family_key, is_blank
from marlstone.operators.references import and_not, dictionary, orphans, pack, unpack

T = dt.datetime
REFS = "id long, code string, at timestamp, orphan_hint string"
POOL = "code string, since timestamp, until timestamp"


@pytest.mark.parametrize(
    ("written", "code"),
    [("600001", "600001"), ("SH600001", "600001"), ("600001.SZ", "600001"), ("sz:600001", "600001"), (" 600 001　", "600001"), ("1234", "001234"), ("600001.0", "600001"), ("６０００01", "600001"), ("n/a", "N/A"), ("", ""), (None, None), ("1234567", "1234567")],
)
def test_denoted_code(spark, written, code):
    row = spark.createDataFrame([(written,)], "c string").select(denoted_code(F.col("c")), is_blank(F.col("c"))).first()
    assert row[0] == code and row[1] == (None if written is None else code == "")


def test_family_key(spark):
    assert spark.createDataFrame([("v42_tr-Mat resin",)], "f string").select(family_key(F.col("f"))).first()[0] == "V42TRMATRESIN"


def test_containers_of_both_kinds():
    rng = random.Random(1)
    for n in (0, 1, 10, 4096, 4097, 30_000, 65_536):
        a = np.array(sorted(rng.sample(range(65_536), n)), dtype=np.int64)
        b = np.array(sorted(rng.sample(range(65_536), min(n, 20_000))), dtype=np.int64)
        assert unpack(pack(a)).tolist() == a.tolist()
        assert and_not(pack(a), pack(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert and_not(pack(np.array([3, 5])), None).tolist() == [3, 5]


def test_dictionary_is_dense_and_ordered(spark):
    keys = spark.createDataFrame([(f"k{i % 500:04d}",) for i in range(2000)] + [(None,)], "key string")
    got = sorted((r["key"], r["id"]) for r in dictionary(keys).collect())
    assert got == [(f"k{i:04d}", i) for i in range(500)]


def brute(refs, pool):
    out = []
    for i, code, at, _ in refs:
        if code is None:
            continue
        spans = [(s, u) for c, s, u in pool if c == code and s is not None and (u is None or s < u)]
        if at is None:
            out += [] if spans else [i]
        elif not any(s <= at and (u is None or at < u) for s, u in spans):
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_orphans_against_brute_force(spark, unit):
    rng = random.Random(unit)
    when = lambda: T(2025, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
    pool = []
    for k in range(40):
        for _ in range(rng.choice([1, 1, 2])):
            a = when()
            pool.append((f"{k:06d}", a, rng.choice([None, when(), a])))
    refs = [(i, rng.choice([None, "junk", *[f"{k:06d}" for k in range(50)]]), rng.choice([None, when(), when(), when()]), "x") for i in range(800)]
    refs += [(1000 + i, "000001", when(), "hot") for i in range(400)]
    edge = next((c, s) for c, s, u in pool if u is None)
    refs += [(5000, *edge, "at the instant"), (5001, edge[0], edge[1] - dt.timedelta(seconds=1), "before it")]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(pool, POOL), "code", "at", "code", "since", "until", unit)
    assert sorted(r["id"] for r in got.collect()) == brute(refs, pool)
    assert got.columns == ["id", "code", "at", "orphan_hint", "orphan_period"]


def test_orphans_of_empty_sides(spark):
    none, one = spark.createDataFrame([], REFS), spark.createDataFrame([(1, "a", T(2025, 3, 1), None), (1, "a", T(2025, 3, 1), None)], REFS)
    pool = spark.createDataFrame([], POOL)
    assert orphans(none, pool, "code", "at", "code", "since", "until").count() == 0
    got = orphans(one, pool, "code", "at", "code", "since", "until").collect()
    assert [r["orphan_period"] for r in got] == ["2025-03"] * 2
