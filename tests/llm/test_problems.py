import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import all_codes, cleaned, shingle_codes
from marlstone.llm import bitslice, caps, mixing, mojibake, near_duplicates, overlap, packing, residue, tokens
from marlstone.llm.ngrams import Bank, Batch, Counts, best_windows


def jaccard(a, b, n):
    x, y = set(shingle_codes(a, n).tolist()), set(shingle_codes(b, n).tolist())
    return len(x & y) / len(x | y) if x | y else 0.0


def mutated(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at] = rng.choice("甲乙丙丁戊己庚辛壬癸")
    return "".join(out)


def sentences(rng, n, words=14):
    vocabulary = ["".join(rng.choice("铜箔覆板光模块轴承树脂薄膜阀门泵体滤芯磁") for _ in range(3)) for _ in range(300)]
    return ["".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


# cleaning


def test_cleaned_and_codes():
    assert cleaned("Ａb，－１２ ①É_\n") == "ab121é" and cleaned(None) == "" and cleaned("") == ""
    assert len(shingle_codes("ab", 3)) == 0 and len(shingle_codes("aaaa", 2)) == 1
    assert sorted(set(all_codes(["abcd", "ab", "", "xabc"], 3).tolist())) == sorted({*shingle_codes("abcd", 3).tolist(), *shingle_codes("xabc", 3).tolist()})


def test_codes_of_many_texts_are_those_of_each():
    rng = random.Random(26)
    texts = ["".join(rng.choice("甲乙丙ab") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "甲", "甲乙", "aaaa"]
    for n in (1, 2, 3):
        flat, sizes = near_duplicates.codes_of_each(texts, n)
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
            assert flat[a:b].tolist() == shingle_codes(t, n).tolist()
    assert len(near_duplicates.codes_of_each([], 3)[0]) == 0


# problem 1


@pytest.mark.parametrize("block", [1_000_000, 90])
def test_overlaps_against_brute_force(spark, block):
    rng = random.Random(1)
    base = sentences(rng, 40, 4)
    ev = [(f"q{i}", t) for i, t in enumerate(base)] + [("null", None), ("blank", " "), ("short", "铜箔a"), ("twice", base[0])]
    tr = [(i, mutated(rng, rng.choice(base), rng.randint(0, 5))) for i in range(300)] + [(900, None), (901, ""), (902, "铜箔"), (903, base[0]), (904, base[0] + "，。")] + [(1000 + i, base[1]) for i in range(150)]
    want = {(q, p) for q, a in ev for p, b in tr if a and b and len(cleaned(a)) >= 4 and len(cleaned(b)) >= 4 and jaccard(cleaned(a), cleaned(b), 2) >= 0.6}
    evaluation = spark.createDataFrame([(q, t, 1) for q, t in ev], "query_id string, query string, pairid int")
    training = spark.createDataFrame([(p, t, "x") for p, t in tr], "pairid long, query string, query_id string")
    got = overlap.cross_split_overlaps(evaluation, training, "query_id", "pairid", block_chars=block).collect()
    assert {(r["query_id"], r["pairid"]) for r in got} == want and len(got) == len(want)


def test_overlaps_of_nothing(spark):
    none, one = spark.createDataFrame([], "query_id string, query string"), spark.createDataFrame([(1, "铜箔供应商名单")], "pairid long, query string")
    assert overlap.cross_split_overlaps(none, one, "query_id", "pairid").count() == 0
    assert overlap.cross_split_overlaps(one.withColumnRenamed("pairid", "query_id"), one.limit(0), "query_id", "pairid").count() == 0


# problem 3


def corpus(rng):
    signs = ["温度−40°C至85°C，公差±0.5mm", "阻值12kΩ，直径Ø15mm", "适配 Société Élan 的接口", "标签“температура 20”与“Größe 5”", "韩文标签为“밸브 3호”", "日文標記「スイッチ」"]
    texts = sentences(rng, 400)
    return [t + "，" + rng.choice(signs) for t in texts] + texts


@pytest.fixture(scope="module")
def found():
    texts = corpus(random.Random(2))
    rows = next(mojibake._counts([__import__("pandas").DataFrame({"text": texts})]))
    chars = {r.ch: r.n for r in rows[rows.kind == "c"].itertuples()}
    sides = {(r.ch, r.side, r.kind == "b"): r.n for r in rows[rows.kind.isin(["a", "b"])].itertuples()}
    return mojibake.Detector(len(texts), chars, sides), texts


def test_sound_text_is_sound(found):
    detector, texts = found
    assert [t for t in texts if detector.spans(t)] == []
    for t in ("", "plain ASCII text, 100%", "Größe, naïve, façade, Škoda", "ПРИВЕТ Привет привет", "Ελληνικά", "価格はいくらですか", "한국어 문장입니다", "①②③ → ★ № 5"):
        assert not detector.spans(t), t


@pytest.mark.parametrize(("meant", "wrong"), [("utf_8", "latin_1"), ("utf_8", "cp1252"), ("utf_8", "cp437"), ("utf_8", "mac_roman"), ("utf_8", "cp1251"), ("utf_8", "koi8_r"), ("gbk", "latin_1"), ("gbk", "cp1251"), ("gbk", "koi8_r"), ("gbk", "cp437")])
def test_round_trip_of_single_byte_pairs(found, meant, wrong):
    detector, texts = found
    for t in texts[400:460]:
        bad = mojibake._decode(t.encode(meant), wrong)
        garbled, back, whole = detector.restored(bad)
        assert garbled and back == t and whole
        mixed = "前文完好，" + bad + "。后文完好"
        assert detector.restored(mixed)[0]


@pytest.mark.parametrize(("meant", "wrong"), [("gbk", "cp949"), ("gbk", "big5"), ("utf_8", "gbk")])
def test_multi_byte_pairs_are_found(found, meant, wrong):
    detector, texts = found
    assert all(detector.spans(t.encode(meant).decode(wrong, "replace")) for t in texts[400:460])


def test_single_signs(found):
    detector, _ = found
    assert detector.restored("温度−40掳C")[:2] == (True, "温度−40°C") and detector.restored("阻值12kÎ©")[:2] == (True, "阻值12kΩ")
    assert detector.restored("账面余�12") == (True, "账面余�12", False) and detector.spans("锟斤拷")


def test_restore_garbled_rows(spark, found):
    detector, texts = found
    bad = mojibake._decode(texts[410].encode("utf_8"), "cp1252")
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, texts[410], "c"), (4, bad, "d"), (5, bad, "d")], "id long, rawtext string, garbled string")
    got = {r["id"]: (r["garbled"], r["restored"], r["complete"]) for r in mojibake.restore_garbled(rows, "rawtext", detector).collect()}
    assert got == {1: (False, None, True), 2: (False, "", True), 3: (False, texts[410], True), 4: (True, texts[410], True), 5: (True, texts[410], True)}
    assert mojibake.restore_garbled(rows.limit(0), "rawtext").count() == 0


# problem 4


@pytest.mark.parametrize(("bound", "rank_rows"), [(100_000, 10_000), (0, 10_000), (100_000, 3)])
def test_caps_against_sorting(spark, bound, rank_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, "x", "x", "y"]), rng.choice([None, 0, 1, 2, 3])) for i in range(600)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "pairid long, code string, family string, label int, kept string")
    got = caps.cap_contributors(df, [F.col("code"), F.col("family")], F.col("label"), F.col("pairid"), cap=12, bound=bound, rank_rows=rank_rows)
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1], r[2]), []).append(r)
    cut = {r[0] for g in groups.values() for r in sorted(g, key=lambda r: (-(r[3] if r[3] is not None else -1), r[0]))[12:]}
    assert {r["pairid"] for r in got.where(~F.col("kept")).collect()} == cut and got.count() == 600


@pytest.mark.parametrize("rank_rows", [10_000, 5])
def test_caps_with_ties_repeats_and_shares(spark, rank_rows):
    same = spark.createDataFrame([(1, "a", 2.5)] * 30, "pairid long, code string, q double").repartition(3)
    got = caps.cap_contributors(same, [F.col("code")], F.col("q"), F.col("pairid"), cap=12, rank_rows=rank_rows)
    assert got.where("kept").count() == 12 and got.count() == 30
    mixed = same.unionByName(spark.createDataFrame([(0, "a", 2.5), (2, "a", 2.5), (9, "a", 3.0)], same.schema))
    got = caps.cap_contributors(mixed, [F.col("code")], F.col("q"), F.col("pairid"), cap=12, rank_rows=rank_rows).where("kept")
    assert sorted(r["pairid"] for r in got.collect()) == [0] + [1] * 10 + [9]
    other = spark.createDataFrame([(None, "a", None), (1, "a", 0.9), (2, "a", 0.8), (3, "b", 0.1)], "pairid long, code string, q double")
    got = caps.cap_contributors(other, [F.col("code")], F.col("q"), F.col("pairid"), share=0.5)
    assert sorted(r["pairid"] for r in got.where("kept").collect()) == [1, 2, 3]
    assert caps.cap_contributors(same.limit(0), [F.col("code")], F.col("q"), F.col("pairid"), cap=1).count() == 0
    assert caps.cap_contributors(same, [F.col("code")], F.col("q"), F.col("pairid"), cap=0).where("kept").count() == 0


# problem 5


def test_bit_slices_count_as_popcounts():
    rng = np.random.default_rng(5)
    for width in (192, 768):
        lanes = rng.integers(0, 256, (300, width // 8), dtype=np.uint8)
        lanes[5] = lanes[7]
        queries = lanes[[5, 9, 200]] ^ (rng.random((3, width // 8)) < 0.02).astype(np.uint8)
        planes = bitslice.planes_of(lanes)
        items = [(w, q) for w in range(planes.shape[1]) for q in range(3)]
        for radius in (0, 5, width // 2, width):
            hits = bitslice.within_radius(planes, np.array([w for w, _ in items]), queries[[q for _, q in items]], np.full(len(items), radius), np.full(len(items), np.uint64(2**64 - 1)))
            for (w, q), bits in zip(items, hits.tolist(), strict=True):
                for k in range(64):
                    if w * 64 + k < 300:
                        assert bool(bits >> k & 1) == (int(np.bitwise_count(lanes[w * 64 + k] ^ queries[q]).sum()) <= radius)


def test_sketch_distance_never_exceeds_the_difference():
    rng = random.Random(6)
    a = {rng.getrandbits(64) for _ in range(200)}
    b = set(list(a)[:170]) | {rng.getrandbits(64) for _ in range(40)}
    sk = [bitslice.parity_sketches(np.zeros(len(s), dtype=np.int64), np.array(sorted(s), dtype=np.uint64), 1, 192)[0] for s in (a, b)]
    assert int(np.bitwise_count(sk[0] ^ sk[1]).sum()) <= len(a ^ b)


@pytest.mark.parametrize("hot", [20_000, 6])
def test_near_duplicates_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_duplicates, "HOT", hot)
    rng = random.Random(7)
    base = sentences(rng, 30, 18)
    texts = [mutated(rng, rng.choice(base), rng.randint(0, 9)) for _ in range(220)]
    texts += [mutated(rng, (base[0] * 14)[:700] + base[k] * 3, rng.randint(0, 60)) for k in (1, 1, 1, 2, 2)]  # the next size class
    rows = [(f"f{i:03d}", t) for i, t in enumerate(texts)] + [(f"c{i}", base[3]) for i in range(12)] + [("f001", base[4]), (None, base[4]), ("n", None), ("e", ""), ("s", "太短")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "factid string, rawtext string, text string")
    members, links = near_duplicates.similar_texts(df, "factid", "rawtext")
    got = {tuple(r) for r in near_duplicates.pairs_of_items(members, links).collect()}
    own = [(f, cleaned(t)) for f, t in rows if f and t and len(cleaned(t)) >= 40]
    want = {tuple(sorted((a, b))) for i, (a, x) in enumerate(own) for b, y in own[:i] if a != b and jaccard(x, y, 3) >= 0.7}
    assert got == want and len(want) > 50


def everything(text):
    return True


def test_near_duplicates_of_nothing_and_left_out(spark):
    df = spark.createDataFrame([("a", "甲乙丙丁" * 20), ("b", "甲乙丙丁" * 20)], "factid string, rawtext string")
    for rows in (df.limit(0), df):
        members, links = near_duplicates.similar_texts(rows, "factid", "rawtext", leave_out=everything)
        assert members.count() == 0 and links.count() == 0
    assert near_duplicates.pairs_of_items(*near_duplicates.similar_texts(df, "factid", "rawtext")).count() == 1


def sets_of(rng, docs, low, high):
    sets = [np.unique(near_duplicates._mixed(np.array([rng.randrange(low, high) for _ in range(80)], dtype=np.int64))) for _ in range(docs)]
    return sets, np.array([len(x) for x in sets])


def test_postings_stay_level_as_the_corpus_grows():
    sets, sizes = sets_of(random.Random(21), 60, 0, 4000)
    flat = np.concatenate(sets)
    counts = np.bincount(near_duplicates._bucket(flat, 1 << 20), minlength=1 << 20).astype(np.int64)
    entries = []
    for times in (1, 1_000, 20_000):
        made = near_duplicates.Poster(np.minimum(counts * times, 2**31 - 1).astype(np.int32) + (times > 1), 4, 0.7).rows(np.arange(60), sets, sizes)
        entries.append(sum(len(near_duplicates._unbundle(bundle)[2]) for _, _, bundle in made))
    prefixes = sum(2 * (n - int(np.ceil(0.7 * n)) + 1) for n in sizes.tolist())
    assert entries[1] == entries[2] <= prefixes


def test_only_tokens_that_are_posted_too_often_are_split(monkeypatch):
    monkeypatch.setattr(near_duplicates, "HOT", 40)
    sets, sizes = sets_of(random.Random(22), 50, 0, 100_000)
    held = near_duplicates._mixed(np.array([7], dtype=np.int64))
    sets = [np.union1d(x, held) for x in sets]
    sizes = np.array([len(x) for x in sets])
    counts = np.full(1 << 20, 41, dtype=np.int32)  # every bucket is full
    counts[near_duplicates._bucket(held, 1 << 20)] = 41
    token, n = near_duplicates.posted_in_full_buckets(counts, sets, sizes, 0.7)
    assert n.max() <= 50 and (n > 40).sum() <= 1
    assert len(near_duplicates.posted_in_full_buckets(counts * 0 + 3, sets, sizes, 0.7)[0]) == 0


def test_texts_that_may_post_full_buckets_are_all_looked_at(monkeypatch):
    rng = random.Random(24)
    texts = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(rng.randint(40, 900))) for _ in range(60)] + ["甲乙" * 30]
    every = near_duplicates._mixed(all_codes(texts, 3))
    counts = np.bincount(near_duplicates._bucket(every, 1 << 20), minlength=1 << 20)
    for hot in (10, 60, 100, 10_000):
        monkeypatch.setattr(near_duplicates, "HOT", hot)
        may = near_duplicates.may_post_full(texts, 3, counts, 0.7)
        for t, m in zip(texts, may.tolist(), strict=True):
            own = near_duplicates._mixed(shingle_codes(t, 3))
            posted = len(near_duplicates.posted_in_full_buckets(counts, [own], np.array([len(own)]), 0.7)[0])
            assert m or not posted


def test_texts_of_one_short_key_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "_short", lambda key: 5)
    rng = random.Random(23)
    base = sentences(rng, 3, 18)
    rows = [(i, mutated(rng, base[i % 3], 2)) for i in range(12)]
    batch = __import__("pandas").DataFrame({"short": [5] * 12, "text": [cleaned(t) for _, t in rows]})
    keys, sets, sizes = next(near_duplicates._batches_of_classes(iter([batch]), 3))
    made = list(near_duplicates.Poster(np.full(1 << 20, 2, dtype=np.int32), 1, 0.7).rows(keys, sets, sizes))
    out = near_duplicates._compare(__import__("pandas").DataFrame(made, columns=["level", "block", "bundle"]), 0.7)
    alike = sum(jaccard(a, b, 3) >= 0.7 for i, a in enumerate(batch["text"]) for b in batch["text"][:i])
    assert len(out) >= alike > 5


def test_copies_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES", 3)
    members = spark.createDataFrame([(f"i{k:02d}", b"a") for k in range(10)] + [(f"j{k}", b"b") for k in range(4)] + [("z", b"c")], "item string, key binary")
    links = spark.createDataFrame([(b"a", b"b", 0.8), (b"b", b"c", 0.9)], "a binary, b binary, similarity double")
    got = near_duplicates.pairs_of_items(members, links).collect()
    assert len(got) == len(set(got)) == 45 + 6 + 40 + 4 and all(r[0] < r[1] for r in got)


# problem 6


def first_fit(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        for i, used in enumerate(bins):
            if used + s <= cap:
                bins[i] += s
                break
        else:
            bins.append(s)
    return bins


def test_tournament_is_first_fit():
    rng = random.Random(8)
    for cap in (1, 10, 64):
        sizes = [rng.randint(0, cap) for _ in range(200)]
        at = packing.first_fit_decreasing(np.array(sizes), cap)
        used = [0] * (at.max() + 1)
        for s, b in zip(sizes, at.tolist(), strict=True):
            used[b] += s
        assert used == first_fit(sizes, cap)


def test_packs_hold_everything_once(spark):
    rng = random.Random(9)
    items = [(i, rng.choice([0, 5, 17, 33, 100, 260, None])) for i in range(300)] + [(1, 5), (1, 5), (None, 7)]
    df = spark.createDataFrame([(*r, "x") for r in items], "doc_id long, tokens int, pack string")
    kinds = spark.createDataFrame([("s", 100), ("l", 1000), ("bad", 0)], "packname string, capacitytokens int")
    got = packing.pack(df, kinds, "doc_id", "tokens", "packname", "capacitytokens", group_items=80).toPandas()
    assert set(got["pack"]) == {"s", "l"}
    for name, cap in (("s", 100), ("l", 1000)):
        part = got[got["pack"] == name]
        assert part["tokens"].sum() == sum(s or 0 for _, s in items)
        assert part.groupby(["group", "container"])["tokens"].sum().max() <= cap
        split = part[part["part"] > 0]["item"].unique()
        assert all(dict(items)[i] > cap for i in split)
    again = packing.pack(df.repartition(5, "tokens"), kinds, "doc_id", "tokens", "packname", "capacitytokens", group_items=80).toPandas()
    key = lambda x: sorted(x.fillna(-1).itertuples(index=False, name=None))
    assert key(got) == key(again)
    assert packing.pack(df.limit(0), kinds, "doc_id", "tokens", "packname", "capacitytokens").count() == 0


def test_token_counts(spark):
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("铜箔" * 3000,)], "t string")
    got = [r[0] for r in rows.select(tokens.token_count(F.col("t"))).collect()]
    assert got[0] > 0 and got[1:3] == [0, 0] and got[3] == tokens.counter(tokens.TOKENIZER)(["铜箔" * 3000])[0] > 3000


# problem 7


@pytest.mark.parametrize("rank_rows", [50_000, 20])
def test_mix_reaches_its_shares(spark, rank_rows):
    rng = random.Random(10)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c"]), rng.randint(1, 40), rng.random()) for i in range(3000)] + [(9001, None, 5, 1.0), (9002, "d", 5, 1.0), (9003, "a", None, 1.0), (9004, "a", 5, None)]
    df = spark.createDataFrame(rows, "doc long, source string, tokens int, weight double")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("gone", 0.0, 2)], "source string, targetshare double, maxrepeats int")
    chosen, shares = mixing.mix(df, targets, "doc", "source", "tokens", "weight", rank_rows=rank_rows)
    got = {r["source"]: r for r in shares.collect()}
    assert all(abs(got[s]["actual_share"] - got[s]["target_share"]) < 0.005 for s in "abc") and got["gone"]["actual_share"] == 0
    most = {"a": 1, "b": 3, "c": 2}
    picked = chosen.collect()
    assert all(1 <= r["repeats"] <= most[r["source"]] for r in picked) and len({r["record"] for r in picked}) == len(picked)
    assert {r["repeats"] for r in picked if r["source"] == "b"} == {3}


def test_a_few_long_records_reach_their_budget():
    rng = random.Random(25)
    sizes = [rng.randint(700, 1300) for _ in range(36)]
    room, drawn = 8_678, []
    for s in sizes:
        drawn.append(s <= room)
        room -= s if s <= room else 0
    better = mixing.closed(sizes, drawn, room)
    used = sum(s for s, d in zip(sizes, better, strict=True) if d)
    assert 8_678 - 5 <= used <= 8_678
    assert mixing.closed([5, 5], [True, True], 3) == [True, True] and mixing.closed([5, 9], [True, False], 4) == [False, True]


def test_targets_are_never_dropped(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    rows = spark.createDataFrame([(1, "a", 5, 1.0)], "doc long, source string, tokens int, weight double")
    for names in (["a", "b", "c"], ["a", "a"]):
        targets = spark.createDataFrame([(s, 0.3, 1) for s in names], "source string, targetshare double, maxrepeats int")
        with pytest.raises(ValueError):
            mixing.mix(rows, targets, "doc", "source", "tokens", "weight")


def test_weights_are_heeded(spark):
    rows = spark.createDataFrame([(i, "a", 1, 10.0 if i % 2 else 1.0) for i in range(4000)], "doc long, source string, tokens int, weight double")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, targetshare double, maxrepeats int")
    chosen, _ = mixing.mix(rows, targets, "doc", "source", "tokens", "weight", total=1000)
    odd = chosen.where(F.col("record") % 2 == 1).count()
    assert chosen.count() == 1000 and 800 < odd < 960
    none, shares = mixing.mix(rows.limit(0), targets, "doc", "source", "tokens", "weight")
    assert none.count() == 0 and shares.first()["actual_share"] == 0


# problem 8


def prose(rng, n):
    forms = ["{}业务板块收入占比{}%，", "公司位于{}，主要从事{}的研发和制造。", "通过{}改造，能耗降至{}。", "围绕{}方向新增授权专利{}项，", "前五名客户合计销售{}万元，{}占比居前。"]
    words = ["铜箔", "轴承", "滤芯", "树脂", "浙江", "湖北", "风机", "导热垫", "阀体", "靶坯"]
    return ["".join(rng.choice(forms).format(rng.choice(words), rng.choice([rng.choice(words), rng.randint(1, 99)])) for _ in range(rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def judge():
    return residue.Residue(prose(random.Random(11), 600))


def test_prose_is_no_residue(judge):
    assert [t for t in prose(random.Random(12), 100) if judge.windows(t)] == []
    assert judge.windows("") == []


@pytest.mark.parametrize(
    "text",
    [
        "通过{{company_name}}改造，能耗降至5。", "围绕%(product)s方向新增授权专利3项，", "公司位于（此处插入注册地址），主要从事铜箔的研发和制造。", "前五名客户合计销售××××万元，", "联系人：null\n日期：____", "您访问的页面不存在，请稍后再试",
        "404 Not Found", "Please enable JavaScript and cookies to continue.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "测试 测试 样例 asdf 一段文字 qwe 测试", "请完成安全验证后继续访问",
    ],
)
def test_residue_is_found_alone_and_within(judge, text):
    assert judge.windows(text)
    around = prose(random.Random(13), 2)
    assert judge.windows(around[0] + "\n" + text + "\n" + around[1])


@pytest.mark.parametrize(
    "text",
    ["公司的模板引擎用 {{segment}} 标记变量，渲染时替换为实际数值。", "数据清洗规则会将 NaN 与 undefined 视为缺测值，", "The template engine marks variables as {{name}} and replaces them at render time for clients."],
)
def test_prose_about_residue_is_no_case(judge, text):
    assert judge.windows(text) == []


def test_find_residue_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(prose(random.Random(14), 200))] + [(900, None, "x"), (901, "", "x"), (902, "404 Not Found", "x"), (903, "404 Not Found", "x")]
    got = {r["doc"]: (r["residue"], r["coverage"]) for r in residue.find_residue(spark.createDataFrame(rows, "doc long, text string, kinds string"), "text").collect()}
    assert {d for d, (r, _) in got.items() if r} == {902, 903} and got[900] == (False, 0.0) and got[902][1] > 0.8
    assert residue.find_residue(spark.createDataFrame([], "doc long, text string"), "text").count() == 0


def test_models_and_windows():
    bank = Bank([Counts(["abcabcabc"] * 5), Counts(["xyzxyz"])])
    batch = Batch(["abcxyz"])
    p = bank.log_prob(bank.rows_of(batch.grams), np.flatnonzero(batch.inside))
    assert p.shape == (6, 3) and p[1, 1] > p[1, 2] and p[5, 2] > p[5, 1] and (p <= 0).all()
    assert best_windows(np.array([-1, 3, 3, -9, 5, 2, -1.0]), 5) == [(1, 3, 6.0), (4, 6, 7.0)] and best_windows(np.array([]), 1) == []
