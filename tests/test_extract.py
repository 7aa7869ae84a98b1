from pyspark.sql import functions as F

from marlstone.operators import extract as E

PAGE = """<html><head><title>t</title><script>var a = "<p>铜箔产品在脚本里。</p>";</script></head><body><nav>首页 产品</nav>
<p>公司提供铜箔产品，年产能一万吨。欢迎来电！</p><div>公司提供铜箔产品，年产能一万吨。</div><p>常见问题：什么是铜箔产品？</p><footer>铜箔产品备案号</footer></body>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>broken <b>铜箔产品 and more text")], "id long, html string")
    got = [(r["entity"], r["sentence"]) for r in E.page_sentences(pages, "id", "html", "铜箔", "什么").collect()]
    assert got == [(1, "公司提供铜箔产品，年产能一万吨。"), (4, "铜箔产品 and more text")]


def test_windows(spark):
    text = "前文。" + "甲" * 20 + "产能提升" + "乙" * 20 + "。" + "丙" * 300 + "产能为零的情形。"
    rows = E.trigger_windows(spark.createDataFrame([(1, text), (2, None), (3, "产能")], "id long, t string"), "id", "t", {"capacity": "产能"}, {"none": "为零"})
    got = sorted((r["entity"], r["at"], r["reason"]) for r in rows.collect())
    assert got == [(1, 23, None), (1, len(text) - 8, "none"), (3, 0, "short")]
    assert [r["windows"] for r in E.chosen_windows(rows).collect()][0][0].startswith("前文。甲")


def test_terms(spark):
    assert E.split_terms("铜箔（电子、锂电）、覆铜板；其他、A/铜箔（电子、锂电）") == ["铜箔（电子、锂电）", "覆铜板"] and E.split_terms(None) == []
    df = spark.createDataFrame([("其中:外销-铜箔",), ("铜箔-其他",), ("覆铜板",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(E.cell_term(F.col("c"))).collect()] == ["铜箔", None, "覆铜板", None, None]
    assert df.select(E.terms_of(F.col("c"))).first()[0] == ["其中:外销-铜箔"]


def test_hits_and_context(spark):
    df = spark.createDataFrame([(1, "铜箔和覆铜板", "无"), (2, None, "锂电铜箔"), (3, "x", "y")], "k long, a string, b string")
    got = sorted((r["key"], r["field"], r["term"], r["quote"]) for r in E.field_hits(df, "k", ["a", "b"], ["铜箔", "覆铜板"], 2).collect())
    assert [g[:3] for g in got] == [(1, "a", "覆铜板"), (1, "a", "铜箔"), (2, "b", "铜箔")] or [g[:3] for g in got] == [(1, "a", "铜箔"), (1, "a", "覆铜板"), (2, "b", "铜箔")]
    text = spark.createDataFrame([(1, "xxAB yy ab zz"), (2, None)], "k long, t string")
    assert [(r["n"], r["quote"]) for r in E.in_context(text, "k", "t", "ab", 1, 2).orderBy("n").collect()] == [(0, "xAB y"), (1, " ab z")]
