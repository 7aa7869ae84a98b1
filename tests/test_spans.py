from marlstone.operators import corpus


def test_spans_go_past_long_texts_copies_and_the_first_forty(spark):
    rows = [("a", "甲" * 300, "2024-09-09", 0), ("a", "x" * 200, "2024-09-08", 1), ("a", "y" * 100, "2024-09-07", 2)]
    rows += [("a", "x" * 200, "2024-08-01", i) for i in range(10, 70)] + [("a", f"第{i}项", "2023-01-01", 100 + i) for i in range(6)]
    rows += [("b", "旧", None, 7), ("b", "新", None, 3), ("b", "新品", "2024-01-01", 1), ("c", "", "2024-01-01", 1), ("e", "甲" * 300, "2024-01-01", 1), (None, "d", "2024-01-01", 1)]
    df = spark.createDataFrame(rows, "code string, rawtext string, asof string, id long")
    got = {r["entity"]: r["spans"] for r in corpus.evidence_spans(df, "code", "rawtext", "asof", "id").collect()}
    assert got == {"a": ["x" * 200, "第0项", "第1项", "第2项", "第3项"], "b": ["新", "旧"], "e": []}
