import random

import pytest

from marlstone.llm import mojibake
from tests.llm.test_problems import corpus


@pytest.mark.parametrize(("meant", "wrong"), [("gbk", "cp949"), ("gbk", "big5"), ("utf_8", "gbk")])
def test_one_garbled_text_in_a_third_of_all_rows_is_found(spark, meant, wrong):
    texts = corpus(random.Random(2))
    bad = texts[430].encode(meant).decode(wrong, "replace")
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, bad) for i in range(len(texts) // 2)]
    got = mojibake.restore_garbled(spark.createDataFrame(rows, "id long, rawtext string"), "rawtext").where("garbled")
    assert {r["id"] for r in got.select("id").collect()} == {10_000 + i for i in range(len(texts) // 2)}
