import random

import pytest

from marlstone.llm import residue
from tests.llm.test_problems import prose


@pytest.mark.parametrize("size", [50, 1500])
@pytest.mark.parametrize("wording", ["系统繁忙，请稍后再试", "联系人：null", "{{company_name}}", "Please enable JavaScript and cookies to continue.", "占位文本 占位文本 占位文本"])
def test_residue_in_a_third_of_all_texts_is_found(wording, size):
    texts = [t + ("\n" + wording + "\n" if i % 3 == 0 else "") for i, t in enumerate(prose(random.Random(21), size))]
    judge = residue.Residue(texts)
    assert [i for i, t in enumerate(texts[:300]) if judge.windows(t)] == list(range(0, min(size, 300), 3))
