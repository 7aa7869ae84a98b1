"""Residue, and prose about it, by kind, mostly in wordings that none of the seeds has as they stand."""

import random

import pytest

from marlstone.llm import residue
from tests.llm.test_problems import prose

SLOT = ["{{客户编码}}", "{placeholder}", "${order.total_price}", "%(warehouse)s", "<%= invoice_no %>", "[[shipping_date]]", "{{ item.sku_code }}", "#DIV/0!", "__SUPPLIER_ID__", "<仓库名称>", "#{batch_id}", "{% block.footer %}", "@@contract_no@@", "{交货地点}", "TBD", "[object Object]", "（请填写收货人）", "×××××", "________", "{0}"]
NOTICE = [
    "Oops! Something went wrong.", "数据库连接失败", "您查看的文章已下架，请返回首页", "服务器维护中，请稍后访问", "410 Gone", "This page has been removed.", "请允许浏览器脚本后刷新页面", "会话已过期，请重新登录", "The document could not be found.", "访问过于频繁，请输入验证码",
    "You must enable cookies to proceed.", "Checking your browser before accessing the site.", "网关超时，请刷新重试", "权限不足，请联系管理员", "正在进行安全检查，请稍候", "未找到指定的记录", "503 Service Temporarily Unavailable", "HTTP Error 503. The service is unavailable.", "Loading, please wait...", "对不起，没有找到相应的网页",
]
FILLER = ["Lorem ipsum dolor sit amet", "asdf asdf qwe test test", "示例文本示例文本示例文本", "占位文字 占位文字 占位文字", "测试 abc 测试 xxx 内容", "vestibulum lectus tincidunt mauris donec", "此处省略 此处省略 此处省略", "啊啊啊啊啊啊啊啊", "foo bar baz foo bar", "test 123 test 123 testing"]
ABOUT = ["监控平台在发现“系统繁忙”提示时通知运维人员。", "该软件支持以双花括号标记变量，生成时替换为实际值。", "统计软件默认将 NaN 视为缺失值并剔除。", "The manual describes placeholders that are replaced when a document is made.", "Empty cells stored as null are excluded before totals are computed."]


@pytest.fixture(scope="module")
def judge():
    return residue.Residue(prose(random.Random(11), 600))


@pytest.mark.parametrize("kind", ["SLOT", "NOTICE", "FILLER"])
def test_unseen_residue_is_found(judge, kind):
    around = prose(random.Random(13), 2)
    texts = globals()[kind]
    within = [around[0] + "\n" + t + "\n" + around[1] for t in texts]
    missed = [t for t, w in zip(texts, judge.windows_of(within), strict=True) if not w]
    assert len(missed) <= 0.05 * len(texts), missed


def test_prose_about_residue_is_left(judge):
    assert [t for t in ABOUT if judge.windows(t)] == []


def test_one_wording_in_a_third_of_all_texts_is_found(spark):
    texts = prose(random.Random(15), 200)
    rows = [(i, t + ("您查看的文章已下架，请返回首页。" if i % 3 == 0 else "")) for i, t in enumerate(texts)]
    got = residue.find_residue(spark.createDataFrame(rows, "doc long, text string"), "text").where("residue").collect()
    assert {r["doc"] for r in got} == set(range(0, 200, 3))


def test_prose_late_in_a_long_text_counts(spark):
    late = "前五名客户合计销售，" * 300 + "".join(prose(random.Random(16), 3))
    counts, size = residue.natural_counts([late])
    assert size == len(late)
