"""Sound text of many scripts stays as it is; garbled text of many pairs of encodings is found."""

import random

import pandas as pd
import pytest

from marlstone.llm import mojibake
from tests.llm.test_problems import corpus

SOUND = [
    "삼성전자 주식회사", "현대자동차 그룹의 연간 보고서", "株式会社ソニー", "ソニーグループ、キヤノン", "トヨタ自動車株式会社の決算", "日本語の文章です。機械学習と経済発展", "臺灣積體電路製造股份有限公司",
    "Привет, мир! Газпром", "société générale à Paris, façade", "Škoda Žižkov Łódź Größe", "Ελληνικά κείμενα", "①②③→★№5 ㎡ ▲", "±0.5°C ×2 ÷3 ≥±5", "10kΩm 5µm α-Al2O3 βγ", "“quoted” — dash… «guillemets»",
    "Ürün çeşitleri şirketi", "Tiếng Việt: Công ty cổ phần Điện máy", "ΔΣ调制器 ÄÖÜ ÉÈ", "25°±2 ¥100 £20 §5 ¶", "Ångström œuvre naïve coöperation",
]
GRID = [
    ("한국어 회사의 매출", "utf_8", ("cp1252", "latin_1", "gbk")), ("Привет мир компания", "cp1251", ("latin_1",)), ("Привет мир компания", "koi8_r", ("latin_1",)), ("Привет мир компания", "utf_8", ("cp1252", "latin_1", "cp437", "gbk")),
    ("La société générale a été créée", "latin_1", ("cp437", "mac_roman")), ("La société générale a été créée", "utf_8", ("cp1252", "mac_roman", "cp437")), ("臺灣積體電路製造公司", "big5", ("latin_1", "cp1252", "gbk", "cp437")),
    ("臺灣積體電路製造公司", "utf_8", ("gbk", "cp1252", "cp932", "cp949")), ("株式会社ソニーグループ", "cp932", ("latin_1", "cp1252")), ("株式会社ソニーグループ", "utf_8", ("cp932", "gbk", "latin_1")), ("株式会社ソニーグループ", "euc_jp", ("latin_1", "cp437")),
    ("삼성전자 주식회사", "cp949", ("latin_1", "cp1252", "cp437")), ("铜箔供应商名单", "gbk", ("cp949", "big5", "euc_jp", "cp1252", "cp437", "mac_roman", "koi8_r", "cp1251", "cp866")),
    ("铜箔供应商名单", "utf_8", ("cp949", "big5", "cp932", "gbk", "cp1252", "cp437", "mac_roman", "koi8_r", "cp1251", "cp866")), ("①面积㎡▲", "utf_8", ("cp1252", "latin_1", "cp437")), ("铜箔供应商名单", "utf_16_le", ("utf_16_be",)),
]


def detector(texts):
    rows = next(mojibake._counts([pd.DataFrame({"text": texts})]))
    chars = {r.ch: r.n for r in rows[rows.kind == "c"].itertuples()}
    sides = {(r.ch, r.side, r.kind == "b"): r.n for r in rows[rows.kind.isin(["a", "b"])].itertuples()}
    return mojibake.Detector(len(texts), chars, sides)


@pytest.fixture(scope="module")
def found():
    return detector(corpus(random.Random(2)))


def garbled(text, meant, wrong):
    data = text.encode(meant)
    return mojibake._decode(data, wrong) if wrong in mojibake.SINGLE else data.decode(wrong, "replace")


@pytest.mark.parametrize("text", SOUND)
def test_sound_text_of_any_script(found, text):
    assert not found.spans(text)
    assert not found.spans("前文完好，" + text + "，后文完好")


@pytest.mark.parametrize(("text", "meant", "wrong"), [(t, m, w) for t, m, wrongs in GRID for w in wrongs])
def test_garbled_text_of_any_script(found, text, meant, wrong):
    bad = garbled(text, meant, wrong)
    assert found.spans(bad)
    assert found.spans("前文完好，" + bad + "，后文完好")


@pytest.mark.parametrize("ch", "鑫晟")
@pytest.mark.parametrize("meant", ["gbk", "utf_8"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437", "mac_roman"])
def test_one_rarer_character_is_turned_back(found, ch, meant, wrong):
    text = "本公司向浙江" + ch + "源科技有限公司采购铜箔"
    assert found.restored(text.replace(ch, garbled(ch, meant, wrong)))[:2] == (True, text)


def test_bytes_lost_on_the_way(found):
    bad = "한국어 회사의 매출".encode().decode("cp1252", "ignore")
    assert found.restored(bad)[1].startswith("한국어 회사")


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437", "mac_roman", "koi8_r", "cp1251", "gbk"])
@pytest.mark.parametrize("meant", ["gbk", "utf_8"])
def test_held_out_grid_of_names(found, meant, wrong):
    """Names of characters of all of GB 2312, or of its first level where a page of several bytes gives characters of its own, each garbled as a whole."""
    if meant == wrong:
        return
    rng = random.Random(31)
    names = ["".join(rng.choice(mojibake.USUAL_HAN if wrong == "gbk" else mojibake.HAN) for _ in range(6)) for _ in range(200)]
    hit = sum(bool(found.spans("供应商" + garbled(n, meant, wrong) + "的产品")) for n in names)
    assert hit >= 0.99 * len(names)
