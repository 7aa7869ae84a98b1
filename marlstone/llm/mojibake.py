"""Problem 3: text decoded with a wrong character encoding.

For the pairs of a true and a wrong encoding in ``PAIRS`` the garbled forms of the
usual characters are computed beforehand: all of GB 2312, the usual half of Big5,
kana and the first level of JIS, the Hangul of KS X 1001, Cyrillic, accented Latin
and signs. An Aho-Corasick automaton over all these forms finds them in one pass
over the text; a matched span, and nothing else, is turned back by encoding it as
it was wrongly decoded and decoding it as it was meant. What is a form by itself:

* wrong single-byte encodings: the two or three characters a character became;
  letters of Cyrillic pages read as another page in pairs, accented letters of
  Western pages with the letter before them;
* wrong multi-byte encodings: what a three-byte character and the lead byte of its
  follower became; where two bytes stay two bytes, the one character it became, if
  that isn't usual itself. Such forms are characters of some script, so a run
  with forms is garbled only if its characters are rarer than those it turns back
  into, in the corpus and, for scripts the corpus lacks, by fixed priors: kana and
  the commonest Hangul syllables are usual everywhere, as is sound text of these;
* a single sign that became one Han character ("±" as U+5364) is told by its
  neighbours: how often the corpus has them around the sign, and around the Han
  character;
* what no encoding gives as text (U+FFFD, its own garbled form, C1 controls,
  private-use and unassigned code points) is garbled as it stands, and lost.

The corpus counts are one number a code point and one a (neighbour, sign) pair of
a fixed alphabet: bounded by Unicode, not by the number of documents. Texts that are often repeated count once.
"""

from __future__ import annotations

import codecs
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.repeats import once_each
from marlstone.runtime import spread

#: Encodings by Python's names.
SINGLE = ("cp1252", "latin_1", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "cp1251", "cp1250", "iso8859_2", "iso8859_5", "iso8859_15")
MULTI = ("gbk", "big5", "cp949", "cp932", "euc_jp")
MEANT = ("utf_8", "gb18030", "big5", "cp949", "cp932", "euc_jp")
#: Pages of one byte a character, of Cyrillic and of Western letters, and what these are read as.
CYRILLIC, READ_AS = ("cp1251", "koi8_r", "iso8859_5"), "latin_1"
WESTERN, MISREAD = "latin_1", ("cp437", "mac_roman", "cp850")
WIDE = (*MULTI, "utf_16_le")
PAIRS = [(m, w) for m in MEANT for w in SINGLE] + [("utf_8", w) for w in MULTI] + [(m, w) for m in ("gb18030", "big5", "cp949", "euc_jp") for w in MULTI if w != m and (m, w) != ("gb18030", "gbk")]
#: Syllables that make up most of Korean text.
HANGUL_USUAL = (
    "이다는의에가한을를은로기사지고하인대그자도리정스시있나어보일전주아제상수국원해서부조공성장비관어연구동과과여만라드되경용면미생들위신선중치안세소식실발양업산무재계내"
    "게회금학요데트물화건법적강월년호민남북진방모분역단통체개교명문현당심석설습력바오마으삼품술류번우거본"
)
#: Places of signs whose judgement is kept; beyond, they are judged afresh.
TOLD = 500_000
#: Most distinct characters kept of the corpus: all of Unicode.
CODE_POINTS = 0x110000


def _gb2312(first: int, last: int) -> list[str]:
    """Characters of the rows first..last of GB 2312."""
    out = []
    for high in range(first + 0xA0, last + 0xA1):
        for low in range(0xA1, 0xFF):
            try:
                out.append(bytes((high, low)).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return out


def _table(codec: str, high: range, low: range) -> list[str]:
    """Characters that a two-byte encoding has in these rows."""
    found = (bytes((a, b)).decode(codec, "ignore") for a in high for b in low)
    return [c for c in found if len(c) == 1]


#: Level one of GB 2312, all of it, the usual half of Big5, level one of JIS, and the Hangul of KS X 1001.
USUAL_HAN, HAN = _gb2312(16, 55), _gb2312(16, 87)
TRADITIONAL = _table("big5", range(0xA4, 0xC7), range(0x40, 0xFF))
KANJI = _table("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF))
HANGUL = _table("euc_kr", range(0xB0, 0xC9), range(0xA1, 0xFF))
_span = lambda a, b: [chr(c) for c in range(a, b + 1)]
KANA = _span(0x3041, 0x30FE)
SIGNS = (
    _span(0xA1, 0x17F)
    + _span(0x391, 0x3C9)
    + _span(0x401, 0x451)
    + _span(0x2010, 0x2026)
    + list("‰′″※€℃™Ω№→←↑↓−∑∞≈≠≤≥■□●○★、。〈〉《》「」『』【】〔〕")
    + KANA
    + _span(0xFF01, 0xFF5E)
)
#: Further signs that have forms.
RARE_SIGNS = _span(0x2030, 0x2044) + _span(0x2160, 0x217B) + _span(0x2190, 0x22FF) + _span(0x2460, 0x24FF) + _span(0x2500, 0x266F) + _span(0x3200, 0x33FF)
COMMON = frozenset(HAN) | frozenset(TRADITIONAL) | frozenset(SIGNS) | frozenset(map(chr, range(32, 127))) | frozenset("\n\t")
#: Characters that by themselves raise no suspicion.
_PLAIN_SIGNS = "、。，；：？！（）“”‘’「」『』【】《》〈〉〔〕—–…·℃％＋－．／～"
_SOUND = frozenset(map(chr, [*range(9, 14), *range(0x20, 0x7F)])) | frozenset(USUAL_HAN) | frozenset(_PLAIN_SIGNS) | frozenset(_span(0xFF10, 0xFF19) + _span(0xFF21, 0xFF3A) + _span(0xFF41, 0xFF5A))
_SIMPLE = frozenset(HAN) | frozenset(SIGNS) | frozenset(map(chr, range(128)))
#: How usual characters are at least, whatever the corpus: log-probability to be in a text.
PRIOR = dict.fromkeys(HAN, -11.0) | dict.fromkeys(TRADITIONAL + KANJI + HANGUL + SIGNS + RARE_SIGNS, -9.2) | dict.fromkeys(USUAL_HAN, -8.6) | dict.fromkeys(KANA + list(HANGUL_USUAL), -4.0)
_LOST = regex.compile(r"[�\x00-\x08\x0e-\x1f\x7f\x80-\x84\x86-\x9f\p{Co}\p{Cn}]|锟斤拷|烫烫烫|屯屯屯|ï¿½")
_LOST_WORDS = ("锟斤拷", "烫烫烫", "屯屯屯", "ï¿½")
_RUN = re.compile(r"[^\x00-\x7f]+")
_LATIN_WORD = re.compile("(?<![A-Za-z])[À-ÖØ-öø-ÿ]{4,}(?![A-Za-z])")
_SMALL = re.compile("[a-z]")
#: What the first two bytes of kana in UTF-8 are in Shift-JIS and GBK.
_READ_KANA = "縺繧繝銇銈銉"
_CYRILLIC = re.compile("[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+")
_WORD = regex.compile(r"(?:\p{Lu}?\p{Ll}+|\p{Lu}+)")


def _user_defined(error: UnicodeEncodeError) -> tuple[bytes, int]:
    """Bytes of private-use characters that GBK and Shift-JIS decoders give for their user-defined areas."""
    if not isinstance(error, UnicodeEncodeError):
        raise error
    out = bytearray()
    for ch in error.object[error.start : error.end]:
        n = ord(ch) - 0xE000
        if error.encoding == "gbk" and 0 <= n < 0x234:
            out += bytes((0xAA + n // 94, 0xA1 + n % 94))
        elif error.encoding == "gbk" and 0x234 <= n < 0x4C6:
            out += bytes((0xF8 + (n - 0x234) // 94, 0xA1 + (n - 0x234) % 94))
        elif error.encoding == "gbk" and 0x4C6 <= n < 0x766:
            low = (n - 0x4C6) % 96
            out += bytes((0xA1 + (n - 0x4C6) // 96, 0x40 + low + (low >= 0x3F)))
        elif error.encoding == "cp932" and 0 <= n < 0x758:
            low = n % 188
            out += bytes((0xF0 + n // 188, 0x40 + low + (low >= 0x3F)))
        elif error.encoding == "cp932" and 0xF8F0 <= ord(ch) <= 0xF8F3:
            out.append((0xA0, 0xFD, 0xFE, 0xFF)[ord(ch) - 0xF8F0])
    return bytes(out), error.end


codecs.register_error("marlstone-user-defined", _user_defined)


def _decode(data: bytes, wrong: str) -> str:
    """As the usual decoders do; bytes that cp125x leaves open stay C1 controls."""
    if wrong.startswith("cp125"):
        page = [_or_c1(bytes([b]), wrong) for b in range(256)]
        return "".join([page[b] for b in data])
    return data.decode(wrong)


def _or_c1(one: bytes, wrong: str) -> str:
    try:
        return one.decode(wrong)
    except UnicodeDecodeError:
        return one.decode("latin_1")


def _encode(text: str, wrong: str) -> bytes:
    if wrong.startswith("cp125"):
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(wrong)
            except UnicodeEncodeError:
                out += ch.encode("latin_1")
        return bytes(out)
    return text.encode(wrong)


def _forms(chars: list[str], meant: str, wrong: str) -> dict[str, str]:
    """What characters of several bytes become, by the wrong encoding of one byte a character."""
    out = {}
    known = [(ch, data) for ch, data in ((ch, ch.encode(meant, "ignore")) for ch in chars) if len(data) > 1]
    text, at = _decode(b"".join(data for _, data in known), wrong), 0
    for ch, data in known:
        out.setdefault(text[at : at + len(data)], ch)
        at += len(data)
    return out


@lru_cache(maxsize=None)
def _chars_of(wrong: str) -> frozenset[str]:
    return frozenset(_decode(bytes(range(256)), wrong))


@lru_cache(maxsize=None)
def _page(wrong: str) -> re.Pattern:
    """Stretches of a page's upper half and plain letters and signs that begin with the former."""
    upper = re.escape("".join(_decode(bytes([b]), wrong) for b in range(0x80, 0x100)))
    return re.compile(f"[{upper}][{upper}\\x21-\\x7e]+")


@lru_cache(maxsize=None)
def _odd_letter(wrong: str) -> re.Pattern:
    """What accented small letters of the Western page are in another, beside a plain small letter."""
    odd = re.escape("".join(c for c in bytes(range(0xE0, 0x100)).decode(wrong) if not c.islower()))
    return re.compile(f"(?<=[a-z])[{odd}]|[{odd}](?=[a-z{odd}])")


def _bytewise(data: bytes) -> str:
    """UTF-8 with a character a byte: a node of the automaton then has at most 256 successors, which are searched one by one."""
    return data.decode("latin_1")


def _signs_as_one() -> tuple[dict[str, list[str]], set[str]]:
    """(signs of each character that the two bytes of a sign can become; what the first two of three bytes can become, where unusual)."""
    single: dict[str, list[str]] = {}
    anchors: set[str] = set()
    for ch in SIGNS:
        data = ch.encode("utf_8")
        for wrong in MULTI:
            form = data[:2].decode(wrong, "ignore")
            if len(form) != 1 or form in SIGNS or len(form.encode(wrong)) != 2:
                continue
            if len(data) == 2:
                single.setdefault(form, []).append(ch)
            elif form not in USUAL_HAN and wrong == "gbk":
                anchors.add(form)
    return single, anchors


SINGLE_FORMS, ANCHORS = _signs_as_one()
SINGLE_SIGNS = frozenset(x for v in SINGLE_FORMS.values() for x in v)
_ANCHORED = re.compile("[" + re.escape("".join(sorted(ANCHORS))) + "]")
#: First signs of two-byte forms that sound text hardly begins a pair with: lead bytes of UTF-8 and of the signs of GB 2312.
_LEADS = frozenset(bytes((*range(0xC2, 0xC6), *range(0xCE, 0xD2), 0xE2, 0xA1, 0xA3)).decode("cp1252")) | frozenset(b"\xc2\xc3".decode("cp437") + b"\xc2\xc3".decode("mac_roman"))


class Tables:
    """The automaton over all garbled forms; a form's number gives its character, where it has one, and its pair of encodings."""

    def __init__(self) -> None:
        forms: dict[str, tuple[str, str, str]] = {}
        chars = {"utf_8": HAN + SIGNS + TRADITIONAL + HANGUL + RARE_SIGNS, "gb18030": HAN + SIGNS, "big5": USUAL_HAN + SIGNS + TRADITIONAL, "cp949": HANGUL, "cp932": KANA + KANJI, "euc_jp": KANA + KANJI}
        chars = {meant: list(dict.fromkeys(own)) for meant, own in chars.items()}
        for meant in MEANT:
            for wrong in SINGLE:
                for form, ch in _forms(chars[meant], meant, wrong).items():
                    if not form.isascii():
                        forms.setdefault(form, (ch, meant, wrong))
        for meant in CYRILLIC:
            low, high = (list("".join(_span(a, b)).encode(meant).decode(READ_AS)) for a, b in ((0x430, 0x44F), (0x410, 0x42F)))
            for form in {x + y for x in low + high for y in low} | {x + y for x in high for y in high}:
                forms.setdefault(form, ("", meant, READ_AS))
        for wrong in MISREAD:
            for ch in _span(0xE0, 0xFF):
                odd = ch.encode(WESTERN).decode(wrong)
                if not odd.islower():
                    for before in _span(97, 122):
                        forms.setdefault(before + odd, (ch, WESTERN, wrong))
        for meant, wrong in PAIRS:
            if wrong in MULTI:
                self._runs_of(forms, chars[meant], meant, wrong)
        for ch in USUAL_HAN:
            swapped = ch.encode("utf_16_le").decode("utf_16_be", "ignore")
            if swapped and swapped not in COMMON and not swapped.isascii():
                forms.setdefault(swapped, ("", "utf_16_be", "utf_16_le"))
        self.kinds = sorted({(meant, wrong) for _, meant, wrong in forms.values()})
        number = {kind: i for i, kind in enumerate(self.kinds)}
        self.chars = "".join(ch or "\0" for ch, _, _ in forms.values())
        self.pairs = bytes(number[meant, wrong] for _, meant, wrong in forms.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, form in enumerate(forms):
            if not _SOUND.issuperset(form):
                self.automaton.add_word(_bytewise(form.encode("utf-8")), i * 8 + len(form))
        self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        """Compressed, as every executor gets a copy."""
        return self.__dict__ | {"automaton": zlib.compress(pickle.dumps(self.automaton), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"automaton": pickle.loads(zlib.decompress(state["automaton"]))})

    def hits(self, text: str) -> list[tuple[int, int, str, str, str]]:
        """(start, end, character or NUL, meant, wrong) of every form in the text."""
        data = text.encode("utf-8", "surrogatepass")
        found = list(self.automaton.iter(_bytewise(data)))
        if not found:
            return []
        ends = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).tolist()
        return [(ends[at] - (v & 7), ends[at], self.chars[v >> 3], *self.kinds[self.pairs[v >> 3]]) for at, v in found]

    @staticmethod
    def _runs_of(forms: dict[str, tuple[str, str, str]], chars: list[str], meant: str, wrong: str) -> None:
        leads = [bytes([b]) for b in (*range(0xE2, 0xEA), 0xEF)]
        for ch in chars:
            data = ch.encode(meant, "ignore")
            if len(data) == 3:
                first = data[:2].decode(wrong, "ignore")
                for lead in leads if first and not first.isascii() else ():
                    form = first + (data[2:] + lead).decode(wrong, "ignore")
                    if len(form) == 2 and not _SOUND.issuperset(form):
                        forms.setdefault(form, ("", meant, wrong))
            elif len(data) == 2 and (meant != "utf_8" or "Ё" <= ch <= "ё"):
                form = data.decode(wrong, "ignore")
                if form and _SIMPLE.isdisjoint(form):
                    forms.setdefault(form, ("", meant, wrong))


_TABLES: list[Tables] = []


def tables() -> Tables:
    """Built once a process."""
    if not _TABLES:
        _TABLES.append(Tables())
    return _TABLES[0]


def _side(ch: str) -> str:
    """Neighbours by kind where the kind says it all."""
    return "0" if ch.isdigit() else "a" if ch.isascii() and ch.isalpha() else ch


class Detector:
    """Finds garbled spans of one text at a time; holds the corpus counts."""

    def __init__(self, texts: int, chars: dict[str, int], sides: dict[tuple[str, str, bool], int]) -> None:
        self.floor = min(math.log(0.5 / (texts + 1)), -9.2)
        self.least = self.floor - 3
        self.seen = {c: math.log((n + 0.5) / (texts + 1)) for c, n in chars.items()}
        self.log = PRIOR | self.seen
        for c, least in PRIOR.items():
            self.log[c] = max(least, self.log[c])
        self.sides = sides
        self.usual = math.log(0.003)
        self.told: dict[str, str | None] = {}
        self.tables = tables()
        #: Han that the corpus often has is no reason to look closer, as no form is made of it alone.
        often = {c for c, n in self.seen.items() if n > self.usual and "一" <= c <= "鿿"} - ANCHORS
        self.sound = (_SOUND | often) - set("".join(_LOST_WORDS))
        # a sign the corpus nowhere has can't be told by its neighbours
        possible = [g for g, signs in SINGLE_FORMS.items() if any(x in chars for x in signs)]
        self.turned = frozenset(possible)
        self.possible = re.compile("[" + re.escape("".join(sorted(possible))) + "]" if possible else "(?!)")

    def mean(self, text: str) -> float:
        """Log-probability of the text's characters to be in a text; what neither the corpus nor a usual table has counts least."""
        return sum(self.log.get(c, self.least) for c in text) / max(1, len(text))

    def is_garbled(self, text: str) -> bool:
        return bool(self.spans(text))

    def spans(self, text: str) -> list[tuple[int, int, str | None]]:
        """(start, end, restored or None where lost) of the garbled spans, in order, disjoint."""
        found: list[tuple[int, int, str | None]] = []
        chars = set(text)
        odd = chars - self.sound
        if odd:
            if any(x in text for x in _LOST_WORDS) or any(_LOST.match(c) for c in odd):
                found += [(m.start(), m.end(), None) for m in _LOST.finditer(text)]
            rare = any(self.log.get(c, self.floor) <= self.usual for c in odd)
            hits = self.tables.hits(text) if rare or any(c < "⺀" or c > "\ufaff" for c in odd) else []
            if hits:
                found += self._letters(text, hits)
                found += self._single_byte(text, [h for h in hits if h[4] in SINGLE and h[3] in MEANT])
                if rare:
                    found += self._runs(text, [h for h in hits if h[4] in WIDE])
            if not odd.isdisjoint(ANCHORS):
                found += [(m.start(), m.end(), None) for m in _ANCHORED.finditer(text)]
        if not chars.isdisjoint(self.turned):
            found += self._signs(text)
        if not found:
            return found
        out: list[tuple[int, int, str | None]] = []
        for start, end, new in sorted(found, key=lambda s: (s[0], -s[1], s[2] is None)):
            if not out or start >= out[-1][1]:
                out.append((start, end, new))
            elif new is not None and out[-1][2] is None and end >= out[-1][1]:
                out[-1] = (min(start, out[-1][0]), end, new)
        return out

    def _single_byte(self, text: str, hits: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str | None]]:
        if not hits:
            return []
        out = self._with_ascii(text, [h for h in hits if any(c < "\x80" for c in text[h[0] : h[1]])])
        hits = [h for h in hits if all(c >= "\x80" for c in text[h[0] : h[1]])]
        at = 0
        for m in _RUN.finditer(text):
            inside = []
            while at < len(hits) and hits[at][1] <= m.end():
                if hits[at][0] >= m.start():
                    inside.append(hits[at])
                at += 1
            if not inside or self._word_like(text, m.start(), m.end()):
                continue
            whole = self._turned(m.group(), inside)
            if whole is not None:
                out.append((m.start(), m.end(), whole))
                continue
            # mixed: forms of three characters, of signs, two in a row, or a pair that is no word
            for k, (start, end, ch, meant, _) in enumerate(inside):
                row = any(o[0] == end and o[3] == meant for o in inside[k + 1 :]) or any(o[1] == start and o[3] == meant for o in inside[:k])
                if row and meant in MEANT[:3] or end - start >= 3 or meant == "utf_8" or meant == "gb18030" and not self._beside_letters(text, start, end):
                    out.append((start, end, ch))
        rows = self._rows(text, out)
        return [s for s in out if s[1] - s[0] > 2 or s[0] in rows or len(s[2]) == 1 and self._odd_pair(text, s)]

    @staticmethod
    def _rows(text: str, spans: list[tuple[int, int, str | None]]) -> set[int]:
        """Starts of forms of two characters that stand three in a row and together are no word."""
        pairs, out = {s[0] for s in spans if s[1] - s[0] == 2}, set()
        for start in pairs:
            if start - 2 not in pairs:
                end = start
                while end in pairs:
                    end += 2
                if end - start >= 6 and not _WORD.fullmatch(text[start:end]):
                    out.update(range(start, end, 2))
        return out

    def _turned(self, run: str, inside: list[tuple[int, int, str, str, str]]) -> str | None:
        """The whole run turned back, by the pair that gives the most usual text; pairs the forms speak for come first."""
        votes = Counter()
        for h in inside:
            votes[h[3], h[4]] += h[1] - h[0]
        if sum(h[1] - h[0] for h in inside if h[3] == "utf_8" and h[1] - h[0] > 2) > 0.6 * len(run):
            votes = Counter({v: n for v, n in votes.items() if v[0] == "utf_8"})
            others = []
        else:
            others = [(x, w) for x in MEANT[:3] for w in SINGLE]
        best, found, chars = None, -math.inf, set(run)
        for meant, wrong in sorted(votes, key=lambda v: -votes[v]) + others:
            if not chars <= _chars_of(wrong):
                continue
            try:
                back = _encode(run, wrong).decode(meant)
            except UnicodeError:
                continue
            if not all(c in COMMON or c.isalpha() for c in back) or len(back) >= len(run):
                continue
            if meant not in MEANT[:3] and (len(back) < 3 or not all(c in PRIOR for c in back)):
                continue
            if best is None and meant in MEANT[:3] and self.mean(back) > self.usual - 3:
                return back
            if self.mean(back) > found:
                best, found = back, self.mean(back)
        return best

    @staticmethod
    def _with_ascii(text: str, hits: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str | None]]:
        """Stretches with forms whose second byte is a plain letter or sign: of three forms, one after another, at least, and turned back as a whole."""
        out = []
        for meant, wrong in dict.fromkeys((h[3], h[4]) for h in hits):
            own = [h for h in hits if h[3:] == (meant, wrong)]
            if len(own) < 2:
                continue
            for m in _page(wrong).finditer(text):
                inside = [h for h in own if m.start() <= h[0] and h[1] <= m.end()]
                for start in [h[0] for h in inside[:1]] + [m.start()]:
                    try:
                        back = _encode(text[start : m.end()], wrong).decode(meant)
                    except UnicodeError:
                        continue
                    if len(inside) >= 2 and len(back) >= 3 and all(c in PRIOR or c in KANA or c in _PLAIN_SIGNS for c in back):
                        out.append((start, m.end(), back))
                        break
        return out

    @staticmethod
    def _beside_letters(text: str, start: int, end: int) -> bool:
        return (start > 0 and text[start - 1].isascii() and text[start - 1].isalpha()) or (end < len(text) and text[end].isascii() and text[end].isalpha())

    def _odd_pair(self, text: str, span: tuple[int, int, str | None]) -> bool:
        """A lone form of two characters is trusted if the corpus knows the sign better than the pair, or the pair can be no word."""
        pair = text[span[0] : span[1]]
        if regex.fullmatch(r"\p{Lu}?\p{Ll}+|\p{Lu}\p{Lu}", pair):
            return False
        if regex.fullmatch(r"\p{Ll}\p{Lu}", pair) or pair[0] in _LEADS:
            return True
        if "一" > span[2] or span[2] > "鿿":
            return False
        rarest = min(self.seen.get(c, self.floor) for c in pair)
        if span[2] in self.seen:
            return self.seen[span[2]] >= rarest - 0.7
        return rarest < self.usual and any("一" <= c <= "鿿" for c in text[max(0, span[0] - 1) : span[0]] + text[span[1] : span[1] + 1])

    @staticmethod
    def _letters(text: str, hits: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str | None]]:
        """Words of letters of a one-byte page read as another page."""
        out = []
        for m in _LATIN_WORD.finditer(text):
            if not any(m.start() <= h[0] and h[1] <= m.end() for h in hits):
                continue
            word, backs = m.group(), []
            for meant in CYRILLIC:
                back = word.encode("latin_1").decode(meant, "ignore")
                if len(back) == len(word) and _CYRILLIC.fullmatch(back):
                    backs.append(back)
            han = word.encode("latin_1").decode("gb18030", "ignore") if len(word) % 2 == 0 else ""
            if backs and not (len(han) * 2 == len(word) and all(c in _SOUND for c in han)):
                out.append((m.start(), m.end(), max(backs, key=lambda b: sum(c in "оеаинтсрвл" for c in b))))
        western = {wrong for start, end, _, meant, wrong in hits if meant == WESTERN and _SMALL.match(text, end) and (start and _SMALL.match(text, start - 1) or _SMALL.match(text, end + 1))}
        for wrong in western:
            for m in _odd_letter(wrong).finditer(text):
                out.append((m.start(), m.end(), m.group().encode(wrong).decode(WESTERN)))
        return out

    @staticmethod
    def _word_like(text: str, start: int, end: int) -> bool:
        """Whether the run is letters of one script in ordinary case, within a word."""
        run = text[start:end]
        if not run.isalpha():
            return False
        if all(0xC0 <= ord(c) <= 0x24F for c in run):
            left, right = start, end
            while left and text[left - 1].isascii() and text[left - 1].isalpha():
                left -= 1
            while right < len(text) and text[right].isascii() and text[right].isalpha():
                right += 1
            return len(run) <= 2 and right - left > len(run) and _WORD.fullmatch(run) is not None
        for low, high in ((0x370, 0x3FF), (0x400, 0x4FF)):
            if all(low <= ord(c) <= high for c in run):
                return _WORD.fullmatch(run) is not None
        return False

    def _runs(self, text: str, hits: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, str | None]]:
        """Runs that hold forms of a wrong multi-byte encoding and turn back, through one, into more usual characters."""
        out = []
        for m in _RUN.finditer(text):
            run = m.group()
            odd = [c for c in run if c not in _SOUND]
            if not odd or all(self.log.get(c, self.floor) > self.usual for c in odd):
                continue
            if not any(m.start() <= h[0] and h[1] <= m.end() for h in hits):
                continue
            kana = sum("ぁ" <= c <= "ヺ" for c in run)
            if kana >= 2 and kana >= 0.15 * len(run) and not any(c in _READ_KANA or "｡" <= c <= "ﾟ" for c in run):
                continue  # Japanese
            whole = (len(run) - len(run.lstrip(_PLAIN_SIGNS)), len(run.rstrip(_PLAIN_SIGNS))) if len(odd) >= max(1 + (len(run) > 6), 0.25 * len(run)) else None
            for place in dict.fromkeys((whole, (0, len(run)) if whole else None, self._stretch(run))):
                if place is None:
                    continue
                part = run[place[0] : place[1]]
                best, turned = self.mean(part) + 1.0, None
                for back in self._backs(part):
                    good = sum(c in COMMON for c in back)
                    score = self.mean(back)
                    if good >= (0.9 if score < best + 1.0 else 0.75) * len(back) and (sum("一" <= c <= "鿿" for c in back) >= 2 or sum("Ё" <= c <= "ё" for c in back) >= 4) and score > best:
                        best, turned = score, back
                if turned is not None:
                    out.append((m.start() + place[0], m.start() + place[1], turned))
                    break
        return out

    def _stretch(self, run: str) -> tuple[int, int] | None:
        """The shortest stretch that holds all rare suspects of the run, if there are at least two and it is mostly rare."""
        rare = [i for i, c in enumerate(run) if self.log.get(c, self.floor) < self.usual and c not in _SOUND]
        if len(rare) < 2:
            return None
        start, end = rare[0], rare[-1] + 1
        return (start, end) if len(rare) >= 0.3 * (end - start) else None

    @staticmethod
    def _backs(part: str) -> Iterator[str]:
        for wrong in MULTI:
            if len(part.encode(wrong, "replace")) - len(part.encode(wrong, "ignore")) > 0.3 * len(part):
                continue
            data = part.encode(wrong, "marlstone-user-defined")
            if len(data) < 2:
                continue
            for meant in MEANT:
                if (meant == "gb18030") != (wrong == "gbk") or meant == "utf_8":
                    back = data.decode(meant, "ignore")
                    if back and len(data) - len(back.encode(meant)) <= 0.2 * len(data):
                        yield back
        yield part.encode("utf_16_le", "ignore").decode("utf_16_be", "ignore")

    def _signs(self, text: str) -> list[tuple[int, int, str | None]]:
        """Signs that became one character, told by their neighbours."""
        out, told = [], self.told
        if len(told) > TOLD:
            told.clear()
        for m in self.possible.finditer(text):
            i = m.start()
            place = text[i - 1 : i + 2] if i else "\0" + text[:2]
            if place not in told:
                now = m.group()
                told[place] = self._sign(now, _side(text[i - 1]) if i else "", _side(text[i + 1]) if i + 1 < len(text) else "", SINGLE_FORMS[now])
            if told[place] is not None:
                out.append((i, i + 1, told[place]))
        return out

    def _sign(self, now: str, before: str, after: str, signs: list[str]) -> str | None:
        weight = lambda s: math.log(self.sides.get((s, before, True), 0) + 0.5) + math.log(self.sides.get((s, after, False), 0) + 0.5)
        best, sign = 2.4 + weight(now), None
        for s in signs:
            if (w := weight(s)) > best:
                best, sign = w, s
        return sign

    def restored(self, text: str) -> tuple[bool, str, bool]:
        """(garbled, text with matched spans replaced, nothing lost); garbled text may have been garbled twice."""
        garbled, whole = False, not any(x in text for x in ("�", "锟斤拷", "ï¿½"))
        for _ in range(3):
            spans = self.spans(text)
            if not spans:
                break
            garbled = True
            if all(new is None for _, _, new in spans):
                return True, text, False
            parts, at = [], 0
            for start, end, new in spans:
                parts += [text[at:start], text[start:end] if new is None else new]
                at = end
            text = "".join(parts) + text[at:]
        return garbled, text, not garbled or (whole and not self.spans(text))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of each character, and neighbours of each watched one, of a partition."""
    texts, held = 0, np.zeros(CODE_POINTS, dtype=np.int64)
    watched = np.zeros(CODE_POINTS, dtype=bool)
    watched[[ord(c) for c in SINGLE_SIGNS | set(SINGLE_FORMS)]] = True
    kind = np.arange(CODE_POINTS, dtype=np.int64)
    kind[0] = CODE_POINTS  # the edge of a text
    kind[[x for x in range(0x20000) if chr(x).isdigit()]] = ord("0")
    kind[[*range(65, 91), *range(97, 123)]] = ord("a")
    triples: Counter = Counter()
    for b in batches:
        texts += len(b)
        points = np.frombuffer(("\0" + "\0".join(b["text"]) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        seen = np.bincount(points)
        held[: len(seen)] += seen
        at = np.flatnonzero(watched[points])
        for side, to in ((0, at - 1), (1, at + 1)):
            codes, n = np.unique((points[at] * (CODE_POINTS + 1) + kind[points[to]]) * 2 + side, return_counts=True)
            triples.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    held[0] = 0
    rows = [(chr(c), "", "c", int(held[c])) for c in np.flatnonzero(held) if not 0xD800 <= c < 0xE000]
    for code, n in triples.items():
        pair, side = divmod(code, 2)
        now, other = divmod(pair, CODE_POINTS + 1)
        if not 0xD800 <= other < 0xE000:
            rows.append((chr(now), "" if other == CODE_POINTS else chr(other), "a" if side else "b", n))
    rows.append(("", "", "n", texts))
    yield pd.DataFrame(rows, columns=["ch", "side", "kind", "n"])


def detector(rows: DataFrame, text: str) -> Detector:
    """Counts over the whole corpus, often repeated texts once, so none makes its own characters usual: a row a code point and a row a neighbour of a watched sign."""
    own = rows.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    counted = once_each(own, "text").mapInPandas(_counts, "ch string, side string, kind string, n long").groupBy("ch", "side", "kind").agg(F.sum("n").alias("n"))
    chars, sides, texts = {}, {}, 0
    for r in counted.toLocalIterator():
        if r["kind"] == "c":
            chars[r["ch"]] = r["n"]
        elif r["kind"] == "n":
            texts += r["n"]
        else:
            sides[r["ch"], r["side"], r["kind"] == "b"] = r["n"]
    return Detector(texts, chars, sides)


def restore_garbled(rows: DataFrame, text: str, found: Detector | None = None) -> DataFrame:
    """``rows`` with columns garbled (boolean), restored (string) and complete (boolean).

    ``restored`` is the text with every matched span turned back and all else
    untouched; ``complete`` is false where a part is lost for good. Null and
    empty texts are not garbled and come back as they are. Repeated rows are
    each judged alike. A column of one of these names in ``rows`` is replaced.
    """
    held = rows.sparkSession.sparkContext.broadcast(found or detector(rows, text))

    @F.pandas_udf("garbled boolean, restored string, complete boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known: dict[str, tuple] = {}
            out = []
            for t in texts:
                if t is None or t == "":
                    out.append((False, t, True))
                    continue
                if t not in known:
                    known[t] = held.value.restored(t)
                out.append(known[t])
            yield pd.DataFrame(out, columns=["garbled", "restored", "complete"])

    keep = [c for c in rows.columns if c not in ("garbled", "restored", "complete")]
    marked = spread(rows).select(*[F.col(f"`{c}`") for c in keep], judged(F.col(text)).alias("_judged"))
    return marked.select(*[F.col(f"`{c}`") for c in keep], "_judged.garbled", "_judged.restored", "_judged.complete")
