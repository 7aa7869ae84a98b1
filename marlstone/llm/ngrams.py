"""Character n-gram models that share one table, scored over many texts at once."""

from __future__ import annotations

import re

import numpy as np

ORDER = 4
TABLE_BITS = 20
#: Probability of a character no model has seen.
FLOOR = 1.0 / 20_000
_CODE = re.compile(r"[A-Z]{1,6}(?=-?[0-9])")
#: Names between template signs: each character of them is one of two classes, so models know any name by the signs around it.
_NAMED = re.compile(r"(?<=\{)-?\s?([A-Za-z_][\w .:-]{0,40}|[一-鿿]{1,12})(?=\s?-?\})|(?<=<)[一-鿿]{1,12}(?=>)|(?<=%\()\w{1,40}(?=\)[sd])|(?<=<%)[=\s]{0,2}\w[\w .]{0,40}(?=\s?%>)|(?<=\{%)\s?\w[\w .]{0,40}(?=\s?%\})|(?<=\[\[)\s?\w[\w .]{0,40}(?=\s?\]\])|(?<=__)[A-Za-z]\w{0,40}?(?=__)|(?<=@@)\w{1,40}(?=@@)|(?<=%)[A-Za-z_]{2,40}(?=%)|(?<=\$)[A-Za-z_一-鿿]{2,20}(?=\$)")
_LATIN, _HAN = "\ue000", "\ue001"
_LETTERS = re.compile(r"[A-Za-z0-9_.:-]")
_START = np.uint64(2)
#: Power of a context's count that its kinds of continuations are taken to be.
KINDS = 0.7
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _class_of_name(m: re.Match) -> str:
    return re.sub("[一-鿿]", _HAN, _LETTERS.sub(_LATIN, m.group()))


def points(text: str) -> np.ndarray:
    """Code points; digits are one character, and so are all kinds of white space, the letters of codes like AB-12 and names between template signs."""
    text = _NAMED.sub(_class_of_name, text)
    text = _CODE.sub(lambda m: "A" * len(m.group()), text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes)
    return np.where((codes <= 32) | (codes == 0x3000) | (codes == 0xA0), np.uint64(32), codes)


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the 1..ORDER characters that end at each position; the text follows a mark."""
    n, h, out = len(codes), np.zeros(len(codes), dtype=np.uint64), []
    padded = np.concatenate([np.full(ORDER - 1, _START), codes])
    for k in range(ORDER):
        h = (h ^ (padded[ORDER - 1 - k : ORDER - 1 - k + n] + np.uint64(k * 0x9E3779B1))) * _ODD
        h = h ^ (h >> np.uint64(29))
        out.append(h)
    return out


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of each of ``values``."""
    own, at = np.unique(keys, return_inverse=True)
    return own, *(np.bincount(at, weights=v, minlength=len(own)) for v in values)


class Batch:
    """The code points of several texts in one array, each after ORDER - 1 marks, and their n-grams."""

    def __init__(self, texts: list[str]) -> None:
        marks = "\x02" * (ORDER - 1)
        #: As they stand, and as the models see them.
        self.raw = np.frombuffer("".join(marks + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.inside = np.ones(len(self.raw), dtype=bool)
        starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts)])[:-1].astype(np.int64)
        for i in range(ORDER - 1):
            self.inside[starts + i] = False
        self.codes = np.full(len(self.raw), _START, dtype=np.uint64)
        if len(self.raw):
            self.codes[self.inside] = np.concatenate([points(t) for t in texts])
        self.grams = hashes(self.codes)


class Counts:
    """The n-grams of one model: by order, hashes, counts, and what follows each as a context."""

    def __init__(self, texts: list[str]) -> None:
        batch = Batch(texts)
        at = np.flatnonzero(batch.inside)
        self.grams, self.after = [], []
        for k, h in enumerate(batch.grams):
            own, first, n = np.unique(h[at], return_index=True, return_counts=True)
            if k:
                # the context is the gram one shorter that ends one character before
                self.after.append(_sums(batch.grams[k - 1][at[first] - 1], n))
            self.grams.append((own, n))
        self.total = float(len(at))


class Bank:
    """Several models over the union of their n-grams. What a context gives to unseen continuations goes to the shorter n-gram.

    Natural prose is one more model: how often the corpus has each n-gram of the bank, and no others. The n-gram before a known
    one's last character is known too, so that is all its probability takes.
    """

    def __init__(self, models: list[Counts], pull: float = 0.5) -> None:
        self.pull = np.float32(pull)
        self.total = np.array([m.total for m in models], dtype=np.float32)
        self.keys, self.count, self.after = [], [], []
        for k in range(ORDER):
            keys = np.unique(np.concatenate([m.grams[k][0] for m in models]))
            self.keys.append(keys)
            self.count.append(self._rows(keys, [m.grams[k] for m in models]))
            if k < ORDER - 1:
                self.after.append(self._rows(keys, [m.after[k] for m in models]))
        self.natural = [np.zeros(len(keys) + 1, dtype=np.float32) for keys in self.keys]
        self.size = np.float32(1)

    def sizes(self) -> list[int]:
        return [len(keys) for keys in self.keys]

    def learn(self, natural: list[np.ndarray], size: float) -> None:
        """``natural``: for each order the corpus's counts of the keys; ``size``: its characters."""
        self.natural = [np.append(n, 0).astype(np.float32) for n in natural]
        self.size = np.float32(max(size, 1))

    @staticmethod
    def _rows(keys: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row a key, a column a model; a last row of zeros for what isn't there."""
        out = np.zeros((len(keys) + 1, len(pairs)), dtype=np.float32)
        for m, (own, value) in enumerate(pairs):
            at = np.searchsorted(keys, own)
            here = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own) if len(keys) else np.zeros(len(own), dtype=bool)
            out[at[here], m] = value[here]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Two tables from parts of the hash to rows; a key that meets another in the first is in the second."""
        if not hasattr(self, "_tables"):
            self._tables = {}
        if k not in self._tables:
            keys, n = self.keys[k], len(self.keys[k])
            first, second = np.full(1 << TABLE_BITS, n, dtype=np.int32), np.full(1 << TABLE_BITS, n, dtype=np.int32)
            at = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            first[at] = np.arange(n)
            rest = np.flatnonzero(first[at] != np.arange(n))
            second[(keys[rest] & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = rest
            self._tables[k] = first, second
        return self._tables[k]

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        keys, n = self.keys[k], len(self.keys[k])
        if not n:
            return np.zeros(len(h), dtype=np.int32)
        first, second = self._table(k)
        row = first[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        wrong = np.flatnonzero(keys[np.minimum(row, n - 1)] != h)
        if len(wrong):
            other = second[(h[wrong] & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
            row[wrong] = np.where(keys[np.minimum(other, n - 1)] == h[wrong], other, n)
        return row

    def rows_of(self, grams: list[np.ndarray]) -> list[np.ndarray]:
        """Rows of the n-grams of all positions, by order; longer ones are looked for only where shorter ones are known."""
        out, at = [], np.arange(len(grams[0]))
        for k in range(ORDER):
            found = np.full(len(grams[k]), len(self.keys[k]), dtype=np.int32)
            found[at] = self.find(k, grams[k][at])
            at = at[found[at] < len(self.keys[k])]
            out.append(found)
        return out

    def log_prob(self, rows: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """(positions, natural prose and models): log-probability of the characters at ``at``, none of them the first, given those before."""
        pull, r = self.pull, rows[0][at]
        p = (self.count[0][r] + np.float32(FLOOR) * pull) / (self.total + pull) + np.float32(FLOOR * 0.05)
        q = (self.natural[0][r] + np.float32(FLOOR) * pull) / (self.size + pull) + np.float32(FLOOR * 0.05)
        for k in range(1, ORDER):
            r, before = rows[k][at], rows[k - 1][at - 1]
            p *= pull
            p += self.count[k][r]
            p /= self.after[k - 1][before] + pull
            # kinds of continuations grow more slowly than their number; each gives one of its count to the shorter n-grams
            many = self.natural[k - 1][before]
            q = (q * (np.minimum(many, many ** np.float32(KINDS)) + pull) + np.maximum(self.natural[k][r] - 1, 0)) / (many + pull)
        return np.log(np.minimum(np.column_stack([q, p]), np.float32(1.0)))


def best_windows(gain: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Disjoint windows (start, end, sum) whose sum of gains reaches ``least``.

    A window begins at a low of the running sum and ends at its peak; the next
    begins once the gains have fallen from the peak by ``least``.
    """
    run = np.concatenate([[0.0], np.cumsum(gain)])
    if len(gain) == 0 or (run - np.minimum.accumulate(run)).max() < least:
        return []
    out, low, peak = [], 0, 0
    values = run.tolist()
    for i, v in enumerate(values):
        if v > values[peak]:
            peak = i
        if v < values[low] and values[peak] - values[low] < least:
            low = peak = i
        elif values[peak] - values[low] >= least and values[peak] - v >= least:
            out.append((low, peak, values[peak] - values[low]))
            low = peak = i
    if values[peak] - values[low] >= least:
        out.append((low, peak, values[peak] - values[low]))
    return out
