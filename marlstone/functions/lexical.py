"""Counts of stated terms in texts and the best rows of sets of terms, over arrays; nothing grows with terms x rows x sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_WORD = re.compile("[a-z0-9]+")
#: Characters counted at once, and numbers of the table of weights of a few rows.
CHARS, CELLS = 500_000, 6_000_000
#: Rounding of scores, and by how much a sum may stay behind a score and still round to it.
DIGITS, SLACK = 6, 2e-6


class Vocabulary:
    """Stated terms by number, each as ``lex_tokens`` makes it: a word, a Han character or two of them."""

    def __init__(self, terms: list[str]) -> None:
        self.size = len(terms)
        self.words = {t: i for i, t in enumerate(terms) if _WORD.fullmatch(t)}
        self.single = np.full(0x10000, -1, dtype=np.int64)
        self.begins, self.ends = np.zeros(0x10000, dtype=bool), np.zeros(0x10000, dtype=bool)
        pairs = []
        for i, t in enumerate(terms):
            if len(t) == 1 and t not in self.words:
                self.single[ord(t)] = i
            elif len(t) == 2 and t not in self.words:
                pairs.append((ord(t[0]) << 16 | ord(t[1]), i))
                self.begins[ord(t[0])] = self.ends[ord(t[1])] = True
        self.codes = np.array([c for c, _ in sorted(pairs)] or [0], dtype=np.int64)
        self.ids = np.array([i for _, i in sorted(pairs)] or [0], dtype=np.int64)

    def counted(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of some lower-cased texts after the other: their numbers of tokens, their numbers of stated terms, and these and their counts, text by text."""
        start = chars = 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= CHARS or i == len(texts) - 1:
                yield self._counted(texts[start : i + 1])
                start, chars = i + 1, 0

    def _counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(n), np.fromiter(map(len, texts), dtype=np.int64, count=n))
        han = (points >= 0x3400) & (points <= 0x9FFF)
        c, row = points[han].astype(np.int64), row[han]
        held = np.bincount(row, minlength=n)
        single = self.single[c]
        one = np.flatnonzero(single >= 0)
        two = np.flatnonzero((row[:-1] == row[1:]) & self.begins[c[:-1]] & self.ends[c[1:]])
        code = c[two] << 16 | c[two + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        is_pair = self.codes[at] == code
        words, seen, get = np.zeros(n, dtype=np.int64), [], self.words.get
        for i, t in enumerate(texts):
            found = _WORD.findall(t)
            words[i] = len(found)
            if self.words:
                seen += [i * self.size + j for j in map(get, found) if j is not None]
        keys = np.concatenate([row[one] * self.size + single[one], row[two[is_pair]] * self.size + self.ids[at[is_pair]], np.array(seen, dtype=np.int64)])
        keys, counts = np.unique(keys, return_counts=True)
        return words + np.maximum(held * 2 - 1, 0), np.bincount(keys // self.size, minlength=n), keys % self.size, counts


class Best:
    """The ``k`` best rows of each set of terms, over any number of batches: by the sum of the terms' weights over the set's
    ``divisors``, rounded, then by the lower id. Weights aren't negative, so sums of the terms' largest weights bound those of a batch."""

    def __init__(self, sets: list[list[int]], divisors: np.ndarray, size: int, k: int) -> None:
        self.sets, self.divisors, self.size, self.k = sets, divisors, size, k
        self.flat, self.starts = np.concatenate([np.array(s) for s in sets]), np.cumsum([0, *[len(s) for s in sets[:-1]]])
        self.floor = np.zeros(len(sets))
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(sets)
        self.rows = int(np.clip(CELLS // max(1, size), 64, 2_048))

    def add(self, docs: np.ndarray, held: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
        """A batch: ids, numbers of entries and, row by row, the entries' terms and weights; entries of one term add up."""
        ends = np.cumsum(held)
        for a in range(0, len(docs), self.rows):
            b = min(a + self.rows, len(docs))
            span = slice(ends[a] - held[a], ends[b - 1])
            cell = ids[span] * (b - a) + np.repeat(np.arange(b - a), held[a:b])
            self._add(docs[a:b], np.bincount(cell, weights[span], minlength=self.size * (b - a)).reshape(self.size, b - a))

    def _add(self, docs: np.ndarray, table: np.ndarray) -> None:
        most = np.add.reduceat(table.max(axis=1)[self.flat], self.starts)
        sums = np.empty(len(docs))
        for q in np.flatnonzero((most > 0) & (most / self.divisors >= self.floor - SLACK)).tolist():
            first, *rest = self.sets[q]
            sums[:] = table[first]
            for t in rest:
                sums += table[t]
            floor, divisor = self.floor[q], self.divisors[q]
            here = np.flatnonzero(sums >= (floor - SLACK) * divisor) if floor else np.flatnonzero(sums)
            if not len(here):
                continue
            scores = sums[here] / divisor
            if len(here) > 4 * self.k:
                enough = scores >= np.partition(scores, len(here) - self.k)[len(here) - self.k] - SLACK
                here, scores = here[enough], scores[enough]
            self._merge(q, docs[here], np.round(scores, DIGITS))

    def _merge(self, q: int, docs: np.ndarray, scores: np.ndarray) -> None:
        before, floor = self.best[q], self.floor[q]
        new = (scores > floor) | ((scores == floor) & (docs < before[0][-1])) if floor else scores > 0
        if not new.any():
            return
        docs, scores = docs[new], scores[new]
        if before is not None:
            docs, scores = np.concatenate([before[0], docs]), np.concatenate([before[1], scores])
        order = np.argsort(docs, kind="stable")
        order = order[np.argsort(-scores[order], kind="stable")][: self.k]
        self.best[q] = docs[order], scores[order]
        if len(order) == self.k:
            self.floor[q] = scores[order[-1]]

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of sets, ids and scores, some thousand sets at a time."""
        for a in range(0, len(self.sets), 4_096):
            part = [(q, *self.best[q]) for q in range(a, min(a + 4_096, len(self.sets))) if self.best[q] is not None]
            if part:
                yield np.repeat([q for q, _, _ in part], [len(d) for _, d, _ in part]), np.concatenate([d for _, d, _ in part]), np.concatenate([s for _, _, s in part])
