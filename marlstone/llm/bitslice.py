"""Hamming distances of many bit sketches at once, by vertical counters.

Sketches are parities: bit ``h(token) mod width`` is flipped for each token, so
the Hamming distance of two sketches never exceeds the number of tokens that
only one of the sets holds. A pair within a Jaccard threshold therefore always
lies within a radius given by the two sizes: discarding beyond it is exact.

Lanes are stored as bit planes: word ``w`` of plane ``p`` holds bit ``p`` of 64
sketches. A query is compared with 64 lanes by one XOR a plane; the result bits
are counted with carry-save adders, eight planes at a time, into counters that
are themselves bit planes. After half and after three quarters of the
planes, words in which all lanes exceed the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ITEMS = 32_768
LANES = 1 << 16


def parity_sketches(doc: np.ndarray, token: np.ndarray, docs: int, width: int) -> np.ndarray:
    """(docs, width / 8) bytes; ``token`` are well-mixed 64-bit numbers."""
    bit = (token >> np.uint64(9)) % np.uint64(width)
    flips = np.bincount(doc * width + bit.astype(np.int64), minlength=docs * width)
    return np.packbits((flips & 1).astype(np.uint8).reshape(docs, width), axis=1, bitorder="little")


def planes_of(sketches: np.ndarray) -> np.ndarray:
    """(width, words) of uint64 from (lanes, width / 8) bytes; missing lanes are zero."""
    lanes, width = len(sketches), sketches.shape[1] * 8
    words = -(-lanes // 64)
    columns = np.zeros((width // 8, words * 64), dtype=np.uint8)
    columns[:, :lanes] = sketches.T
    out = np.empty((width, words), dtype=np.uint64)
    for p in range(width):
        out[p] = np.packbits((columns[p >> 3] >> (p & 7)) & 1, bitorder="little").view(np.uint64)
    return out


class Counters:
    """Vertical counters of ``n`` words: ones, twos, fours, then eights and up."""

    def __init__(self, n: int, levels: int) -> None:
        self.low = [np.zeros(n, dtype=np.uint64) for _ in range(3)]
        self.high = [np.zeros(n, dtype=np.uint64) for _ in range(levels - 3)]
        self.u, self.v = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)

    def _add(self, level: int, b: np.ndarray, c: np.ndarray, carry: np.ndarray) -> np.ndarray:
        """Full adder: counter ``level`` plus b plus c; the carry goes to ``carry``."""
        a, u, v = self.low[level], self.u, self.v
        np.bitwise_xor(a, b, out=u)
        np.bitwise_and(a, b, out=v)
        np.bitwise_and(u, c, out=carry)
        np.bitwise_or(carry, v, out=carry)
        np.bitwise_xor(u, c, out=a)
        return carry

    def add8(self, d: list[np.ndarray], spare: list[np.ndarray]) -> None:
        """Adds eight planes; ``d`` is overwritten."""
        two_a = self._add(0, d[0], d[1], spare[0])
        two_b = self._add(0, d[2], d[3], spare[1])
        four_a = self._add(1, two_a, two_b, spare[2])
        two_a = self._add(0, d[4], d[5], spare[0])
        two_b = self._add(0, d[6], d[7], spare[1])
        four_b = self._add(1, two_a, two_b, spare[3])
        carry = self._add(2, four_a, four_b, spare[0])
        for c in self.high:
            np.bitwise_and(c, carry, out=self.v)
            np.bitwise_xor(c, carry, out=c)
            carry, self.v = self.v, carry
        spare[0] = carry

    def over(self, radius: np.ndarray) -> np.ndarray:
        """Lanes whose count exceeds the word's radius."""
        above = np.zeros(len(radius), dtype=np.uint64)
        equal = np.full(len(radius), _ALL)
        counters = self.low + self.high
        for k in reversed(range(len(counters))):
            want = np.where((radius >> k) & 1, _ALL, np.uint64(0))
            above |= equal & counters[k] & ~want
            equal &= ~(counters[k] ^ want)
        return above

    def keep(self, which: np.ndarray) -> None:
        self.low = [c[which] for c in self.low]
        self.high = [c[which] for c in self.high]
        self.u, self.v = np.empty(len(which), dtype=np.uint64), np.empty(len(which), dtype=np.uint64)


def within_radius(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For work items (word, query sketch, radius, lanes that count): bits of the lanes within the radius."""
    width, n = planes.shape[0], len(word)
    counters = Counters(n, max(4, int(width).bit_length()))
    out, live = np.zeros(n, dtype=np.uint64), np.arange(n)
    stops = [0, width // 2 // 8 * 8, width * 3 // 4 // 8 * 8, width]
    for begin, end in zip(stops, stops[1:], strict=False):
        columns = np.ascontiguousarray(query[:, begin // 8 : end // 8].T)
        m = len(word)
        bit = np.empty(m, dtype=np.uint8)
        data, spare, mask = [np.empty(m, dtype=np.uint64) for _ in range(8)], [np.empty(m, dtype=np.uint64) for _ in range(8)], np.empty(m, dtype=np.uint64)
        for p in range(begin, end, 8):
            for k in range(8):
                np.take(planes[p + k], word, out=data[k], mode="clip")
                np.right_shift(columns[(p - begin) >> 3], k, out=bit)
                np.bitwise_and(bit, 1, out=bit)
                np.negative(bit, dtype=np.int64, casting="unsafe", out=mask.view(np.int64))
                np.bitwise_xor(data[k], mask, out=data[k])
            counters.add8(data, spare)
        near = ~counters.over(radius) & valid
        if end == width:
            out[live] = near
        else:
            going = np.flatnonzero(near)
            live, word, query, radius, valid = live[going], word[going], query[going], radius[going], valid[going]
            counters.keep(going)
            if not len(going):
                break
    return out


def radius_of(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Most tokens that only one of two sets may hold, of the sum of their sizes."""
    return np.floor((1 - threshold) / (1 + threshold) * sizes + 1e-9).astype(np.int64)


def block_pairs(sketches: np.ndarray, sizes: np.ndarray, doc: np.ndarray, token: np.ndarray, lane: np.ndarray, probe: np.ndarray, most: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (a, b), a < b, of documents that share a token and lie within the radius.

    ``token`` are non-negative and below 2^31. An entry is (doc, token, lane?, probe?, most): as a lane it can be found, as a
    probe it looks for lanes of its token that come before it in the order of
    (size, doc), of sizes from ``threshold * size`` up to ``most``.
    """
    rank = np.empty(len(sizes), dtype=np.int64)
    rank[np.argsort(sizes, kind="stable")] = np.arange(len(sizes))
    by_size = np.sort(sizes)
    span = len(sizes) + 1
    key = token * span + rank[doc]
    order = np.argsort(key)
    doc, dense, key, lane, probe, most = doc[order], token[order], key[order], lane[order], probe[order], most[order]
    lanes = np.flatnonzero(lane)
    lane_key, lane_doc = key[lanes], doc[lanes]
    q = np.flatnonzero(probe)
    size_q = sizes[doc[q]]
    least = np.searchsorted(by_size, np.ceil(threshold * size_q - 1e-9))
    upmost = np.searchsorted(by_size, most[q], side="right")
    lo = np.searchsorted(lane_key, dense[q] * span + least)
    hi = np.searchsorted(lane_key, np.minimum(key[q], dense[q] * span + upmost))
    some = hi > lo
    q_doc, lo, hi, size_q = doc[q][some], lo[some], hi[some], size_q[some]
    found = []
    for start in range(0, len(lanes), LANES):
        end = min(start + LANES, len(lanes))
        here = np.flatnonzero((lo < end) & (hi > start))
        if not len(here):
            continue
        planes = planes_of(sketches[lane_doc[start:end]])
        a, b = np.maximum(lo[here], start) - start, np.minimum(hi[here], end) - start
        first, words = a >> 6, ((b - 1) >> 6) - (a >> 6) + 1
        ends = np.cumsum(words)
        total = int(ends[-1])
        for at in range(0, total, ITEMS):
            i = np.arange(at, min(at + ITEMS, total))
            one, last_one = np.searchsorted(ends, [i[0], i[-1]], side="right")
            share = np.minimum(ends[one : last_one + 1], i[-1] + 1) - np.maximum(ends[one : last_one + 1] - words[one : last_one + 1], i[0])
            who = np.repeat(np.arange(one, last_one + 1), share)
            word = first[who] + i - (ends[who] - words[who])
            left = np.maximum(a[who] - word * 64, 0).astype(np.uint64)
            right = np.minimum(b[who] - word * 64, 64).astype(np.uint64)
            valid = (_ALL << left) & (_ALL >> (np.uint64(64) - right))
            last = sizes[lane_doc[start + word * 64 + right.astype(np.int64) - 1]]
            query = q_doc[here[who]]
            hits = within_radius(planes, word, sketches[query], radius_of(size_q[here[who]] + last, threshold), valid)
            some_hit = np.flatnonzero(hits)
            if len(some_hit):
                bits = np.unpackbits(hits[some_hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                item, bit = np.nonzero(bits)
                x, y = lane_doc[start + word[some_hit[item]] * 64 + bit], query[some_hit[item]]
                apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1)
                near = apart <= radius_of(sizes[x] + sizes[y], threshold)
                x, y = x[near], y[near]
                found.append(np.unique(np.minimum(x, y).astype(np.int64) * span + np.maximum(x, y)))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
    if not found:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs // span, pairs % span], axis=1)
