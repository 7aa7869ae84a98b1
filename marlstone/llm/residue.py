"""Problem 8: template residue, filler and error-page text in place of content.

Character n-gram models are fitted to filler, to notices (errors, access, scripts,
cookies), to unfilled places, to prose about such things, and to natural prose. A
character's gain is its log-likelihood under the best residue model over natural
prose; windows of high summed gain localise residue, wherever in a text it stands.
A window is dismissed if the prose around it, in its own sentence, reads as being
about such strings. What part of a text the windows cover is its coverage.

The labelled kinds come from ``seeds``. Natural prose is learnt from all texts of the
corpus, whole: each task counts how often its texts have the labelled n-grams, and the
counts are summed up, a number for each n-gram of the seeds, whatever the corpus. Names
of fields by themselves count as natural, so only what stands around or for them is
evidence. Sentences that hold a piece of the labelled residue are kept out of natural
prose, however often they occur, and texts that are often repeated count once, so
residue never becomes prose by being common. Every text is scored as a whole; only
characters that end a labelled n-gram of three can gain, all others lose ``GAP``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import seeds
from marlstone.llm.ngrams import ORDER, Bank, Batch, Counts, best_windows
from marlstone.llm.repeats import once_each
from marlstone.runtime import spread

#: N-grams of four characters that make a piece, where none of them has a template sign, within a run of known ones that are no names of fields; without and with Han characters.
PIECE = {"slot": (6, 3), "notice": (16, 4), "filler": (12, 2)}
#: What prose about residue must be ahead of residue by to end a window.
AHEAD = 1.5
#: Summed log-likelihood gain of a residue window, and of the prose around it to dismiss it.
GAIN = {"slot": 7.5, "notice": 13.0, "filler": 13.0}
ABOUT_GAIN, AROUND = 8.0, 28
#: Shortest window; the shortest unfilled place is a digit in braces.
SHORTEST = 3
#: Most that one character may gain or lose, and what one loses that ends no labelled n-gram.
MOST, GAP = 5.5, 2.0
_ENDS = re.compile(r"[。；\n!?！？;]|\. ")
_TEMPLATE = re.compile(r"[{}$%#<>\[\]_@【】［］×＿\ue000\ue001]|XX|xx|TBD|TOD|FIX|N/A|NaN|nul|[:：] ?(?:nul|und|Non|NaN|N/A)")
_STATUS = re.compile(r"\d [A-Z][a-z]")
_SHORT = re.compile(r"(?![\s0-9]{3})[^A-Za-z]{3}", re.S)
_END_CODES = np.array([ord(c) for c in "。；\n!?！？;\x02"], dtype=np.uint32)
#: Texts of about so many characters are counted and scored at once.
AT_ONCE = 500_000


@lru_cache(maxsize=1)
def _seeded() -> Labelled:
    return Labelled()


def labelled() -> Labelled:
    """Fitted to the seeds once a process; each fit to a corpus has a bank of its own."""
    own = copy(_seeded())
    own.bank = copy(own.bank)
    return own


class Labelled:
    """The labelled models, and which of their n-grams are what."""

    def __init__(self) -> None:
        texts = [seeds.field_texts(), seeds.about_texts(), seeds.slot_texts(), seeds.notice_texts(), seeds.filler_texts()]
        self.bank = Bank([Counts(t) for t in texts])
        four = self.bank.count[ORDER - 1] > 0
        sound = four[:, 0]
        signs = np.union1d(_grams_like(texts[2], 4, _TEMPLATE), _grams_like(seeds.CODES, 4, _STATUS))
        #: N-grams of four that by themselves are a piece: with a template sign, or a status number and its name.
        self.certain = four[:, 2:].any(axis=1) & ~sound & np.append(np.isin(self.bank.keys[3], signs), False)
        self.pieces = {kind: (four[:, m], four[:, m] & ~sound) for kind, m in (("slot", 2), ("notice", 3), ("filler", 4))}
        # of three characters those without letters, as the shortest places have no more
        short = _grams_like(texts[2] + texts[4], 3, _SHORT)
        three = self.bank.count[2] > 0
        self.short = np.append(np.isin(self.bank.keys[2], short), False) & ~three[:, 0]
        #: N-grams of three that residue or prose about it has.
        self.telling = three[:, 1:].any(axis=1)

    def holding(self, batch: Batch, rows: list[np.ndarray]) -> np.ndarray:
        """For each place of the batch, whether its sentence holds a piece of the labelled residue."""
        hit = self.certain[rows[3]] | self.short[rows[2]]
        han = np.concatenate([[0], np.cumsum((batch.codes >= 0x4E00) & (batch.codes <= 0x9FFF))])
        for kind, (known, telling) in self.pieces.items():
            own = known[rows[3]]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
            told = np.concatenate([[0], np.cumsum(telling[rows[3]])])
            start, end = edges[:, 0], edges[:, 1]
            with_han = han[end] > han[np.maximum(0, start - 3)]
            piece = told[end] - told[start] >= np.where(with_han, PIECE[kind][1], PIECE[kind][0])
            hit[start[piece]] = True
        ends = np.isin(batch.raw, _END_CODES)
        ends[1:] |= (batch.raw[:-1] == ord(".")) & (batch.raw[1:] == ord(" "))
        sentence = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, dtype=np.int64)
        return (np.bincount(sentence, weights=hit) > 0)[sentence] if len(sentence) else hit


def _grams_like(texts: list[str], n: int, pattern: re.Pattern) -> np.ndarray:
    """Hashes of the ``n``-grams of the texts that the pattern is found in."""
    batch = Batch(texts)
    raw = batch.raw.tobytes().decode("utf-32-le", "surrogatepass")
    at = [i for i in np.flatnonzero(batch.inside).tolist() if pattern.search(raw, i + 1 - n, i + 1) and (n > 3 or "\2" not in raw[i + 1 - n : i + 1])]
    return np.unique(batch.grams[n - 1][at])


def _batches(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def natural_counts(texts: Iterable[str], own: Labelled | None = None) -> tuple[list[np.ndarray], int]:
    """(counts of the labelled n-grams by order, characters) of the sentences that hold no labelled residue."""
    own = own or labelled()
    out, size = [np.zeros(n, dtype=np.int64) for n in own.bank.sizes()], 0
    for held in _batches(texts):
        batch = Batch(held)
        rows = own.bank.rows_of(batch.grams)
        kept = batch.inside & ~own.holding(batch, rows)
        size += int(kept.sum())
        for k, n in enumerate(out):
            n += np.bincount(rows[k][kept], minlength=len(n) + 1)[: len(n)]
    return out, size


class Residue:
    """The fitted models; judges texts."""

    kinds = tuple(GAIN)

    def __init__(self, natural: Iterable[str] | tuple[list[np.ndarray], int]) -> None:
        self.labelled = labelled()
        self.labelled.bank.learn(*(natural if isinstance(natural, tuple) else natural_counts(natural)))

    def windows(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the residue in a text."""
        return self.windows_of([text])[0]

    def windows_of(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = []
        for held in _batches(texts):
            out += self._judged(held)
        return out

    def _judged(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        own, batch = self.labelled, Batch(texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        rows = own.bank.rows_of(batch.grams)
        ends = np.flatnonzero(own.telling[rows[2]])
        if not len(ends):
            return out
        at = np.unique(np.concatenate([ends, ends - 1, ends - 2]))
        at = at[at >= 0]
        at = at[batch.inside[at]]
        scores = own.bank.log_prob(rows, at)
        natural, residue = np.maximum(scores[:, 0], scores[:, 1]), scores[:, 3:].max(axis=1)
        sound = np.where(scores[:, 2] > residue + AHEAD, np.maximum(natural, scores[:, 2]), natural)
        about = np.clip(scores[:, 2] - np.maximum(natural, residue), -MOST, MOST)
        starts = np.cumsum([ORDER - 1, *(len(t) + ORDER - 1 for t in texts)])[:-1]
        doc = np.searchsorted(starts, at, side="right") - 1
        for k, kind in enumerate(self.kinds):
            gain = np.clip(scores[:, 3 + k] - sound, -MOST, MOST)
            for first, last in _clusters(at, doc, gain, GAIN[kind]):
                dense = np.full(at[last - 1] - at[first] + 1, -GAP)
                dense[at[first:last] - at[first]] = gain[first:last]
                d, base = int(doc[first]), int(at[first] - starts[doc[first]])
                out[d] += [(base + a, base + b, kind) for a, b, _ in best_windows(dense, GAIN[kind]) if b - a >= SHORTEST]
        for d, found in enumerate(out):
            if found:
                lo, hi = np.searchsorted(doc, [d, d + 1])
                gain = np.full(len(texts[d]), -GAP)
                gain[at[lo:hi] - starts[d]] = about[lo:hi]
                out[d] = [w for w in sorted(found) if not self._about(texts[d], gain, w[0], w[1])]
        return out

    @staticmethod
    def _about(text: str, gain: np.ndarray, start: int, end: int) -> bool:
        """Whether the sentence around the window speaks about it."""
        left, right = max(0, start - AROUND), min(len(text), end + AROUND)
        for m in _ENDS.finditer(text, left, start):
            left = m.end()
        m = _ENDS.search(text, end, right)
        right = m.start() if m else right
        return any(b - a >= 4 and best_windows(gain[a:b], ABOUT_GAIN) for a, b in ((left, start), (end, right)))


def _clusters(at: np.ndarray, doc: np.ndarray, gain: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Ranges of ``at`` that may hold a window: no window reaches over a gap that costs ``least``, and what gains less in all has none."""
    cut = np.flatnonzero(((np.diff(at) - 1) * GAP >= least) | (np.diff(doc) > 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    most = np.add.reduceat(np.maximum(gain, 0), first)
    return [(int(a), int(b)) for a, b in zip(first[most >= least], last[most >= least], strict=True)]


def fitted(rows: DataFrame, text: str) -> Residue:
    """Counts over all texts: at most a row a labelled n-gram from each task."""
    own = rows.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    held = rows.sparkSession.sparkContext.broadcast(labelled())

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, size = natural_counts((t for b in batches for t in b["text"]), held.value)
        at = [np.flatnonzero(n) for n in counts]
        kinds = np.repeat(np.arange(ORDER + 1), [len(x) for x in at] + [1])
        yield pd.DataFrame({"kind": kinds.astype(np.int32), "row": np.concatenate([*at, [0]]).astype(np.int32), "n": np.concatenate([*(n[x] for n, x in zip(counts, at, strict=True)), [size]]).astype(np.int64)})

    table = spread(once_each(own, "text")).mapInPandas(counted, "kind int, row int, n long").groupBy("kind", "row").agg(F.sum("n").alias("n")).toPandas()
    counts = []
    for k, size in enumerate(labelled().bank.sizes()):
        part = table[table["kind"] == k]
        counts.append(np.bincount(part["row"], weights=part["n"], minlength=size).astype(np.int64))
    return Residue((counts, int(table.loc[table["kind"] == ORDER, "n"].sum())))


def find_residue(rows: DataFrame, text: str, least_coverage: float = 0.0) -> DataFrame:
    """``rows`` with columns residue (boolean), coverage (share of characters) and kinds (array of slot, notice, filler).

    A text is residue if it has a window and these cover at least
    ``least_coverage`` of it; 0 asks for any one place. Null and empty texts are
    none. Repeated texts are judged alike, each row for itself; columns of these
    names in ``rows`` are replaced.
    """
    held = rows.sparkSession.sparkContext.broadcast(fitted(rows, text))

    @F.pandas_udf("residue boolean, coverage double, kinds array<string>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = texts.fillna("")
            distinct, known = list(dict.fromkeys(own)), {}
            for t, found in zip(distinct, held.value.windows_of(distinct), strict=True):
                covered = np.zeros(len(t), dtype=bool)
                for start, end, _ in found:
                    covered[start:end] = True
                share = float(covered.mean()) if t else 0.0
                known[t] = (bool(found) and share >= least_coverage, share, sorted({k for _, _, k in found}))
            yield pd.DataFrame([known[t] for t in own], columns=["residue", "coverage", "kinds"])

    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("residue", "coverage", "kinds")]
    marked = spread(rows).select(*keep, judged(F.col(text)).alias("_judged"))
    return marked.select(*keep, "_judged.residue", "_judged.coverage", "_judged.kinds")
