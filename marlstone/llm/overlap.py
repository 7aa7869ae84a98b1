"""Problem 1: the same or nearly the same records across splits.

Exact prefix-filter bipartite join on rare shingles. Tokens are ordered by how
many training records hold them, rarest first; tokens no evaluation record
holds come first of all. Two sets with Jaccard similarity >= t must share a
token within the first ``len - ceil(t * len) + 1`` of each, so the evaluation
side's prefixes are indexed and every training record probes with its own
prefix. Length and position filters discard most candidates before the sets
are intersected; a pair is looked at under its first common token only.

Probing is a map over the training side: nothing of it is shuffled or grouped,
so a hot query costs its share of rows and no more. The index is broadcast in
blocks of about ``block_chars`` characters, so its size is bounded however large
that side is; tokens are counted in one pass for all blocks, probing takes a pass a block.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import cleaned, shingle_codes
from marlstone.runtime import plain, spread, staged

#: Tokens a task counts at a time.
HELD = 1_000_000
#: Characters of the evaluation records of a block; the index of one takes about 100 MB.
BLOCK_CHARS = 1_000_000


def _codes(text: str, n: int) -> list[int]:
    return shingle_codes(text, n).tolist()


class PrefixIndex:
    """Prefixes of one block of evaluation records, probed with one cleaned text at a time."""

    def __init__(self, records: list[tuple[str, str]], frequency: dict[int, int], n: int, threshold: float) -> None:
        self.n, self.t, self.frequency = n, threshold, frequency
        self.ids, self.sets = [r[0] for r in records], []
        self.postings: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for row, (_, text) in enumerate(records):
            tokens = sorted(_codes(text, n), key=self.order)
            self.sets.append(frozenset(tokens))
            for at, token in enumerate(tokens[: self.prefix(len(tokens))]):
                self.postings[token].append((row, at, len(tokens)))

    def order(self, token: int) -> tuple[int, int]:
        return self.frequency.get(token, -1), token

    def prefix(self, size: int) -> int:
        return size - math.ceil(self.t * size - 1e-9) + 1

    def probe(self, text: str) -> list[tuple[str, float]]:
        """(id, similarity) of the block's records at or above the threshold."""
        tokens = _codes(text, self.n)
        size = len(tokens)
        if not size:
            return []
        known = sorted((t for t in tokens if t in self.frequency), key=self.order)
        unseen, own, seen, out = size - len(known), None, set(), []
        for at, token in enumerate(known[: max(0, self.prefix(size) - unseen)], unseen):
            for row, there, other in self.postings.get(token, ()):
                if row in seen:
                    continue
                seen.add(row)
                if min(size, other) < self.t * max(size, other) - 1e-9:
                    continue
                need = math.ceil(self.t / (1 + self.t) * (size + other) - 1e-9)
                if 1 + min(size - at - 1, other - there - 1) < need:
                    continue
                own = own or frozenset(tokens)
                common = len(own & self.sets[row])
                if common >= need:
                    out.append((self.ids[row], common / (size + other - common)))
        return out


def _token_counts(train: DataFrame, n: int, min_chars: int, known: set[int] | None = None) -> DataFrame:
    """token, n: how many training records hold each token, of the known ones if given; they are counted before the shuffle."""
    asked = train.sparkSession.sparkContext.broadcast(known)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, wanted = Counter(), asked.value
        for b in batches:
            for raw, times in b["text"].value_counts().items():
                x = cleaned(raw)
                if len(x) >= min_chars:
                    for t in _codes(x, n):
                        if wanted is None or t in wanted:
                            held[t] += times
            if len(held) > HELD:
                yield pd.DataFrame({"token": list(held.keys()), "n": list(held.values())})
                held.clear()
        if held:
            yield pd.DataFrame({"token": list(held.keys()), "n": list(held.values())})

    counts = train.mapInPandas(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return counts if known is not None else staged(counts, "tokens")


def cross_split_overlaps(
    evaluation: DataFrame,
    training: DataFrame,
    eval_id: str,
    train_id: str,
    text: str = "query",
    n: int = 2,
    threshold: float = 0.6,
    min_chars: int = 4,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Columns eval_id, train_id, similarity: every pair of an evaluation and a training row
    whose cleaned texts have ``min_chars`` or more characters and whose sets of ``n``-character
    substrings have a Jaccard similarity of at least ``threshold``.

    Null, blank and too short texts pair with nothing; an empty side gives no
    rows. Repeated ids with repeated texts come out as often as they stand
    there. Other columns are not read, whatever their names.
    """
    spark = training.sparkSession
    kinds = {"e": dict(evaluation.dtypes)[eval_id], "t": dict(training.dtypes)[train_id]}
    schema = f"{eval_id} {kinds['e']}, {train_id} {kinds['t']}, similarity double"

    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({"id": b.iloc[:, 0], "text": b.iloc[:, 1].map(cleaned)})
            out = out[np.array([len(t) >= min_chars for t in out["text"]], dtype=bool)]
            if len(out):
                yield plain(out)

    side = evaluation.select(F.col(eval_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    indexed = staged(side.mapInPandas(tidy, f"id {kinds['e']}, text string"), "evaluation")
    chars = indexed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    train = spread(training).select(F.col(train_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    everywhere = _token_counts(train, n, min_chars) if blocks > 1 else None
    out = None
    for k in range(blocks):
        part = indexed if blocks == 1 else indexed.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        records = [(r["id"], r["text"]) for r in part.toLocalIterator()]
        known = {t for _, x in records for t in _codes(x, n)}
        frequency = dict.fromkeys(known, 0)
        if everywhere is None:
            counts = _token_counts(train, n, min_chars, known)
        else:
            asked = spark.createDataFrame(pd.DataFrame({"token": np.fromiter(known, dtype=np.int64, count=len(known))}), "token long")
            counts = everywhere.join(F.broadcast(asked), "token", "left_semi")
        frequency.update((r["token"], r["n"]) for r in counts.toLocalIterator())
        index = spark.sparkContext.broadcast(PrefixIndex(records, frequency, n, threshold))

        def probed(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = {}
                ids, ours, alike = [], [], []
                for key, raw in zip(b["id"], b["text"], strict=True):
                    hits = found.get(raw)
                    if hits is None:
                        x = cleaned(raw)
                        hits = found[raw] = index.value.probe(x) if len(x) >= min_chars else []
                    for other, similarity in hits:
                        ids.append(other), ours.append(key), alike.append(similarity)
                if ids:
                    yield plain(pd.DataFrame({eval_id: ids, train_id: ours, "similarity": alike}))

        found = train.mapInPandas(probed, schema)
        out = found if out is None else out.unionByName(found)
    return out
