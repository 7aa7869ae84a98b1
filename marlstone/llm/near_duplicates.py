"""Problem 5: near-duplicate texts in a collection too large for pairwise comparison.

Texts are classes of equal cleaned text, so exact copies are one. A class's set
of ``n``-character substrings is ordered by rarity in the corpus; two sets within
the threshold share a token in their prefixes, so each class is posted under its
prefix tokens only. Postings travel in bundles to blocks of tokens; a bundle
carries each class's bit sketch once. In a block, all classes that share a
token are compared bit-sliced (see ``bitslice``): no pair within the threshold is
lost, and what survives is verified on the texts themselves.

What bounds the work at any size:

* rarity is counted in a table of 2^20 to 2^22 token buckets, as the corpus grows
  (16 MB at most, broadcast). Any order is exact, as long as both sides use the
  same; buckets cost rarity only;
* the number of blocks grows with the postings, so a block stays a few megabytes;
* where a bucket holds more than ``HOT`` occurrences, its tokens are counted each
  for itself, as often as they are posted. A token of more than ``HOT`` postings
  is a grid of (rows x columns) tokens, each comparing a share of the holders as
  lanes with a share as probes; all other tokens are posted once, however full
  their bucket. The list of split tokens is broadcast; beyond ``HOT_TOKENS`` of
  them the limit is doubled until they fit, as no more than postings / limit
  tokens can exceed it, so no token is left out, only its cells are larger;
* equal texts are merged before they are posted, per batch, and in the block.

Classes are named by 128 bits of a cryptographic digest of the cleaned text. In
blocks the first 64 stand for it, together with size and sketch; what comes out
of a block is verified on all texts with these 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import all_codes, cleaned, shingle_codes
from marlstone.llm.bitslice import block_pairs, parity_sketches
from marlstone.runtime import BROADCAST_ROWS, HOT_ROWS, join_lookup, plain, spread, staged, within

#: Bits of the rarity table at least and at most, and occurrences a bucket aims at between these.
BUCKET_BITS, FULL = (20, 22), 16
#: Postings of a token beyond which it is split, and the most tokens that may be.
HOT, HOT_TOKENS = 20_000, 1_000_000
#: Postings a block aims at; a block of that many takes about 100 MB.
BLOCK_ENTRIES = 1_500_000
LEAST_BLOCKS = 8
SLOTS = 512
#: Classes that are asked for and may be broadcast, eight bytes each.
ASKED = 1_000_000
#: Copies of a text that meet all its copies in one task.
COPIES = 2_000
#: Sketch bits and largest set of the first size class; each further class is four times either.
WIDTH, LARGEST = 192, 320
BUNDLE_DOCS = 16_384


def _class_of(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _mixed(code: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = code.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    """``buckets`` is a power of two."""
    return (token >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _batches_of_classes(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(keys, token sets, sizes) of distinct classes, bundle by bundle."""
    for b in batches:
        b = b.drop_duplicates(["short", "text"])
        for at in range(0, len(b), BUNDLE_DOCS):
            part = b.iloc[at : at + BUNDLE_DOCS]
            flat, sizes = codes_of_each(part["text"].tolist(), n)
            ends, flat = np.cumsum(sizes), _mixed(flat)
            yield part["short"].to_numpy(), [flat[b - n_ : b] for b, n_ in zip(ends.tolist(), sizes.tolist(), strict=True)], sizes


def codes_of_each(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, numbers a text): the distinct codes of each text, sorted, one text after another; as ``shingle_codes``, but made all at once."""
    joined = np.frombuffer("\0".join([*texts, "\0" * n]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    end = len(joined) - n + 1
    code = joined[:end].copy()
    for k in range(1, n):
        code = (code << 21) | joined[k : end + k]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    many = np.maximum(lengths - n + 1, 0)
    starts = np.cumsum(lengths + 1) - lengths - 1
    for a, m in zip(starts.tolist(), many.tolist(), strict=True):
        code[a : a + m].sort()
    marks = np.zeros(end + 1, dtype=np.int8)
    np.add.at(marks, starts[many > 0], 1)
    np.add.at(marks, (starts + many)[many > 0], -1)
    inside = np.cumsum(marks[:end]) > 0
    first = np.ones(end, dtype=bool)
    np.not_equal(code[1:], code[:-1], out=first[1:])
    first[starts[many > 0]] = True
    kept = inside & first
    before = np.concatenate([[0], np.cumsum(kept)])
    return code[kept], before[starts + many] - before[starts]


def _bundle(keys: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, entries: np.ndarray, token: np.ndarray, flags: np.ndarray) -> bytes:
    """One block's share of a bundle: classes, entries a class, and 4 bytes an entry (24 of token, 2 of role, 6 of position)."""
    packed = np.empty((len(token), 4), dtype=np.uint8)
    packed[:, :3] = (token & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    packed[:, 3] = flags
    size, many = (1 if x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 for x in (sizes, entries))
    head = np.array([len(keys), sketches.shape[1], size, many], dtype="<u4").tobytes()
    return head + keys.astype("<i8").tobytes() + sizes.astype(f"<u{size}").tobytes() + entries.astype(f"<u{many}").tobytes() + sketches.tobytes() + packed.tobytes()


def _unbundle(data: bytes) -> tuple[np.ndarray, ...]:
    n, w, size, many = (int(x) for x in np.frombuffer(data, "<u4", 4))
    parts, at = [], 16
    for kind, count in (("<i8", n), (f"<u{size}", n), (f"<u{many}", n), ("u1", n * w)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    keys, sizes, entries, sketches = parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].reshape(n, w)
    packed = np.frombuffer(data, np.uint8, offset=at).reshape(-1, 4)
    token = packed[:, 0].astype(np.int64) | packed[:, 1].astype(np.int64) << 8 | packed[:, 2].astype(np.int64) << 16
    return keys, sizes, np.repeat(np.arange(n), entries), sketches, token, packed[:, 3]


def _prefix(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1


def _picked(flat: np.ndarray, rarity: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``flat`` of each set's prefix, their numbers a set).

    Rarest first, then by token; of tokens alike in both parts of the key the order of the codes decides, in every text.
    """
    rank = (rarity.astype(np.uint64) << np.uint64(33)) | (flat >> np.uint64(31))
    starts = np.cumsum(sizes) - sizes
    picks = [a + rank[a : a + n].argsort(kind="stable")[:k] for a, n, k in zip(starts.tolist(), sizes.tolist(), _prefix(sizes, threshold).tolist(), strict=True)]
    return np.concatenate(picks), np.array([len(x) for x in picks])


def posted_in_full_buckets(counts: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, postings of each) among the prefixes, of the buckets with more than HOT occurrences."""
    flat = np.concatenate(sets)
    rarity = counts[_bucket(flat, len(counts))]
    # a set with as many rarer tokens as its prefix is long posts none of these
    rarer = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[rarity <= HOT], minlength=len(sizes))
    some = np.flatnonzero(rarer < _prefix(sizes, threshold))
    if not len(some):
        return flat[:0], np.zeros(0, dtype=np.int64)
    own = np.isin(np.repeat(np.arange(len(sizes)), sizes), some)
    flat, rarity = flat[own], rarity[own]
    pick, _ = _picked(flat, rarity, sizes[some], threshold)
    return np.unique(flat[pick[rarity[pick] > HOT]], return_counts=True)


def may_post_full(texts: list[str], n: int, counts: np.ndarray, threshold: float) -> np.ndarray:
    """For each text, whether its prefix may hold a token of a bucket with more than HOT occurrences; never false where it does.

    Distinct rarer tokens are counted at every second place, in ``SLOTS`` slots a text: at most as many as there are. Repeats only
    lengthen the prefix reckoned with.
    """
    joined = np.frombuffer("\0".join([*texts, "\0" * (n + 1)]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    end = len(joined) - n
    code, inside = joined[:end:2].copy(), joined[:end:2] != 0
    for k in range(1, n):
        part = joined[k : end + k : 2]
        code = (code << 21) | part
        inside &= part != 0
    doc = (np.cumsum(joined == 0)[:end:2])[inside]
    token = _mixed(code[inside])
    rare = counts[_bucket(token, len(counts))] <= HOT
    slots = np.zeros(len(texts) * SLOTS, dtype=bool)
    slots[doc[rare] * SLOTS + (token[rare] % np.uint64(SLOTS)).astype(np.int64)] = True
    most = np.maximum(np.array([len(t) for t in texts], dtype=np.int64) - n + 1, 0)
    return slots.reshape(-1, SLOTS).sum(axis=1) < _prefix(most, threshold)


class Poster:
    """Turns bundles of classes into rows (size class, block, bundle).

    ``counts`` gives the rarity of a token's bucket; ``hot`` are the sorted tokens that are split, ``sides`` the rows and columns of each.
    """

    def __init__(self, counts: np.ndarray, blocks: int, threshold: float, hot: np.ndarray | None = None, sides: np.ndarray | None = None) -> None:
        self.counts, self.blocks, self.t = counts, blocks, threshold
        self.hot = np.zeros(0, dtype=np.uint64) if hot is None else hot
        self.sides = np.zeros(0, dtype=np.int64) if sides is None else sides

    def _sides(self, token: np.ndarray) -> np.ndarray:
        out = np.ones(len(token), dtype=np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, token), len(self.hot) - 1)
            split = self.hot[at] == token
            out[split] = self.sides[at[split]]
        return out

    def _size_classes(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least size class of each set, whether it is in the next one too, as it may be like a larger set)."""
        level, largest = np.zeros(len(sizes), dtype=np.int64), np.full(len(sizes), LARGEST, dtype=np.int64)
        while (over := sizes > largest).any():
            level += over
            largest = np.where(over, largest * 4, largest)
        return level, sizes >= self.t * (largest + 1) - 1e-9

    def rows(self, keys: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        if not len(sets):
            return
        flat = np.concatenate(sets)
        rarity = self.counts[_bucket(flat, len(self.counts))]
        pick, lengths = _picked(flat, rarity, sizes, self.t)
        doc = np.repeat(np.arange(len(sets)), lengths)
        spot = np.arange(len(pick)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = rarity[pick] > 1
        doc, token, spot = doc[shared], flat[pick[shared]], spot[shared]
        least, also = self._size_classes(sizes)
        for level in np.union1d(least, least[also] + 1).tolist():
            member = (least == level) | (also & (least == level - 1))
            width = WIDTH << (2 * level)
            chosen = np.flatnonzero(member)
            local = np.full(len(sizes), -1)
            local[chosen] = np.arange(len(chosen))
            step = max(1, (1 << 22) // width)
            sketches = np.concatenate(
                [
                    parity_sketches(np.repeat(np.arange(len(part)), sizes[part]), np.concatenate([sets[i] for i in part]), len(part), width)
                    for part in (chosen[k : k + step] for k in range(0, len(chosen), step))
                ]
            )
            mine = member[doc]
            yield from self._blocks(level, keys[chosen], sketches, sizes[chosen], local[doc[mine]], token[mine], spot[mine])

    def _blocks(self, level: int, keys: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, doc: np.ndarray, token: np.ndarray, spot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        size = sizes[doc]
        index = size - np.ceil(2 * self.t / (1 + self.t) * size - 1e-9).astype(np.int64) + 1
        # 6 bits of position, rounded down so that a probe never looks at too few sizes
        place = np.minimum(63, spot * 64 // np.maximum(1, _prefix(size, self.t))).astype(np.uint8)
        lane, probe = spot < index, np.ones(len(doc), dtype=bool)
        sides = self._sides(token)
        token = _mixed(token + np.uint64(level))
        doc, token, lane, probe, place = self._grid(keys, doc, token, lane, probe, place, sides)
        flags = (lane.astype(np.uint8) << 7) | (probe.astype(np.uint8) << 6) | place
        block = (token >> np.uint64(24)) % np.uint64(self.blocks)
        order = np.lexsort((doc, block))
        doc, token, flags, block = doc[order], token[order], flags[order], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, dtype=np.int64)
        for a, b in zip(starts, np.r_[starts[1:], len(block)], strict=True):
            own, entries = np.unique(doc[a:b], return_counts=True)
            yield level, int(block[a]), _bundle(keys[own], sketches[own], sizes[own], entries, token[a:b], flags[a:b])

    @staticmethod
    def _grid(keys: np.ndarray, doc: np.ndarray, token: np.ndarray, lane: np.ndarray, probe: np.ndarray, place: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, ...]:
        """Splits tokens of more than HOT holders into a grid: cell (r, c) compares the lanes of row r with the probes of column c."""
        cool = sides <= 1
        if cool.all():
            return doc, token, lane, probe, place
        hot = np.flatnonzero(~cool)
        at = np.repeat(hot, sides[hot])
        side = sides[at].astype(np.uint64)
        cell = (np.arange(len(at)) - np.repeat(np.cumsum(sides[hot]) - sides[hot], sides[hot])).astype(np.uint64)
        own = keys[doc[at]].astype(np.uint64) % side
        yes, no = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
        parts = [
            (doc[cool], token[cool], lane[cool], probe[cool], place[cool]),
            tuple(x[lane[at]] for x in (doc[at], _mixed(token[at] + own * side + cell + np.uint64(1)), yes, no, place[at])),
            (doc[at], _mixed(token[at] + cell * side + own + np.uint64(1)), no, yes, place[at]),
        ]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of classes of one block that lie within the radius."""
    parts = [_unbundle(x) for x in group["bundle"]]
    base = np.cumsum([0] + [len(p[0]) for p in parts])
    keys, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    sketches = np.concatenate([p[3] for p in parts])
    doc = np.concatenate([p[2] + base[i] for i, p in enumerate(parts)])
    token, flags = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
    named, first, same = np.unique(keys, return_index=True, return_inverse=True)
    if (sizes != sizes[first[same]]).any() or (sketches != sketches[first[same]]).any():  # two texts of one short key
        rows = np.hstack([x.astype("<i8").view(np.uint8).reshape(-1, 8) for x in (keys, sizes)] + [sketches])
        _, first, same = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        named = keys[first]
    keys = named
    own = first[same[doc]] == doc  # equal texts of other bundles have equal entries
    doc, token, flags = same[doc[own]], token[own], flags[own]
    sizes, sketches = sizes[first], sketches[first]
    size = sizes[doc]
    prefix = _prefix(size, threshold)
    spot = (flags & 63).astype(np.int64) * prefix // 64
    most = np.floor((size - spot) * (1 + threshold) / threshold - size + 1e-9).astype(np.int64)
    pairs = block_pairs(sketches, sizes, doc, token, flags >= 128, (flags & 64) > 0, most, threshold)
    a, b = keys[pairs[:, 0]], keys[pairs[:, 1]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def similar_texts(
    rows: DataFrame, item: str, text: str, threshold: float = 0.7, n: int = 3, min_chars: int = 40, leave_out: Callable[[str], bool] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: item, key - each item with the class of each of its texts of at
    least ``min_chars`` cleaned characters; links: a, b, similarity - every pair of different classes,
    a < b, whose sets of ``n``-character substrings have a Jaccard similarity of at least ``threshold``.

    Null items and null, empty or too short texts are left out, and those for
    which ``leave_out`` is true; it runs on the executors and must pickle. An item may have
    several texts, and be repeated. Texts of any length are used whole.
    """
    spark = rows.sparkSession
    skip = spark.sparkContext.broadcast(leave_out)

    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_of_it = skip.value
        for b in batches:
            known, firsts = {}, set()
            for raw in b["raw"].unique():
                t = cleaned(raw)
                if len(t) >= min_chars and not (out_of_it is not None and out_of_it(raw)):
                    key = _class_of(t)
                    known[raw] = (_short(key), key, t)
            b = b[b["raw"].isin(known.keys())]
            if len(b):
                found = [known[raw] for raw in b["raw"]]
                first = [k[1] not in firsts and not firsts.add(k[1]) for k in found]  # a text goes once a batch
                out = {"item": b["item"], "short": [k[0] for k in found], "key": [k[1] for k in found], "text": [k[2] if f else None for k, f in zip(found, first, strict=True)]}
                yield plain(pd.DataFrame(out).astype({"short": "int64"}))

    kept = rows.select(F.col(item).cast("string").alias("item"), F.col(text).alias("raw")).where(F.col("item").isNotNull() & (F.length("raw") > 0))
    own = staged(spread(kept).mapInPandas(tidy, "item string, short long, key binary, text string"), "texts")
    texts = own.select("short", "key", "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.greatest(F.length("text") - (n - 1), F.lit(0)))).first()[0] or 0
    bits = min(max(BUCKET_BITS[0], math.ceil(math.log2(total / FULL + 1))), BUCKET_BITS[1])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            held += np.bincount(_bucket(_mixed(all_codes(b["text"].drop_duplicates().tolist(), n)), len(held)), minlength=len(held))
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": held[at]})

    table = texts.mapInPandas(counted, "bucket int, n long").groupBy("bucket").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(1 << bits, dtype=np.int32)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    blocks = max(LEAST_BLOCKS, math.ceil((1 - threshold) * total / BLOCK_ENTRIES))
    hot = _hot_tokens(texts, counts, n, threshold) if len(counts) and counts.max() > HOT else (None, None)
    poster = spark.sparkContext.broadcast(Poster(counts, blocks, threshold, *hot))

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, sets, sizes in _batches_of_classes(batches, n):
            made = list(poster.value.rows(keys, sets, sizes))
            if made:
                yield pd.DataFrame(made, columns=["level", "block", "bundle"])

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        return _compare(group, threshold)

    bundles = texts.mapInPandas(posted, "level int, block int, bundle binary")
    near = staged(bundles.groupBy("level", "block").applyInPandas(compared, "a long, b long").distinct(), "candidates")

    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def codes(t: str) -> np.ndarray:
            if t not in known:
                known[t] = shingle_codes(t, n)
            return known[t]

        out = []
        for x, y in zip(left, right, strict=True):
            a, b = codes(x), codes(y)
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(common / (len(a) + len(b) - common))
        return pd.Series(out, dtype="float64")

    asked = near.select(F.explode(F.array("a", "b")).alias("short")).distinct()
    wanted = join_lookup(texts, asked, ["short"], "left_semi", bound=ASKED).repartition("short").groupBy("short", "key").agg(F.first("text").alias("text"))
    left = wanted.select(F.col("short").alias("a"), F.col("key").alias("_a"), F.col("text").alias("_left"))
    right = wanted.select(F.col("short").alias("b"), F.col("key").alias("_b"), F.col("text").alias("_right"))
    hot_rows = HOT_ROWS if near.count() > HOT_ROWS else None
    both = join_lookup(join_lookup(near, left, ["a"], fits=False, hot_rows=hot_rows), right, ["b"], fits=False, hot_rows=hot_rows).where((F.col("a") < F.col("b")) | (F.col("_a") < F.col("_b")))
    alike = both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), jaccard("_left", "_right").alias("similarity"))
    return staged(own.select("item", "key").distinct(), "members"), staged(alike.where(F.col("similarity") >= threshold - 1e-12), "links")


def _hot_tokens(texts: DataFrame, counts: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The sorted tokens of more than HOT postings, at most HOT_TOKENS, and into how many rows and columns each is split."""
    held = texts.sparkSession.sparkContext.broadcast(counts)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = (b[may_post_full(b["text"].tolist(), n, held.value, threshold)] for b in batches)
        for _, sets, sizes in _batches_of_classes(some, n):
            if len(sets):
                token, many = posted_in_full_buckets(held.value, sets, sizes, threshold)
                yield pd.DataFrame({"token": token.view(np.int64), "n": many})

    often = texts.mapInPandas(posted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    often = staged(often, "hot")
    limit, many = HOT, often.count()
    while many > HOT_TOKENS:
        limit *= 2
        many = often.where(F.col("n") > limit).count()
    table = often.where(F.col("n") > limit).toArrow()
    token = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], -(-table["n"].to_numpy()[order] // limit)


def pairs_of_items(members: DataFrame, links: DataFrame) -> DataFrame:
    """Columns item_a, item_b, item_a < item_b: items with linked or equal texts, each pair once.

    A text of many copies is split: a share of ``COPIES`` of them meets its partners in a task of its own.
    """
    many = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("key", F.ceil(F.col("n") / COPIES).alias("shares"))
    many = staged(many, "many")
    few, some = within(many, BROADCAST_ROWS), many.limit(1).count() > 0
    shares = F.coalesce("shares", F.lit(1).cast("long")) if some else F.lit(1)
    share, each = (F.pmod(F.xxhash64("item"), shares), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))) if some else (F.lit(0), F.lit(0).cast("long"))

    def with_shares(rows: DataFrame, key: str) -> DataFrame:
        return join_lookup(rows, many.withColumnRenamed("key", key), [key], "left", fits=few) if some else rows

    def met(pairs: DataFrame, side: str, name: str) -> DataFrame:
        """``pairs`` with the items of the class in column ``side``."""
        own = placed.select(F.col("key").alias(side), "share", F.col("item").alias(name))
        return with_shares(pairs, side).select(*pairs.columns, each.alias("share")).join(own, [side, "share"]).drop("share", side)

    counted = with_shares(members, "key")
    placed = counted.select("key", share.cast("long").alias("share"), "item")
    others = counted.select("key", each.alias("share"), F.col("item").alias("y"))
    copies = placed.withColumnRenamed("item", "x").join(others, ["key", "share"]).where(F.col("x") < F.col("y")).select("x", "y")
    across = met(met(links.select("a", "b"), "a", "x"), "b", "y").select("x", "y")
    both = across.unionByName(copies).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct()
