"""Text cleaning and exact shingle codes, as Arrow-batched functions.

Unicode form NFKC has no counterpart among Spark's built-ins, so cleaning is
the one step that leaves the JVM; it does so in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: All but letters and digits (classes L and N), which are what ``\w`` matches besides the low line.
_OTHER = re.compile(r"[\W_]+")


def _plain_others() -> re.Pattern:
    """Signs that NFKC turns into no letter or digit and that join with nothing, as ranges."""
    points = [c for c in range(0x10000) if _OTHER.fullmatch(chr(c)) and not 0xD800 <= c < 0xE000 and not unicodedata.category(chr(c)).startswith("M")]
    points = [c for c in points if not unicodedata.combining(chr(c)) and _OTHER.fullmatch(unicodedata.normalize("NFKC", chr(c)))]
    starts = [c for c, before in zip(points, [-2, *points], strict=False) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -2], strict=True) if c != after - 1]
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True)) + "]+")


_PLAIN_OTHER = _plain_others()


def cleaned(text: str | None) -> str:
    """NFKC, lower case, letters and digits only; null becomes the empty string.

    Plain signs go first: what is left mostly is in normal form, which is faster to tell than to make.
    """
    if not text:
        return ""
    bare = _PLAIN_OTHER.sub("", text)
    if not unicodedata.is_normalized("NFKC", bare) or "Σ" in bare:  # whose small form depends on what follows
        bare = unicodedata.normalize("NFKC", text)
    bare = bare.lower()
    return bare if bare.isalnum() else _OTHER.sub("", bare)


def shingle_codes(text: str, n: int) -> np.ndarray:
    """The distinct ``n``-character substrings (n up to 3) as sorted 63-bit numbers, 21 bits a character: no collisions."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(points) < n:
        return points[:0]
    code = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        code = (code << 21) | points[k : len(points) - n + 1 + k]
    code.sort()
    first = np.empty(len(code), dtype=bool)
    first[0] = True
    np.not_equal(code[1:], code[:-1], out=first[1:])
    return code[first]


def all_codes(texts: list[str], n: int) -> np.ndarray:
    """The codes of all ``n``-character substrings of many texts, as often as they occur."""
    joined = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(joined) < n:
        return joined[:0]
    code, inside = joined[: len(joined) - n + 1].copy(), joined[: len(joined) - n + 1] != 0
    for k in range(1, n):
        part = joined[k : len(joined) - n + 1 + k]
        code = (code << 21) | part
        inside &= part != 0
    return code[inside]
