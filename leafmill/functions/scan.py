"""Array-wise scanning of texts: words, pieces of byte-pair tokenizers and 64-bit hashes without a loop over characters.

A batch of texts is laid out as one array of code points. Character classes come from a lookup table, runs from the
places where the class changes, and hashes of runs from prefix sums modulo 2**64, so the cost is a few array passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SLICE_CHARS = 600_000
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@cache
def classes() -> np.ndarray:
    """OTHER, LETTER (Unicode L), NUMBER (Unicode N) or SPACE of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if (c := chr(i)).isspace() else kind.get(unicodedata.category(c)[0], OTHER) for i in range(0x110000)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@cache
def _code_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def slices(texts: Iterable[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in portions of about ``limit`` characters; None counts as the empty text."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Layout:
    """Texts side by side with one separator after each; ``start`` has the place of each text in ``codes``."""

    def __init__(self, texts: list[str], separator: str = "\n"):
        joined = separator.join([*texts, ""])
        self.text = joined
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.start = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.kind = classes()[self.codes]

    def owner(self, place: np.ndarray) -> np.ndarray:
        """Index of the text that holds each place."""
        return np.searchsorted(self.start, place, side="right") - 1

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of codes[begin:end] of each run; equal runs have equal hashes wherever they stand."""
        n = len(self.codes)
        size = 1 << max(20, int(n).bit_length())
        up, down = _powers(size)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_code_values()[self.codes] * up[:n], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def words(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of letters and digits."""
    return runs((layout.kind == LETTER) | (layout.kind == NUMBER))


def byte_pair_pieces(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces into which the pattern of the public byte-pair tokenizers cuts each text.

    The pattern: the contractions 's 't 're 've 'm 'll 'd; else an optional blank with a run of letters, of numbers or
    of other signs; else white space, of which the last character before a word starts a piece of its own (a blank
    joins the word). Texts are cut apart as if each stood alone.
    """
    kind, codes, n = layout.kind, layout.codes, len(layout.codes)
    ends = layout.start[1:] - 1  # the separators
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[0] = cut[n] = True
    is_end = np.zeros(n + 1, dtype=bool)
    is_end[ends] = True
    cut[ends] = cut[ends + 1] = True
    space = kind == SPACE
    # the last white space before a word: its own piece, or, if a blank, the start of the word's piece
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~is_end[: n - 1])
    cut[last] = True
    cut[last[codes[last] == 32] + 1] = False
    # contractions: an apostrophe that stands alone and starts a piece
    lone = np.flatnonzero((codes[:-1] == 39) & cut[: n - 1] & (kind[1:] == LETTER) & cut[1:n])
    if len(lone):
        padded = np.concatenate((codes, np.zeros(3, dtype=codes.dtype)))
        a, b = padded[lone + 1], padded[lone + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for at, size in ((lone[one], 1), (lone[two & ~one], 2)):
            cut[at + 1] = False
            cut[at + 1 + size] = True
    place = np.flatnonzero(cut)
    begin, end = place[:-1], place[1:]
    keep = ~is_end[begin]
    return begin[keep], end[keep]
