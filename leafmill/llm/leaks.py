"""Passages of held-out items inside a corpus: SimHash windows, multi-index Hamming blocks, exact verification.

Every run of ``window`` words of each item and of each document gets a 64-bit SimHash. The fingerprint is divided into
``radius + 1`` blocks: two fingerprints within Hamming distance ``radius`` agree on at least one whole block, so looking
up each block of each document window finds every window within the radius. Candidates are verified by the weighted
similarity of their shingles of SHINGLE words, and where equal words are asked for, word by word.

Equal windows have equal fingerprints, but one other word of 12 moves about 7 of the 64 bits, so near windows are not
sought by their fingerprints. With at most m other words a window has a run of at least 1/(m + 1) of the equal words:
every run of that length that an item and a document share is a seed, and all windows around it are compared word by
word. No near window is missed.

The items are held by every task and the corpus is never shuffled: a document is scanned once, where it lies, for each
portion of items of at most ``portion_words`` words. The driver holds one portion at a time: its finds are written before
the next is read. Equal windows of a text are looked up once, and an item's equal windows are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import scan
from leafmill.sources.tables import settle

#: Windows are this long, and an exact leak has at least so many words of an item in a row.
WINDOW_WORDS = 12
#: Fingerprints differing in at most so many bits are candidates.
RADIUS = 2
#: Words of a shingle.
SHINGLE = 5
#: Shared seeds whose surroundings are compared at once.
SEEDS_AT_ONCE = 100_000


def fingerprints(word: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each ``window`` words in a row: bit b is set if it is set in at least half of the words' hashes."""
    if len(word) < window:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1)
    total, have = None, 0
    power, size = bits, 1
    left = window
    while left:  # sums of 1, 2, 4 ... rows, put together as the binary digits of the window say
        if left & 1:
            part = power[have:]
            total = part if total is None else total[: len(part)] + part[: len(total)]
            have += size
        left >>= 1
        if left:
            power, size = power[:-size] + power[size:], size * 2
    total = total[: len(word) - window + 1]
    return np.packbits(total >= (window + 1) // 2, axis=1).view(np.uint64).ravel()


def block_masks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the radius + 1 blocks of a 64-bit fingerprint."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def seed_words(window: int, need: int) -> int:
    """Length of the run of equal words that every window with ``need`` equal words of ``window`` has."""
    return -(-need // (window - need + 1))


def seed_hashes(word: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ``size`` words in a row, and whether they are of one text."""
    n = max(0, len(word) - size + 1)
    value = word[:n].copy()
    for k in range(1, size):
        value = scan.mix(value) + word[k : k + n]
    return value, owner[:n] == owner[size - 1 :][:n]


@dataclass
class ItemIndex:
    """What a task needs of the items: their words, and of each different window its first place, its fingerprint and the
    items that hold it (``holder[upto[i] : upto[i + 1]]``)."""

    ids: np.ndarray
    word: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    print: np.ndarray
    window: int
    radius: int
    upto: np.ndarray
    holder: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], window: int, radius: int) -> ItemIndex:
        rows = [r for r in rows if r[0] is not None]
        layout = scan.Layout([(t or "").lower() for _, t in rows])
        begin, end = scan.words(layout)
        word, owner = layout.hashes(begin, end), layout.owner(begin)
        first = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :]) if len(owner) >= window else np.empty(0, dtype=np.int64)
        h = seed_hashes(word, owner, window)[0][first] if len(first) else np.empty(0, dtype=np.uint64)
        _, at, entry = np.unique(h, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((entry.ravel(), owner[first])), axis=1) if len(first) else np.empty((2, 0), dtype=np.int64)
        upto = np.concatenate(([0], np.cumsum(np.bincount(pairs[0], minlength=len(at))))).astype(np.int64)
        one = first[at]
        return cls(np.array([r[0] for r in rows], dtype=np.int64), word, one, owner, fingerprints(word, window)[one] if len(one) else np.empty(0, dtype=np.uint64), window, radius, upto, pairs[1])

    def tables(self) -> list[tuple[int, np.uint64, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: shift, mask, presence table, sorted block values, the windows in that order."""
        out = []
        for shift, bits in block_masks(self.radius):
            mask = np.uint64((1 << bits) - 1)
            value = (self.print >> np.uint64(shift)) & mask
            order = np.argsort(value, kind="stable")
            small = np.uint64((1 << min(bits, 22)) - 1)
            there = np.zeros(1 << min(bits, 22), dtype=bool)
            there[value & small] = True
            out.append((shift, mask, there, value[order], order))
        return out

    def seeds(self, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Length, presence table, sorted hashes and places of all runs of ``size`` words of an item."""
        value, whole = seed_hashes(self.word, self.owner, size)
        at = np.flatnonzero(whole)
        order = at[np.argsort(value[at], kind="stable")]
        there = np.zeros(1 << 22, dtype=bool)
        there[value[at] & np.uint64(len(there) - 1)] = True
        return size, there, value[order], order


def shingle_similarity(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each row of words ``a`` and ``b``: a shingle counts as often as it
    stands there."""
    n = a.shape[1] - size + 1
    x, y = np.zeros((len(a), n), dtype=np.uint64), np.zeros((len(a), n), dtype=np.uint64)
    for k in range(size):
        x, y = scan.mix(x) + a[:, k : k + n], scan.mix(y) + b[:, k : k + n]
    x, y = np.sort(x, axis=1), np.sort(y, axis=1)
    # the i-th of equal shingles of one side meets the i-th of the other
    turn = lambda z: (z[:, :, None] == z[:, None, :])[:, np.tril_indices(n, -1)[0], np.tril_indices(n, -1)[1]]
    again = np.zeros((2, len(a), n), dtype=np.int64)
    for i, z in enumerate((x, y)):
        same = turn(z)
        np.add.at(again[i].T, np.tril_indices(n, -1)[0], same.T)
    common = ((x[:, :, None] == y[:, None, :]) & (again[0][:, :, None] == again[1][:, None, :])).sum(axis=(1, 2))
    return common / (2 * n - common)


def matches(index: ItemIndex, tables: list, texts: list[str], similarity: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, place of the window in the text's words, equal words of the window) of every candidate in the radius whose
    shingles are at least so similar. Equal windows of a text count once, at their first place."""
    none = (np.empty(0, dtype=np.int64),) * 4
    layout = scan.Layout([t.lower() for t in texts])
    begin, end = scan.words(layout)
    if len(begin) < index.window or not len(index.first):
        return none
    word, owner = layout.hashes(begin, end), layout.owner(begin)
    prints = fingerprints(word, index.window)
    whole = owner[: len(prints)] == owner[index.window - 1 :]
    left, right = [], []
    for shift, mask, there, values, order in tables:
        value = (prints >> np.uint64(shift)) & mask
        at = np.flatnonzero(there[value & np.uint64(len(there) - 1)] & whole)
        lo, hi = np.searchsorted(values, value[at], "left"), np.searchsorted(values, value[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        # of equal windows of a text the first
        h, _ = seed_hashes(word, owner, index.window)
        at, lo, n = _once(owner[at], h[at], at, lo, n)
        upto = np.cumsum(n)
        for first in range(0, int(upto[-1]) if len(upto) else 0, SEEDS_AT_ONCE):
            hit = np.arange(first, min(first + SEEDS_AT_ONCE, int(upto[-1])))
            row = np.searchsorted(upto, hit, "right")
            a, b = at[row], order[lo[row] + hit - (upto[row] - n[row])]
            near = np.bitwise_count(prints[a] ^ index.print[b]) <= index.radius
            left.append(a[near]), right.append(b[near])
    if not left:
        return none
    a, b = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
    step = np.arange(index.window)
    x, y = word[a[:, None] + step], index.word[index.first[b][:, None] + step]
    good = shingle_similarity(x, y) >= similarity - 1e-9
    a, b, equal = a[good], b[good], (x[good] == y[good]).sum(axis=1)
    # an entry stands for all items that have the window
    n = index.upto[b + 1] - index.upto[b]
    row = np.repeat(np.arange(len(b)), n)
    item = index.holder[np.repeat(index.upto[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return owner[a[row]], item, a[row], equal[row]


def _once(owner: np.ndarray, h: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns without the rows that repeat (owner, h)."""
    order = np.lexsort((h, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1])
    keep = np.sort(order[new])
    return [c[keep] for c in columns]


def near_matches(index: ItemIndex, seeds: tuple, texts: list[str], need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, place of the window in the text's words, most equal words) of every window of a text that has at least
    ``need`` words equal to those of a window of the item; each window once for an item."""
    none = (np.empty(0, dtype=np.int64),) * 4
    layout = scan.Layout([t.lower() for t in texts])
    begin, end = scan.words(layout)
    if len(begin) < index.window or not len(index.first):
        return none
    word, owner = layout.hashes(begin, end), layout.owner(begin)
    size, there, values, order = seeds
    value, whole = seed_hashes(word, owner, size)
    at = np.flatnonzero(there[value & np.uint64(len(there) - 1)] & whole)
    lo = np.searchsorted(values, value[at], "left")
    n = np.searchsorted(values, value[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    upto = np.cumsum(n)
    reach = index.window - size  # the first window around a seed starts so many words before it
    step = np.arange(-reach, index.window)
    found = []
    for first in range(0, int(upto[-1]) if len(upto) else 0, SEEDS_AT_ONCE):
        hit = np.arange(first, min(first + SEEDS_AT_ONCE, int(upto[-1])))
        row = np.searchsorted(upto, hit, "right")
        i, j = at[row], order[lo[row] + hit - (upto[row] - n[row])]
        x, y = i[:, None] + step, j[:, None] + step
        inside = (x >= 0) & (x < len(word)) & (y >= 0) & (y < len(index.word))
        x, y = np.clip(x, 0, len(word) - 1), np.clip(y, 0, len(index.word) - 1)
        inside &= (owner[x] == owner[i][:, None]) & (index.owner[y] == index.owner[j][:, None])
        equal = inside & (word[x] == index.word[y])
        total = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
        count = total[:, index.window :] - total[:, : reach + 1]
        good = inside[:, : reach + 1] & inside[:, index.window - 1 :] & (count >= need)
        if reach:  # a seed that goes on from the seed a word before has only the window that starts with it left
            good[:, :reach] &= ~equal[:, reach - 1 : reach]
        r, k = np.nonzero(good)
        found.append(_best(i[r] - reach + k, index.owner[j[r]], count[r, k]))
    if not found:
        return none
    place, item, equal = _best(*map(np.concatenate, zip(*found)))
    return owner[place], item, place, equal


def _best(place: np.ndarray, item: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (place, item) once with its highest ``equal``."""
    order = np.lexsort((-equal, item, place))
    place, item, equal = place[order], item[order], equal[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
    return place[new], item[new], equal[new]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW_WORDS, radius: int = RADIUS, similarity: float = 1.0, portion_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, windows, best): documents that hold a window of an item.

    ``windows`` counts the document's windows whose similarity to a window of the item is at least ``similarity``, the
    share of positions with the same word; ``best`` is the highest of them. With 1.0 the document has ``window``
    consecutive words of the item, found by fingerprints within ``radius`` and verified by shingles and then words (equal
    windows of a document count once); with less, windows are found by their seeds,
    all of them, and the radius does not matter. Words are maximal runs of letters and digits in lower case.

    Null or empty texts and texts shorter than the window match nothing; a null id is left out; a repeated document or
    item row gives no second row; other columns are ignored. Items are read to the driver in portions, each small
    enough to hold, so the number of scans grows with the items and no task ever holds them all.
    """
    spark = docs.sparkSession

    def portions() -> Iterator[list[tuple[int, str | None]]]:
        held, size = [], 0
        for r in items.select(item_id, text).distinct().toLocalIterator():
            if held and size >= portion_words:
                yield held
                held, size = [], 0
            held.append((r[0], r[1]))
            size += len(r[1] or "") // 3
        yield held

    need = int(np.ceil(similarity * window - 1e-9))
    if not 0 < need <= window:
        raise ValueError("similarity must be above 0 and at most 1")
    id_type = docs.schema[doc_id].dataType.simpleString()
    out, last = None, None
    for rows in portions():
        if last is not None:  # the finds of the portion before are written, and its items let go
            written, broadcast = settle(last[0]), last[1]
            broadcast.unpersist()
            out = written if out is None else out.unionByName(written)
        index = spark.sparkContext.broadcast(ItemIndex.of(rows, window, radius))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            tables = known.tables() if need == window else known.seeds(seed_words(window, need))
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for first, part in scan.slices(texts):
                    if need == window:
                        doc, item, _, equal = matches(known, tables, part, similarity)
                        good = equal >= need
                        doc, item, equal = doc[good], item[good], equal[good]
                    else:
                        doc, item, _, equal = near_matches(known, tables, part, need)
                    pair, at, n = np.unique(np.stack((doc, item)), axis=1, return_inverse=True, return_counts=True)
                    best = np.zeros(pair.shape[1], dtype=np.int64)
                    np.maximum.at(best, at.ravel(), equal)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(pair[0] + first)), pa.array(known.ids[pair[1]]), pa.array(n.astype(np.int64)), pa.array(best / known.window)], ["doc_id", "item_id", "windows", "best"])

        found = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text).mapInArrow(find, f"doc_id {id_type}, item_id bigint, windows bigint, best double")
        last = (found, index)
    out = last[0] if out is None else out.unionByName(last[0])
    return out.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("best").alias("best"))
