"""Oversized texts cut into pieces under a limit, at natural boundaries and with an overlap.

Of each text the places where it may be cut are one sorted array with a rank for each: after a paragraph, a line, a
sentence or a word. Sizes are differences of prefix sums over the characters (or over the tokens of a tokenizer whose
offsets are given), so a piece's last boundary under the limit is a binary search, and so is the step back by the
overlap. Where a run has no boundary the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that does not count at either end of an item.
EDGE = " \t\r\n"
WORD, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4
#: A boundary of a better rank is taken if it leaves the piece at least this share of the limit.
LEAST_SHARE = 0.5
#: A cut inside a run of more non-white-space characters than this could not be avoided.
LONGEST_RUN = 500
_GAP = re.compile(r"\s+")
_SENTENCE_END = ".!?…。؟׃"
_CLOSING = "\"'”’»)]"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks), sorted: where a new piece may start, which is after white space, and of what rank that is."""
    places, ranks = [], []
    for m in _GAP.finditer(text):
        a, b = m.span()
        if a == 0 or b == len(text):
            continue
        gap = m.group()
        lines = gap.count("\n") or gap.count("\r")
        if lines > 1:
            rank = PARAGRAPH
        elif lines:
            rank = LINE
        else:
            i = a - 1
            while i > 0 and text[i] in _CLOSING:
                i -= 1
            rank = SENTENCE if text[i] in _SENTENCE_END else WORD
        places.append(b)
        ranks.append(rank)
    return np.array(places, dtype=np.int64), np.array(ranks, dtype=np.int8)


def pieces(text: str, limit: int, overlap: int, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``, in characters.

    ``sizes``: prefix sums of the size up to each character (one more than characters), by default the characters
    themselves. White space at a piece's ends is left out and does not count. A text within the limit is one piece, a blank one none. Each
    piece starts at the boundary nearest to ``overlap`` before the last one's end, or there if there is none.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap from 0 to below the limit")
    size = np.arange(len(text) + 1) if sizes is None else sizes
    start, stop = len(text) - len(text.lstrip(EDGE)), len(text.rstrip(EDGE))
    if start >= stop:
        return []
    if size[stop] - size[start] <= limit:
        return [(start, stop)]
    place, rank = boundaries(text)
    by_rank = [place[rank >= r] for r in (PARAGRAPH, LINE, SENTENCE, WORD)]
    out = []
    while True:
        if size[stop] - size[start] <= limit:
            out.append((start, stop))
            return out
        most = int(np.searchsorted(size, size[start] + limit, "right")) - 1  # the last place within the limit
        least = int(np.searchsorted(size, size[start] + limit * LEAST_SHARE, "left"))
        reach = most
        while reach < stop and text[reach].isspace():  # white space after the piece isn't part of it
            reach += 1
        cut = None
        for choice in by_rank:
            i = int(np.searchsorted(choice, reach, "right")) - 1
            if i >= 0 and choice[i] > (start if choice is by_rank[-1] else least):
                cut = int(choice[i])
                break
        hard = cut is None
        cut = most if hard else cut
        end = start + len(text[start:cut].rstrip(EDGE))
        if hard and end == start:
            end = cut = max(most, start + 1)
        out.append((start, end))
        # the next piece: back by the overlap, to a boundary
        back = int(np.searchsorted(size, size[end] - overlap, "left"))
        i = int(np.searchsorted(place, back, "left"))
        follow = int(place[i]) if i < len(place) and place[i] <= cut else (cut if not hard else max(back, start + 1))
        if follow <= start:
            follow = cut
        start = follow + len(text[follow:stop]) - len(text[follow:stop].lstrip(EDGE))


def inside_word(text: str, place: int, longest_run: int = LONGEST_RUN) -> bool:
    """Whether a cut at ``place`` stands between two letters or digits, in a run of at most ``longest_run`` characters."""
    if not (0 < place < len(text) and text[place - 1].isalnum() and text[place].isalnum()):
        return False
    lo, hi = place, place
    while lo > 0 and not text[lo - 1].isspace() and hi - lo <= longest_run:
        lo -= 1
    while hi < len(text) and not text[hi].isspace() and hi - lo <= longest_run:
        hi += 1
    return hi - lo <= longest_run


def _trimmed(column: str):
    return F.length(F.trim(F.col(column), F.lit(EDGE)))


def token_sizes(counter, text: str) -> np.ndarray:
    """Prefix sums of the tokens of ``text`` up to each character. Inside a byte-pair piece a beginning counts its bytes, as
    far as these are fewer than the piece's tokens: it never has more."""
    begin, end, count = counter.pieces(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    upto = np.concatenate(([0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))))
    piece = np.searchsorted(begin, np.arange(len(text)), "right") - 1
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    inside = np.minimum(upto[1:] - upto[begin[piece]], count[piece])
    return np.concatenate(([0], np.where(np.arange(1, len(text) + 1) >= end[piece], before[piece] + count[piece], before[piece] + inside)))


def token_pieces(counter, text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of pieces of at most ``limit`` tokens. A piece that has more on its own, as its first word stands
    without the blank before it, is cut again under a smaller limit; one long run without boundaries is cut in halves."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(text), limit)]
    while todo:
        first, last, most = todo.pop()
        part = text[first:last]
        again = []
        for a, b in pieces(part, most, min(overlap, most - 1), token_sizes(counter, part)):
            n = int(counter.counts([part[a:b]])[0])
            if n <= limit or b - a == 1:
                out.append((first + a, first + b, n))
            elif n - limit < most and (a, b) != (0, len(part)):
                again.append((first + a, first + b, most - (n - limit)))
            else:
                again += [(first + a, first + (a + b) // 2, most), (first + (a + b) // 2, first + b, most)]
        todo += again
    return sorted(out)


def split_by_tokens(df: DataFrame, key: list[str], text: str, limit: int, overlap: int, tokenizer: str) -> DataFrame:
    """``key`` columns and (piece_no, pieces, start_char, end_char, tokens): pieces of at most ``limit`` tokens of a public
    tokenizer (the path of its vocabulary file, which every worker must have). A single character of more tokens than the
    limit is a piece of its own. Null and blank texts have none; repeated rows give repeated pieces."""
    own = df.select(*key, F.col(text).alias("_text")).where(F.trim(F.col("_text"), F.lit(EDGE)) != "")
    n_key = len(key)
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.llm.packing import TokenCounter

        counter = TokenCounter(tokenizer)
        for batch in batches:
            rows = [(i, k, len(spans), a, b, n) for i, t in enumerate(batch.column(n_key).to_pylist()) for spans in [token_pieces(counter, t, limit, overlap)] for k, (a, b, n) in enumerate(spans, 1)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n_key)), *(pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64())))], [*key, "piece_no", "pieces", "start_char", "end_char", "tokens"])

    return own.mapInArrow(cut, f"{kinds}, piece_no int, pieces int, start_char bigint, end_char bigint, tokens bigint")


def split_oversized(df: DataFrame, key: list[str], text: str, limit: int, overlap: int, offset: str | None = None) -> DataFrame:
    """``key`` columns and (piece_no, pieces, start_char, end_char, piece): the pieces of every row's text.

    ``offset`` names a column with the place of the text itself, which is added to the piece's place (null counts as
    0). Texts within the limit are one piece and never reach Python; null and blank texts have none. Repeated rows
    give repeated pieces. Other columns are left out.
    """
    base = F.coalesce(F.col(offset).cast("bigint"), F.lit(0).cast("bigint")) if offset else F.lit(0).cast("bigint")
    own = df.select(*key, F.col(text).alias("_text"), base.alias("_base")).where(F.trim(F.col("_text"), F.lit(EDGE)) != "")
    small, large = own.where(_trimmed("_text") <= limit), own.where(_trimmed("_text") > limit)
    lead = F.length("_text") - F.length(F.ltrim(F.col("_text"), F.lit(EDGE))) + F.col("_base")
    whole = F.trim(F.col("_text"), F.lit(EDGE))
    one = small.select(*key, F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), lead.cast("bigint").alias("start_char"), (lead + F.length(whole)).cast("bigint").alias("end_char"), whole.alias("piece"))
    n_key = len(key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, of, begin, end, part = [], [], [], [], [], []
            for i, (t, b) in enumerate(zip(batch.column(n_key).to_pylist(), batch.column(n_key + 1).to_pylist())):
                spans = pieces(t, limit, overlap)
                for k, (x, y) in enumerate(spans, 1):
                    row.append(i), no.append(k), of.append(len(spans)), begin.append(b + x), end.append(b + y), part.append(t[x:y])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n_key)), pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(part, pa.string())], [*key, "piece_no", "pieces", "start_char", "end_char", "piece"])

    return one.unionByName(large.mapInArrow(cut, one.schema))


def cut_in_words(chunks: DataFrame, pages: DataFrame, longest_run: int = LONGEST_RUN) -> DataFrame:
    """(chunk_id, place, start_char, end_char): chunks that start or end inside a word of their page, and where they stand.

    A chunk stands at its offsets if they fit the text of a page of its (source_id, page_number), else where its text is
    first found there. Chunks with a null, empty or nowhere found text have no row, nor do those of unknown pages.
    """
    keys = ["source_id", "page_number"]
    chunk = chunks.where((F.col("text") != "") & F.col("chunk_id").isNotNull()).groupBy("chunk_id", *keys, "text", "start_char", "end_char").agg(F.lit(1))
    place = F.when(F.substring("page", F.col("start_char") + 1, F.length("text")) == F.col("text"), F.when(F.col("start_char") >= 0, F.col("start_char"))).otherwise(None)
    found = F.coalesce(place, F.instr("page", F.col("text")) - 1)
    page = pages.where(F.col("text") != "").select(*keys, F.col("text").alias("page")).distinct()
    held = chunk.select("chunk_id", *keys, "text", "start_char").join(page, keys).withColumn("at", found).where("at >= 0").withColumn("to", F.col("at") + F.length("text"))
    # only the surroundings of the two ends are looked at
    reach = longest_run + 1
    around = lambda p: F.struct(F.substring("page", F.greatest(F.lit(1), p - reach + 1), F.least(p, F.lit(reach))).alias("before"), F.substring("page", p + 1, F.lit(reach)).alias("after"))
    ends = F.array(F.struct(F.lit("start").alias("place"), around(F.col("at")).alias("x")), F.struct(F.lit("end").alias("place"), around(F.col("to")).alias("x")))
    seen = held.select("chunk_id", "at", "to", F.explode(ends).alias("e")).select("chunk_id", "at", "to", "e.place", "e.x.before", "e.x.after")
    both = F.col("before").rlike(r"[\p{L}\p{N}]\z") & F.col("after").rlike(r"^[\p{L}\p{N}]")
    run = F.length(F.regexp_extract("before", r"\S*\z", 0)) + F.length(F.regexp_extract("after", r"^\S*", 0))
    return seen.where(both).where(run <= longest_run).select("chunk_id", "place", F.col("at").cast("bigint").alias("start_char"), F.col("to").cast("bigint").alias("end_char")).distinct()
