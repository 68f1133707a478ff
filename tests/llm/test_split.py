import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import split


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\té", max_size=300), st.integers(2, 40), st.integers(0, 30))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    spans = split.pieces(text, limit, overlap)
    seen = [False] * len(text)
    for a, b in spans:
        assert 0 < b - a <= limit and text[a:b] == text[a:b].strip(split.EDGE)
        seen[a:b] = [True] * (b - a)
    assert all(s or c in split.EDGE for s, c in zip(seen, text))
    assert [a for a, _ in spans] == sorted({a for a, _ in spans})


def test_cuts_prefer_better_boundaries():
    text = "one two three. four five\nsix seven\n\neight nine ten eleven twelve"
    assert [text[a:b] for a, b in split.pieces(text, 38, 0)] == ["one two three. four five\nsix seven", "eight nine ten eleven twelve"]
    text = "word " * 20
    assert [text[a:b] for a, b in split.pieces(text, 12, 0)] == ["word word"] * 10
    assert [b - a for a, b in split.pieces("x" * 25, 10, 3)] == [10, 10, 10, 4]


def test_sizes_other_than_characters():
    text = "a bb ccc dddd"
    tokens = [0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 4]
    import numpy as np

    assert [text[a:b] for a, b in split.pieces(text, 2, 0, np.array(tokens))] == ["a bb", "ccc dddd"]


def test_bad_sizes():
    for limit, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split.pieces("text", limit, overlap)


def test_split_oversized_rows(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(5_000))
    rows = [(1, "short", 5, "x"), (2, None, None, "x"), (3, "", 0, "x"), (4, " \n\t ", 0, "x"), (5, "  aa bb cc dd  ", 7, "x"), (5, "  aa bb cc dd  ", 7, "x"), (6, long, None, "x")]
    df = spark.createDataFrame(rows, "id int, text string, at int, piece string")
    out = split.split_oversized(df, ["id"], "text", 6, 0, offset="at").collect()
    assert {r.id for r in out} == {1, 5, 6}
    five = sorted((r.start_char, r.end_char, r.piece) for r in out if r.id == 5)
    assert five == [(9, 14, "aa bb")] * 2 + [(15, 20, "cc dd")] * 2
    assert all(long[r.start_char : r.end_char] == r.piece for r in out if r.id == 6)
    assert split.split_oversized(df.where("false"), ["id"], "text", 6, 0).count() == 0


def test_cut_in_words(spark):
    pages = spark.createDataFrame([("a", 1, "hello brave world"), ("a", 2, "x" * 600), ("b", 1, None)], "source_id string, page_number int, text string")
    chunks = spark.createDataFrame([("c1", "a", 1, "lo brave", 3, 11), ("c2", "a", 1, "brave", None, None), ("c3", "a", 1, "bra", 99, 102), ("c4", "a", 2, "xx", 5, 7), ("c5", "z", 1, "x", 0, 1), ("c6", "a", 1, "", 0, 0), ("c7", "a", 1, None, 0, 0), ("c8", "b", 1, "x", 0, 1)], "chunk_id string, source_id string, page_number int, text string, start_char int, end_char int")
    got = {(r.chunk_id, r.place) for r in split.cut_in_words(chunks, pages).collect()}
    assert got == {("c1", "start"), ("c3", "end")}
    assert split.inside_word("x" * 600, 5) is False and split.inside_word("abc", 1) is True


def test_pieces_by_tokens(spark):
    from leafmill.llm import packing

    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no tokenizer")
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "x" * 3_000, "é€漢字 " * 300, " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 12))) + rng.choice(["", ".", "\n", "\n\n"]) for _ in range(2_000))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, tokens string")
    rows = split.split_by_tokens(df, ["id"], "text", 20, 5, packing.TOKENIZER).collect()
    counter = packing.TokenCounter(packing.TOKENIZER)
    assert {r.id for r in rows} == {3, 4, 5, 6} and all(r.tokens <= 20 and r.tokens == counter.counts([texts[r.id][r.start_char : r.end_char]])[0] for r in rows)
    for i in (3, 4, 5, 6):
        spans = sorted((r.start_char, r.end_char) for r in rows if r.id == i)
        assert not texts[i][: spans[0][0]].strip() and not texts[i][spans[-1][1] :].strip() and all(not texts[i][b:c].strip() for (_, b), (c, _) in zip(spans, spans[1:]) if c > b)
    # whole words where the text allows it
    assert all(texts[6][r.start_char - 1 : r.start_char].strip() == "" for r in rows if r.id == 6)
