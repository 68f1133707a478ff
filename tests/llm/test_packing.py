import random

import numpy as np
import pytest

from leafmill.llm import packing


def _rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, size string")


def _budgets(spark, *caps):
    return spark.createDataFrame([(f"b{c}", c) for c in caps], "budget_name string, capacity_tokens int")


def test_token_counts_equal_the_tokenizer(spark):
    texts = ["It's a test, isn't it?  Two  blanks\n\nnew", "", None, "çé ñ א 123 ½ don't\t", " '", "<|endoftext|>", "x" * 3000]
    enc = packing.encoding(packing.TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(_rows(spark, texts)).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_every_text_is_placed_once_and_nothing_overflows(spark):
    rng = random.Random(3)
    texts = ["word " * rng.choice([1, 2, 5, 20, 60, 63, 64, 130, 700]) for _ in range(400)] + ["", None]
    docs = _rows(spark, texts)
    docs = docs.unionByName(docs.limit(5))  # repeated rows
    packed = packing.pack(docs, _budgets(spark, 64, 256))
    rows = packed.collect()
    enc = packing.encoding(packing.TOKENIZER)
    for cap in (64, 256):
        own = [r for r in rows if r.budget_name == f"b{cap}"]
        boxes, pieces = {}, {}
        for r in own:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
        assert max(boxes.values()) <= cap
        assert set(pieces) == {i for i, t in enumerate(texts) if t}
        for i, p in pieces.items():
            n = len(enc.encode_ordinary(texts[i]))
            assert len(p) == -(-n // cap) and sum(x[2] for x in p) == n
            assert [x[1] for x in sorted(p)] == [k * cap for k in range(len(p))]
        assert sum(boxes.values()) / (cap * len(boxes)) > 0.9


def test_same_length_and_empty(spark):
    assert packing.pack(_rows(spark, ["", None]), _budgets(spark, 10)).count() == 0
    assert packing.pack(_rows(spark, ["a"]), _budgets(spark)).count() == 0
    assert packing.pack(_rows(spark, ["a"] * 7), _budgets(spark, 3)).select("container_id").distinct().count() == 3
    with pytest.raises(ValueError):
        packing.pack(_rows(spark, ["a"]), _budgets(spark, 0))


def test_bounds_have_least_padding():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        counts = rng.integers(1, 20, len(lengths))
        got = packing.bucket_bounds(lengths, counts, 3)
        pad = lambda ends: sum(c * (min(e for e in ends if e >= v) - v) for v, c in zip(lengths, counts))
        from itertools import combinations

        best = min(pad([*ends, lengths[-1]]) for k in (0, 1, 2) for ends in combinations(lengths[:-1], k))
        assert len(got) <= 3 and pad(got) == best
