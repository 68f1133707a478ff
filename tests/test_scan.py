import re

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import scan


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .'\n\tsĳéא½_’t", max_size=40), max_size=5))
def test_words_and_pieces_equal_regexes(texts):
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for _, part in scan.slices(texts, 20):
        layout = scan.Layout(part)
        for cut, want in ((scan.words, lambda t: re.findall(r"[^\W_]+", t)), (scan.byte_pair_pieces, pattern.findall)):
            begin, end = cut(layout)
            got = [[] for _ in part]
            for o, a, b in zip(layout.owner(begin), begin, end):
                got[o].append(layout.text[a:b])
            assert got == [want(t) for t in part]


def test_hashes_don_t_depend_on_place():
    layout = scan.Layout(["aa bb aa", "xx aa", "aab ab"])
    begin, end = scan.words(layout)
    h = layout.hashes(begin, end)
    words = [layout.text[a:b] for a, b in zip(begin, end)]
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[2] == h[4]


def test_none_and_empty():
    assert [x for _, p in scan.slices([None, "", "a"]) for x in p] == ["", "", "a"]
    assert list(scan.slices([])) == []
    begin, _ = scan.words(scan.Layout([""]))
    assert len(begin) == 0
