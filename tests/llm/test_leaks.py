import re

import numpy as np

from leafmill.llm import leaks

ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_cases(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ITEM + " and more words than that"), (1, ITEM), (5, "Éin ÄUSSERES, wörd: mit zwölf teilen die hier stehen und noch mehr sagen")], "item_id bigint, text string")
    body = [
        (1, "start " + ITEM.upper().replace(" ", " - ") + " end"),
        (2, "one two three four five six seven eight nine ten eleven only"),
        (3, None),
        (4, ""),
        (5, "x " * 300_000 + ITEM),
        (1, "start " + ITEM.upper().replace(" ", " - ") + " end"),
        (6, ITEM.replace("seven", "SEVEN.\n\n")),
        (7, "éin äusseres_wörd mit zwölf teilen die hier stehen und noch mehr sagen"),
        (8, "two three four five six seven eight nine ten eleven twelve thirteen"),
        (9, "two three four five six XXX eight nine ten eleven twelve thirteen"),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in body], "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()}
    assert got == {(d, i) for d in (1, 5, 6, 8) for i in (1, 4)} | {(7, 5)}
    near = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, similarity=11 / 12, radius=8).collect()}
    assert got < near and (9, 1) in near
    many = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, portion_words=20).collect()}
    assert many == got
    assert leaks.leaks(docs.where("false"), items).count() == 0 and leaks.leaks(docs, items.where("false")).count() == 0


def test_fingerprints_by_definition():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 40).astype(np.uint64)
    for window in (1, 2, 3, 7, 12, 16):
        got = leaks.fingerprints(word, window)
        bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        for i in range(len(word) - window + 1):
            want = np.packbits((bits[i : i + window].sum(axis=0) >= (window + 1) // 2).astype(np.uint8)).view(np.uint64)[0]
            assert got[i] == want
    assert len(leaks.fingerprints(word[:3], 12)) == 0


def test_blocks_find_everything_in_the_radius():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3_000)]
    item = " ".join(rng.choice(words, 400))
    index = leaks.ItemIndex.of([(1, item)], 12, 2)
    tables = index.tables()
    text = " ".join(re.findall(r"\w+", item)[100:160]) + " " + " ".join(rng.choice(words, 500))
    _, _, at, equal = leaks.matches(index, tables, [text])
    from leafmill.functions import scan

    layout = scan.Layout([text])
    b, e = scan.words(layout)
    prints = leaks.fingerprints(layout.hashes(b, e), 12)
    want = {(i, j) for i in range(len(prints)) for j in range(len(index.print)) if bin(int(prints[i] ^ index.print[j])).count("1") <= 2}
    assert len(at) == len(want) and (equal == 12).sum() >= 49


def test_near_query_finds_two_other_words_anywhere(spark, tmp_path):
    from itertools import combinations

    from leafmill.llm.queries import p7_near

    words = ITEM.split()
    places = [p for n in (1, 2, 3) for p in combinations(range(12), n)]
    docs = [(i, "start " + " ".join("xyz" if k in p else w for k, w in enumerate(words[:12])) + " end") for i, p in enumerate(places)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words[:12]))], "item_id bigint, text string").write.parquet(str(tmp_path / "heldout_items.parquet"))
    got = {(r.doc_id, r.windows, round(r.best * 12)) for r in p7_near(spark, str(tmp_path)).collect()}
    assert got == {(i, 1, 12 - len(p)) for i, p in enumerate(places) if len(p) <= 2}


def test_near_windows_equal_brute_force():
    from leafmill.functions import scan

    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(["a", "b", "c"], n))) for i, n in enumerate((5, 12, 40, 30))]
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], n, p=[0.35, 0.3, 0.3, 0.05])) for n in (3, 300, 12, 0, 200)]
    index = leaks.ItemIndex.of(items, 12, 2)
    layout = scan.Layout(texts)
    word = layout.hashes(*scan.words(layout))
    owner = layout.owner(scan.words(layout)[0])
    for need in (12, 11, 10, 8, 5):
        want = {}
        for a in range(len(word) - 11):
            for b in index.first:
                n = int((word[a : a + 12] == index.word[b : b + 12]).sum())
                if owner[a] == owner[a + 11] and n >= need:
                    key = (int(owner[a]), int(index.owner[b]), a)
                    want[key] = max(n, want.get(key, 0))
        for at_once in (7, leaks.SEEDS_AT_ONCE):
            before, leaks.SEEDS_AT_ONCE = leaks.SEEDS_AT_ONCE, at_once
            got = leaks.near_matches(index, index.seeds(leaks.seed_words(12, need)), texts, need)
            leaks.SEEDS_AT_ONCE = before
            assert {k[:3]: k[3] for k in zip(*(x.tolist() for x in got))} == want and len(got[0]) == len(want)


def test_shingle_similarity_by_definition():
    from collections import Counter

    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 3, (60, 12)).astype(np.uint64), rng.integers(1, 3, (60, 12)).astype(np.uint64)
    b[:10] = a[:10]
    for size in (1, 2, 5):
        got = leaks.shingle_similarity(a, b, size)
        for x, y, g in zip(a.tolist(), b.tolist(), got):
            p, q = (Counter(tuple(z[i : i + size]) for i in range(13 - size)) for z in (x, y))
            assert abs(g - sum((p & q).values()) / sum((p | q).values())) < 1e-12


def test_equal_windows_are_one_entry(spark):
    hot = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(i, hot) for i in range(300)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " . ".join([hot] * 2_000)), (2, "other")], "doc_id bigint, text string")
    got = leaks.leaks(docs, items).collect()
    assert len(got) == 300 and {r.doc_id for r in got} == {1} and all(r.best == 1.0 for r in got)
