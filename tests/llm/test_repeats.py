from leafmill.llm import repeats

KIND = "page_id bigint, source_id string, text string, line_no string"


def test_lines_and_blocks(spark):
    rows = [(i, "a.pdf", f"Notice, {i}!\r\nShare THIS page\n\nown words of page {'x' * i}\n123\nEnd note", "q") for i in range(1, 11)]
    rows += [(1, "a.pdf", rows[0][2], "q"), (20, "a.pdf", None, "q"), (21, "a.pdf", " \n\t", "q"), (22, "", "share this page", "q"), (23, None, "share this page", "q"), (None, "a.pdf", "share this page", "q")]
    rows += [(100 + i, "b.pdf", f"only{'y' * i}\nshare this page" if i < 4 else f"only{'y' * i}", "q") for i in range(10)]
    pages = spark.createDataFrame(rows, KIND)
    occ, blocks, gaps = repeats.repeated_lines(pages)
    assert gaps.count() == 0
    assert {(r.page_id, r.line_no) for r in occ.collect()} == {(i, n) for i in range(1, 11) for n in (1, 2, 6)}
    by = {}
    for r in blocks.collect():
        by.setdefault(r.block, []).append(r.pages)
    assert sorted(by.values()) == [[10], [10, 10]]
    clean = {r.page_id: r.text for r in repeats.without_repeats(pages, occ).where("source_id = 'a.pdf'").collect()}
    assert clean[2] == "\nown words of page xx\n123" and clean[20] is None
    assert repeats.without_repeats(pages, occ).count() == pages.count()


def test_share_and_empty(spark):
    pages = spark.createDataFrame([(i, "a", f"page{'x' * i}\nnote" if i < 6 else f"page{'x' * i}", "") for i in range(40)], KIND)
    occ, _, _ = repeats.repeated_lines(pages)
    assert {r.page_id for r in occ.collect()} == set(range(6))
    assert repeats.repeated_lines(pages, min_share=0.16)[0].count() == 0
    assert repeats.repeated_lines(pages.where("false"))[0].count() == 0


def test_a_changed_line_within_a_block_goes_too(spark):
    lines = ["Share this page", "All rights are kept", "Read more notes"]
    rows = [(i, "a", "\n".join([f"own {'x' * i}", *lines]), "") for i in range(12)]
    rows += [(50, "a", "own z\nShare this page\nA11 rigbts ar kcpt\nRead more notes", ""), (51, "a", "Share this page\nown words\n\nown y", ""), (52, "a", "own q\nRead more notes", "")]
    pages = spark.createDataFrame(rows, KIND)
    occ, blocks, gaps = repeats.repeated_lines(pages)
    assert [tuple(r) for r in gaps.collect()] == [(50, 3)] and len({r.block for r in blocks.collect()}) == 1
    clean = {r.page_id: r.text for r in repeats.without_repeats(pages, occ.select("page_id", "line_no").unionByName(gaps)).collect()}
    assert clean[50] == "own z" and clean[51] == "own words\n\nown y" and clean[52] == "own q"


def test_a_large_source_is_spread(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART_PAGES", 50)
    pages = spark.createDataFrame([(i, "hot" if i < 900 else f"s{i % 9}", f"own {'x' * (i % 400)}\nshare this page", "") for i in range(1_000)], KIND)
    occ = repeats.repeated_lines(pages)[0]
    assert occ.where("line_no = 2").count() == 1_000
