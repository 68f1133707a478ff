from pyspark.sql import functions as F

from leafmill.operators import assemble, planner


def test_groups():
    load = lambda words: [max(1.0, w / 160) if w else 0.0 for w in words]
    no = lambda n: [False] * n
    assert planner.groups(load([1200, 50, 50, 50, 50]), no(5), 2) == [[0], [1, 2, 3, 4]]
    assert planner.groups(load([1000, 1000, 2]), no(3), 3) == [[0], [1, 2]]
    assert planner.groups([], [], 3) == [] and planner.groups([5.0], [True], 4) == [[0]]
    assert planner.groups([5.0, 5.0, 5.0, 5.0], [True, False, True, False], 2) == [[0, 1], [2, 3]]
    assert planner.groups([5.0] * 4, no(4), 1) == [[0, 1, 2, 3]]


def test_estimates_and_sessions(spark):
    row = spark.range(1).select(
        planner.estimate(F.lit(4), F.lit(0), F.lit(0), F.lit("Easy")).alias("e"), *[planner.suggested_sessions(F.lit(m), F.lit(p)).alias(f"s{i}") for i, (m, p) in enumerate([(45.0, 20), (90.0, 20), (150.0, 20), (9999.0, 20), (9999.0, 4), (0.0, 0)])]
    ).first()
    assert tuple(row) == (8, 2, 3, 5, 15, 4, 1)


def test_plan_covers_every_readable_page(spark):
    pages = spark.createDataFrame([("d", i, i, "word " * (50 * i)) for i in range(1, 12)] + [("d", 12, 12, ""), ("d", 13, 13, None), ("e", 1, 20, "Chapter 1 begins")], "scope string, page_number int, page_id bigint, text string")
    plan = planner.plan(pages, pages_per_section=4)
    assert planner.coverage_faults(plan, pages).count() == 0
    assert plan.where("scope = 'd'").count() == 3
    bad = spark.createDataFrame([("d", 1, 1, 5), ("d", 2, 5, 6)], "scope string, section_number int, start_page int, end_page int")
    assert {r.fault for r in planner.coverage_faults(bad, pages.where("scope = 'd'")).collect()} == {"overlap", "uncovered"}


def test_concepts_and_summary(spark):
    df = spark.createDataFrame([(1, "Graph-search uses queues. Queues queues matter. GRAPHS also matter here because."), (2, None), (3, "")], "id int, t string")
    got = [(r.id, r.concept, r.n) for r in planner.key_concepts(df, "id", "t", 2).orderBy("id", "rank").collect()]
    assert got == [(1, "Queues", 3), (1, "Matter", 2)]
    text = "Short one. This sentence has quite enough words in it. The chunk metadata of this file is not wanted here. Another sentence with more than six words follows."
    got = spark.createDataFrame([(text,), (None,)], "t string").select(planner.summary("t").alias("s")).collect()
    assert got[0].s == "This sentence has quite enough words in it. Another sentence with more than six words follows." and got[1].s == ""


def test_budget(spark):
    rows = [(1, 1, "aaaa bbbb"), (1, 2, None), (1, 3, ""), (1, 4, "cccc dddd eeee"), (1, 5, "ffff"), (2, 1, "x" * 50)]
    got = {r.g: r.context for r in assemble.budgeted(spark.createDataFrame(rows, "g int, o int, b string"), "g", ["o"], "b", 22).collect()}
    assert got == {1: "aaaa bbbb\n\ncccc dddd", 2: "x" * 22}


def test_ranges_and_chapters(spark):
    pages = spark.createDataFrame([("d", 1, 1, "Chapter 1: Trees"), ("d", 2, 2, "plain"), ("d", 3, 3, "chapter two\n"), ("d", 4, 4, "  "), ("d", 5, 5, "Chapter 2 again")], "scope string, page_number int, page_id int, text string")
    got = [tuple(r) for r in assemble.chapter_headings(pages).orderBy("chapter_number").collect()]
    assert got == [("d", 1, "Chapter 1: Trees", 1, 2), ("d", 2, "Chapter 2", 3, 5)]
    spans = spark.createDataFrame([(7, "d", 2, 4), (8, "d", 4, 4), (9, "z", 1, 2)], "k int, scope string, start_page int, end_page int")
    assert [tuple(r) for r in assemble.texts_in_range(spans, pages, "k").collect()] == [(7, "plain\n\nchapter two")]
    s = spark.createDataFrame([("d", 1, "A", 1, 2), ("d", 2, "B", 2, 3)], "scope string, section_number int, title string, start_page int, end_page int")
    assert [r.section_number for r in assemble.page_sections(pages, s).orderBy("page_number").collect()] == [1, 1, 2, 0, 0]


def test_first_words(spark):
    df = spark.createDataFrame([("aa bb  cc dddd",), (None,)], "t string")
    assert [r[0] for r in df.select(assemble.first_words(F.col("t"), 8)).collect()] == ["aa bb cc", ""]
