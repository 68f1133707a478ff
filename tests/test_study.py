from pyspark.sql import functions as F

from leafmill.operators import assemble, planner, quiz, retrieval, study

SECTION = "session_id int, section_number int, title string, start_page int, end_page int, estimated_minutes int, difficulty string, summary string, key_concepts array<string>, learning_objectives array<string>, section_text string, id int"


def _sections(spark, rows=None):
    rows = rows if rows is not None else [(1, 1, "Trees", 1, 2, 10, "Easy", "About trees.", ["root", "leaf"], ["See a tree."], "Text one.", 11), (1, 2, "Graphs", 3, 3, None, None, None, None, None, None, 12), (1, 3, None, 4, 6, 5, "Hard", "", [], [], "", 13)]
    return spark.createDataFrame(rows, SECTION)


def test_states(spark):
    raw = ['{"completed_sections": [3, 1, 3], "actual_study_seconds": -5, "final_exam_score": 71.5, "section_quiz_scores": {"2": 50}}', "", None, "no json", "{}", "[1]"]
    rows = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").orderBy("i").select(study.progress_state("t").alias("s")).collect()]
    assert rows[0].completed_sections == [1, 3] and rows[0].actual_study_seconds == 0 and rows[0].final_exam_score == 71.5 and rows[0].section_quiz_scores == {"2": 50.0}
    assert all(r.completed_sections == [] and r.timer_running is False and r.final_exam_score is None for r in rows[1:])
    again = spark.range(1).select(study.dumped_state(study.progress_state(F.lit(raw[0]))).alias("j")).select(study.progress_state("j").alias("s")).first().s
    assert again == rows[0]


def test_section_states_and_merged_sessions(spark):
    saved = spark.createDataFrame([(1, 1, "text", 80.0, ["ok"], "why", None)], "session_id int, section_number int, explanation string, quiz_score double, feedback array<string>, question string, answer string")
    s = _sections(spark)
    got = {r.section_number: tuple(r)[2:] for r in study.section_states(s.unionByName(s), saved).collect()}
    assert got == {1: ("text", 80.0, ["ok"], "why", ""), 2: ("", None, [], "", ""), 3: ("", None, [], "", "")}
    assert {r.section_number: tuple(r)[2:] for r in study.section_states(s, saved, reset=True).collect()}[1] == ("", 80.0, ["ok"], "", "")
    sessions = spark.createDataFrame([(1, 7, '{"completed_sections": [2]}'), (2, 7, None)], "id int, user_id int, progress_state string")
    merged = spark.createDataFrame([(7, 1, 1, 1, 90.0), (7, 1, 3, 0, None), (8, 1, 3, 1, 1.0)], "user_id int, session_id int, section_number int, completed int, quiz_score double")
    got = {r.id: (r.completed_sections, r.section_scores) for r in study.merged_sessions(sessions, merged).collect()}
    assert got == {1: ([1, 2], {1: 90.0}), 2: ([], None)}
    assert [r[0] for r in spark.createDataFrame([(5, 3), (-1, 3), (None, 3), (2, 0)], "i int, n int").select(study.section_index(F.col("i"), F.col("n"))).collect()] == [2, 0, 0, 0]


def test_tables(spark):
    old = spark.createDataFrame([(1, "ann"), (4, "bob")], "id bigint, name string")
    new = spark.createDataFrame([("bob", 1), ("cy", 300_000), ("cy", 2), ("di", 3)], "name string, arrival int")
    assert sorted(map(tuple, study.inserted(old, new, ["name"]).collect())) == [(1, "ann"), (4, "bob"), (5, "cy"), (6, "di")]
    assert study.inserted(old.where("false"), new.where("false"), ["name"]).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc int, t string")
    assert sorted(map(tuple, study.touched(docs, spark.createDataFrame([(2,), (2,), (None,)], "ref int"), "ref", "doc", "t", F.lit("now")).collect())) == [(1, "a"), (2, "now")]
    chunks = spark.createDataFrame([("c", None, 0, None), ("d", 3, 5, "p")], "chunk_id string, start_char int, end_char int, parent_id string")
    kept = study.stored_chunks(chunks)
    assert sorted(map(tuple, kept.collect())) == [("c", 0, 0, ""), ("d", 3, 5, "p")] and sorted(r.parent_id or "none" for r in study.restored_chunks(kept).collect()) == ["none", "p"]
    vectors = spark.createDataFrame([("c", [1.0]), ("c", []), (None, None)], "chunk_id string, vector array<double>")
    assert tuple(study.store_statistics(vectors, "x").first()) == ("x", 1, 1)
    times = spark.createDataFrame([(1.0, 3.5), (3.0, 1.0), (None, 2.0)], "a double, b double").select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    assert [(r.seconds, r.success) for r in study.response_times(times, "a", "b").collect()] == [(2.5, True), (0.0, True), (0.0, False)]
    texts = spark.createDataFrame([("hi", "en", "Hello"), ("hi", "he", "שלום"), ("bye", "en", "Bye")], "key string, language string, text string")
    wanted = spark.createDataFrame([("hi", "he"), ("bye", "he"), ("none", "de")], "key string, language string")
    assert {r.key: r.text for r in study.translated(texts, wanted).collect()} == {"hi": "שלום", "bye": "Bye", "none": "none"}
    assert spark.range(1).select(study.prepared_text(F.lit("x"), "multilingual-e5", True), study.prepared_text(F.lit(None).cast("string"), "other", True)).first()[:] == ("query: x", "")


def test_exams(spark):
    asked = spark.createDataFrame([(1, "en", 4), (2, "he", 99), (3, None, None)], "id int, lang string, n int")
    rows = study.fallback_exams(asked, "id", "lang", "n").collect()
    assert [sum(r.id == i for r in rows) for i in (1, 2, 3)] == [4, 10, 1]
    assert all((r.answer in r.options) == (r.type != "short_answer") for r in rows) and any("שאלת" in r.question for r in rows if r.id == 2)
    answers = spark.createDataFrame([(1, 1, "b", "S2", False), (1, 2, "a", "S1", False), (1, 3, "b", None, False), (1, 4, "c", "S3", True), (2, 1, "t", "", False), (3, 1, "t", "S", True)], "s int, question_no int, topic string, section_title string, is_correct boolean")
    got = {r.s: r for r in study.exam_results(answers, "s").collect()}
    assert (got[1].score, got[1].right, got[1].wrong, got[1].weak_topics, got[1].weak_sections) == (25, 1, 3, ["b", "a"], ["S2", "S1"])
    assert got[1].recommendation.startswith("Review S2 first") and got[2].recommendation.startswith("Review t and write") and got[3].recommendation.startswith("Good work")
    scores = spark.createDataFrame([(1, 2, "B", 10.0), (1, 1, "A", 79.9), (1, 3, "B", 0.0), (1, 4, "C", 80.0), (1, 5, None, 1.0)], "session_id int, section_number int, title string, quiz_score double")
    assert study.weak_sections(scores).first().weak_sections == ["A", "B"]


def test_quizzes_and_texts(spark):
    s = _sections(spark)
    q = study.section_quiz(s).orderBy("section_number", "no").collect()
    assert len(q) == 6 and q[0].question == "True or False: root is discussed in this section." and "Graphs" in q[2].question and q[0].source_page == 1
    cloze = spark.createDataFrame([(1, 2, "Fill", "x", ["x", "y"])], "session_id int, section_number int, prompt string, answer string, options array<string>")
    assert study.section_quiz(s, cloze).count() == 7
    plan = study.plan_text(s).first().plan
    assert plan.startswith("Session 1: Trees\nPages: 1-2\nEstimated time: 10 minutes\nDifficulty: Easy\nSummary: About trees.\nKey concepts: root, leaf\nLearning objectives: See a tree.\n\nSession 2: Graphs\nPage: 3\n")
    assert study.study_text(s).first().text == "Trees\nText one.\n\nGraphs\n\n\n\n"
    assert study.plan_text(_sections(spark, [])).count() == 0
    texts = spark.createDataFrame([(1, 1, 1, "One two three four five six seven. Alpha beta gamma delta epsilon zeta eta. One two three four five six seven. Other words are in this one here.")], "scope int, section_number int, id int, t string")
    rows = quiz.multiple_choice(texts, "scope", ["section_number", "id"], "t").orderBy("question_no").collect()
    assert rows[0].options == ["One two three four five six seven", "Alpha beta gamma delta epsilon zeta eta", "Other words are in this one here", "The opposite conclusion"] and len(rows) == 4


def test_pages_and_ideas(spark):
    pages = spark.createDataFrame([("d", 1, 1, "Graph trees and graphs"), ("d", 2, 2, "nothing here"), ("d", 3, 3, None), ("d", 4, 4, " "), ("e", 1, 5, "graph")], "scope string, page_number int, page_id int, text string")
    q = spark.createDataFrame([(1, "d", "What is a graph tree? Trees!", 2, 2), (2, "d", "the of", None, None), (3, "x", "graph", None, None)], "question_id int, scope string, question string, start_page int, end_page int")
    assert [(r.question_id, r.page_number, r.score) for r in study.ranked_pages(q, pages).orderBy("question_id", "rank").collect()] == [(1, 1, 2), (1, 2, 1)]
    assert {r.scope: r.context for r in study.pages_text(pages).collect()} == {"d": "Page 1\nGraph trees and graphs\n\nPage 2\nnothing here", "e": "Page 1\ngraph"}
    assert study.text_signature(pages).count() == 2
    assert [r[0] for r in spark.createDataFrame([("give me 7 ideas",), ("12 or 10",), (None,), ("none",)], "q string").select(study.requested_count("q")).collect()] == [7, 10, 5, 5]
    chunks = spark.createDataFrame([("d", "c1", 1, "A", "First one. More."), ("d", "c2", 1, "a", "FIRST one. Else."), ("d", "c3", 2, None, "x"), ("d", "c4", 3, "B", None)], "scope string, chunk_id string, page_number int, section_title string, text string")
    assert [r.idea for r in study.overview_ideas(chunks).orderBy("no").collect()] == ["A: First one.", "Study section: x"]
    merged = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "session_id int, section_number int, completed int")
    averages = spark.createDataFrame([(1, 50.0)], "session_id int, average double")
    assert [(r.topic, r.reason, r.rank) for r in study.review_items(_sections(spark), merged, averages).orderBy("rank").collect()] == [("Graphs", "low quiz", 1), (None, "low quiz", 2)]


def test_chapters_fall_back_to_sections(spark):
    pages = spark.createDataFrame([("d", 1, 1, "Chapter 1: Trees"), ("d", 2, 2, "plain"), ("e", 1, 3, "just text"), ("e", 2, 4, "more text")], "scope string, page_number int, page_id int, text string")
    s = spark.createDataFrame([("d", 4, "X", 1, 1), ("e", 4, "", 2, 2), ("e", 4, "", 2, 2), ("e", 0, "no", 1, 1)], "scope string, section_number int, title string, start_page int, end_page int")
    chapters = assemble.document_chapters(pages, s)
    assert sorted((r.scope, r.chapter_number, r.title, r.matched_by) for r in chapters.collect()) == [("d", 1, "Chapter 1: Trees", "heading"), ("e", 4, "Section 4", "section_fallback")]
    asked = spark.createDataFrame([(9, "e", [4, 5]), (8, "d", [1]), (7, "d", [3])], "request_id int, scope string, chapters array<int>")
    got = {r.request_id: (r.context, r.sources[0].type) for r in assemble.chapter_contexts(asked, chapters, pages).collect()}
    assert got == {9: ("[Chapter 4 | Section 4 | Pages 2-2]\nmore text", "study_section"), 8: ("[Chapter 1 | Chapter 1: Trees | Pages 1-2]\nChapter 1: Trees plain", "chapter")}


def test_pages_extracted_twice_do_not_overlap(spark):
    rows = [("d", n, 100 * k + n, "word " * (200 + 10 * n)) for n in range(1, 15) for k in (1, 2)]
    pages = spark.createDataFrame(rows, "scope string, page_number int, page_id bigint, text string")
    plan = planner.plan(pages, pages_per_section=3)
    assert planner.coverage_faults(plan, pages).count() == 0 and sum(r.pages for r in plan.collect()) == 14


def test_baselines_side_by_side(spark):
    q = spark.createDataFrame([(1, "d", "where is the graph")], "question_id bigint, scope string, question string")
    c = spark.createDataFrame([("d", "c1", 1, "the graph is here"), ("d", "c2", 2, "other")], "scope string, chunk_id string, page_number int, text string")
    got = {r.method for r in retrieval.baselines(q, c).collect()}
    assert got == set(retrieval.BASELINES)


def test_plan_faults(spark):
    pages = spark.createDataFrame([("d", n, "text") for n in (1, 2, 3, 200)] + [("d", 4, " "), ("e", 1, None), ("f", 1, "x")], "scope string, page_number int, text string")
    kind = "scope string, section_number int, start_page int, end_page int"
    faults = lambda rows, target=None: {tuple(r) for r in planner.plan_faults(spark.createDataFrame(rows, kind), pages, target).collect()}
    assert faults([("d", 1, 1, 2), ("d", 2, 3, 200), ("f", 1, 1, 1)]) == set()
    assert faults([("d", 1, 1, 2), ("d", 2, 2, 300), ("d", 3, 4, 4), ("d", 4, None, 3)]) == {("d", x) for x in ("overlap", "outside", "empty")}
    assert faults([("d", 1, 3, 1), ("e", 1, 1, 1)]) == {("d", "backwards"), ("d", "empty"), ("d", "uncovered"), ("e", "unreadable")}
    target = spark.createDataFrame([("f", 2)], "scope string, sections int")
    assert faults([("f", 1, 1, 1)], target) == {("f", "count")} and faults([("f", 1, 1, 2_000_000_000)]) == {("f", "outside")}


def test_stores_and_terms(spark, tmp_path):
    from leafmill.operators import vectors
    from leafmill.sources import datasets

    texts = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None)], "id int, t string")
    good = vectors.embedded(texts, "id", "t", lambda batch: [[1.0, 2.0] for _ in batch])
    got = {r.id: (r.provider, len(r.vector)) for r in good.collect()}
    assert got == {1: ("given", 2), 2: ("mock", 128), 3: ("mock", 128)}

    def fails(batch):
        raise RuntimeError("down")

    assert {r.provider for r in vectors.embedded(texts, "id", "t", fails).collect()} == {"mock"}
    vectors.save(good, str(tmp_path / "store"))
    assert vectors.load(spark, str(tmp_path / "store")).count() == 3
    words = spark.createDataFrame([("Summary of chapter 2",), (None,), ("cats bus gas",)], "t string").select(retrieval.expanded_terms("t").alias("w")).collect()
    assert {"summary", "summarize", "main", "idea", "key", "chapter", "section", "topic", "chapters"} <= set(words[0].w) and words[1].w == [] and {"cat", "cats"} <= set(words[2].w)
    root = tmp_path / "x" / "official" / "pdf" / "arxiv"
    root.mkdir(parents=True)
    for n in ("queries", "qrels", "answers"):
        (root / f"{n}.json").write_text("{}")
    assert datasets.benchmark_root(spark, str(tmp_path)).endswith("official/pdf/arxiv")
    assert datasets.rows_as_pages(texts, "id", "t", "s").count() == 1
    assert datasets.saved_states(texts, "id").where("id = 3").first().payload == '{"t":null}'
