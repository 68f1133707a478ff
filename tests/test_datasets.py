import json

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import assemble, evaluate, retrieval
from leafmill.sources import datasets


def test_evaluation_set(spark, tmp_path):
    rows = [{"question": " Q1 ", "answer": "A1", "pdf": "a.pdf", "page": 3, "level": "x", "metadata": {"k": "v"}}, [{"question": "Q2", "answer": "A2"}], "text", {"question": "Q3"}, {"question": "Q4", "answer": "A", "pdf": "b.pdf"}]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    got = sorted((r.question, r.pdf, r.page, r.source_text, tuple(sorted(r.metadata.items()))) for r in datasets.evaluation_set(spark, str(tmp_path / "e.json"), "d", "a.pdf").collect())
    assert got == [("Q1", "a.pdf", 3, "", (("k", "v"), ("level", "x"))), ("Q2", "a.pdf", None, "", ())]


def test_benchmark_folder(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    put = lambda n, x: (tmp_path / n).write_text(json.dumps(x))
    put("queries.json", {"q1": {"query": "one?"}, "q2": {"query": ""}, "q3": {"query": "three?"}, "q4": {"query": "four?"}})
    put("qrels.json", {"q1": {"doc_id": "d1", "section_id": 1}, "q2": {"doc_id": "d1"}, "q3": {"doc_id": "d2", "section_id": "bad"}, "q4": {"doc_id": "d9", "section_id": 7}})
    put("answers.json", {"q1": "a1", "q2": "a2", "q3": "a3", "q4": "a4"})
    put("pdf_urls.json", {"d1": "http://x/d1.pdf"})
    put("corpus/d1.json", {"title": "T1", "abstract": "", "sections": [{"text": "zero"}, {"text": "first words of the section", "tables": {"t": "row"}, "images": {"i1": "x"}}, {"text": ""}]})
    put("corpus/d2.json", {"title": "", "sections": [{"text": "two"}]})
    q = datasets.benchmark_questions(spark, str(tmp_path), source_chars=12)
    assert [(r.query_id, r.source_text, r.pdf) for r in q.orderBy("at").collect()] == [("q1", "first words", "http://x/d1.pdf"), ("q3", "two", "d2"), ("q4", "", "d9")]
    assert datasets.benchmark_questions(spark, str(tmp_path), limit=1).count() == 1
    p = datasets.corpus_pages(datasets.corpus(spark, str(tmp_path)), q).orderBy("page_number").collect()
    assert [r.page_number for r in p] == [1, 2, 3] and p[1].text == "Document ID: d1\nTitle: T1\nSection 1: first words of the section\nrow\n[image:i1]"


def test_saved_sessions(spark):
    df = spark.createDataFrame([(1, json.dumps({"pages": [{"page_number": 2, "text": "t"}, {}], "sections": [{"section_number": 1, "title": "A", "key_concepts": ["x"]}]})), (2, "broken {"), (3, None)], "k int, j string")
    assert sorted((r.k, r.page_number, r.text) for r in datasets.saved_pages(df, "k", "j").collect()) == [(1, 0, ""), (1, 2, "t")]
    assert [(r.title, r.difficulty, r.key_concepts) for r in datasets.saved_sections(df, "k", "j").collect()] == [("A", "Easy", ["x"])]


def test_files_and_parsers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"!x")
    (tmp_path / "c.pdf").write_bytes(b"!!")

    def main(b):
        if b.startswith(b"!"):
            raise ValueError
        return b.decode().split("|")

    got = datasets.extract_pages(datasets.files(spark, str(tmp_path)), main, lambda b: [b.decode().strip("!")]).collect()
    assert sorted((r.source_id, r.page_number, r.text, r.metadata["loader"]) for r in got) == [("a.pdf", 1, "one", "primary"), ("a.pdf", 2, "two", "primary"), ("b.pdf", 1, "x", "fallback")]


def test_reports(spark):
    df = spark.createDataFrame([("top1", 0.5, 3), ("top3", None, 4)], "config string, f1 double, n int")
    assert [r.value for r in datasets.report_lines(df, "config", ["config", "f1", "n"]).collect()] == ["| config | f1 | n |", "|---|---|---|", "| top1 | 0.500 | 3 |", "| top3 | n/a | 4 |"]
    q = spark.createDataFrame([(1, "P?", ["a", "b"], "a")], "question_no int, prompt string, options array<string>, answer string")
    assert datasets.quiz_lines(q).first().value == "## Question 1\nP?\n\n1. a\n2. b\n\n**Correct answer:** a"


def test_clean_pages(spark):
    df = spark.createDataFrame([(0, "<p>Alpha  beta</p>\n| | \n||| x1 |\n-", "dir/a.pdf", None), (1, "<br>", "a", None), (-1, "text here", "", {"source": "z/b.pdf"})], "page_number int, text string, source_id string, metadata map<string,string>")
    assert [(r.page_number, r.text, r.source_id) for r in datasets.clean_pages(df).collect()] == [(1, "Alpha beta\nx1", "a.pdf"), (None, "text here", "b.pdf")]


def test_text_helpers(spark):
    rows = [("Main idea of chapter 4?", "chapter_summary"), ("section two please", "section_summary"), ("help me study", "study_plan"), ("summary of the document", "general_pdf_summary"), ("what is x", "factual_question"), ("  ", "unknown"), (None, "unknown")]
    assert all(r[0] == r[1] for r in spark.createDataFrame(rows, "q string, i string").select(tx.query_intent("q"), "i").collect())
    j = spark.createDataFrame([('```json\n{"a": [1]}\n```',), ('text [1, 2] more',), ("none",), (None,)], "t string")
    assert [r[0] for r in j.select(tx.json_part("t")).collect()] == ['{"a": [1]}', "[1, 2]", None, None]
    assert spark.range(1).select(tx.tidy_list(F.array(F.lit(" a  b "), F.lit("a b"), F.lit(""), F.lit("ccc")), 5, 2)).first()[0] == ["a ", "cc"]


def test_answers_backfill_modes_chapters(spark):
    c = spark.createDataFrame([("d", "c1", 1, "Trees grow. Graph search uses queues. It ends."), ("d", "c2", 1, "Graph search again."), ("d", "c3", 2, "other"), ("d", "c4", 3, "last")], "scope string, chunk_id string, page_number int, text string").withColumn("metadata", F.create_map(F.lit("k"), F.col("chunk_id"))).withColumn("source_id", F.col("scope"))
    q = spark.createDataFrame([(1, "d", "graph search queues"), (2, "d", " "), (3, "d", "zzz")], "question_id bigint, scope string, question string")
    r = retrieval.bm25(q, c, 2)
    assert {x.question_id: x.answer for x in evaluate.composed_answers(q, r, c).collect()} == {1: "Graph search uses queues. Graph search again."}
    assert [x.chunk_id for x in retrieval.backfilled(r, q, c, 4).orderBy("rank").collect()] == [x.chunk_id for x in r.orderBy("rank").collect()] + ["c3", "c4"]
    for mode in retrieval.MODES:
        assert retrieval.retrieve(q, c, 2, mode).where("question_id = 2").count() == 0
        assert retrieval.retrieve(q, c, 2, mode, {"k": "c4"}).where("question_id = 1").count() == (1 if mode == "semantic" else 0)
    assert retrieval.retrieve(q, c, 2, "hybrid", reranked=True).where("question_id = 1").count() == 2
    assert len(retrieval.diagnostics(r, c).where("question_id = 1").first().results) == 2
    assert {(x.question_id, x.chunk_id): x.score for x in retrieval.important_words(q, c).collect()} == {(1, "c1"): 3.0, (1, "c2"): 2.0}
    p = spark.createDataFrame([("d", 1, 1, "alpha  beta"), ("d", 2, 2, "gamma")], "scope string, page_number int, page_id int, text string")
    ch = spark.createDataFrame([("d", 1, "Chapter 1", 1, 1), ("d", 2, "Chapter 2", 2, 2)], "scope string, chapter_number int, title string, start_page int, end_page int")
    asked = spark.createDataFrame([(9, "d", [2, 1, 7])], "request_id int, scope string, chapters array<int>")
    assert assemble.chapter_contexts(asked, ch, p).first().context == "[Chapter 2 | Chapter 2 | Pages 2-2]\ngamma\n\n[Chapter 1 | Chapter 1 | Pages 1-1]\nalpha beta"
