"""Ranking by blocks: the same as over all pairs, and no pair is shuffled."""

import math
import random
import re

import pytest

from leafmill.operators import ranking, retrieval

WORDS = "tree graph heap queue stack node edge leaf root path".split()


def shuffled(spark):
    """Rows that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def made(spark, n=400, m=300):
    """Chunks and questions of one scope, each with the word 'all', and a scope beside it."""
    rng = random.Random(1)
    c = [("a", f"c{i:03}", rng.randrange(40), " ".join(["All", *rng.choices(WORDS, k=rng.randrange(1, 9))])) for i in range(n)] + [("b", "x", 1, "tree")]
    q = [(j, "a", " ".join(["all", *rng.choices(WORDS, k=rng.randrange(4))])) for j in range(m)] + [(m, "b", "Tree heap"), (m + 1, "none", "tree")]
    return q, c, spark.createDataFrame(q, "question_id bigint, scope string, question string"), spark.createDataFrame(c, "scope string, chunk_id string, page_number int, text string")


def overlap(q, c, k):
    out = {}
    for i, scope, question in q:
        own = [(-len({*question.lower().split()} & {*t.lower().split()}), p, x) for s, x, p, t in c if s == scope]
        out |= {(i, r): (x, -s) for r, (s, p, x) in enumerate(sorted(o for o in own if o[0])[:k], 1)}
    return out


def ranked(df):
    return {(r["question_id"], r["rank"]): r["chunk_id"] for r in df.collect()}


@pytest.mark.parametrize("block", [50, 5_000])
def test_keyword_overlap_moves_no_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block, raising=False)
    monkeypatch.setattr(ranking, "CELLS", 3_000)
    q, c, questions, chunks = made(spark)
    before = shuffled(spark)
    found = retrieval.keyword_overlap(questions, chunks).collect()
    assert shuffled(spark) - before < 400 * 300 / 4
    assert {(r["question_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found} == overlap(q, c, 3)


def test_plain_baselines_move_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 50)
    q, c, questions, chunks = made(spark)
    before = shuffled(spark)
    found = retrieval.baselines(questions, chunks, names=["document_order", "keyword_overlap"]).collect()
    assert shuffled(spark) - before < 400 * 300 / 4
    assert {(r["question_id"], r["rank"]): r["chunk_id"] for r in found if r["method"] == "keyword_overlap"} == {i: x for i, (x, _) in overlap(q, c, 3).items()}
    first = sorted((p, x) for s, x, p, _ in c if s == "a")[:3]
    assert sorted({(r["rank"], r["chunk_id"]) for r in found if r["method"] == "document_order" and r["question_id"] < 300}) == [(i, x) for i, (_, x) in enumerate(first, 1)]


def bm25(q, c, k, padded=False):
    terms = {x: t.lower().split() for _, x, _, t in c}
    out = {}
    for i, scope, question in q:
        own = [x for s, x, _, _ in c if s == scope]
        mean = sum(len(terms[x]) for x in own) / max(1, len(own))
        asked, rows = question.lower().split(), []
        df = {w: sum(w in terms[x] for x in own) for w in asked}
        for s, x, p, _ in c:
            if s == scope and (padded or {*asked} & {*terms[x]}):
                score = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * terms[x].count(w) * 2.5 / (terms[x].count(w) + 1.5 * (0.25 + 0.75 * len(terms[x]) / mean)) for w in asked)
                rows.append((-round(score, 9), p, x))
        out |= {(i, r): x for r, (_, _, x) in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize("padded", [False, True])
def test_bm25_moves_no_pairs(spark, monkeypatch, padded):
    monkeypatch.setattr(ranking, "BLOCK", 50)
    monkeypatch.setattr(ranking, "CELLS", 3_000)
    q, c, questions, chunks = made(spark)
    before = shuffled(spark)
    found = ranked(retrieval.bm25(questions, chunks, 5, padded))
    assert shuffled(spark) - before < 400 * 300 / 4
    assert found == bm25(q, c, 5, padded)


def test_copies_of_a_chunk_count_once(spark):
    """One chunk_id on one page with two texts is one chunk, as in SQL."""
    chunks = spark.createDataFrame([("a", "c1", 1, "tree tree"), ("a", "c1", 1, "tree heap leaf"), ("a", "c2", 2, "tree")], "scope string, chunk_id string, page_number int, text string")
    questions = spark.createDataFrame([(1, "a", "tree heap")], "question_id bigint, scope string, question string")
    assert [(r.chunk_id, r.score) for r in retrieval.keyword_overlap(questions, chunks).orderBy("rank").collect()] == [("c1", 2.0), ("c2", 1.0)]
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    one = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    got = {r.chunk_id: r.score for r in retrieval.bm25(questions, chunks).collect()}
    assert got == pytest.approx({"c1": idf(3) * (one(2, 2) + one(1, 3)) + idf(1) * one(1, 3), "c2": idf(3) * one(1, 1)})


def test_depths_are_evaluations_of_the_first(spark):
    from leafmill.operators import evaluate

    chunks = spark.createDataFrame([("a", f"c{i}", t) for i, t in enumerate(["one two", "three one", "four"])], "scope string, chunk_id string, text string")
    questions = spark.createDataFrame([(1, "one four", "four"), (2, "two", None)], "question_id bigint, answer string, source_text string")
    found = spark.createDataFrame([(1, "c0", 1), (1, "c1", 2), (1, "c2", 3)], "question_id bigint, chunk_id string, rank int")
    rows = evaluate.evaluate_depths(questions, found, chunks, [1, 2, 3])
    for k in (1, 2, 3):
        assert sorted(map(tuple, rows.where(f"depth = {k}").drop("depth").collect())) == sorted(map(tuple, evaluate.evaluate(questions, found.where(f"rank <= {k}"), chunks).collect()))


def test_gated_moves_no_pairs_and_large_scopes_score_alike(spark, monkeypatch):
    from pyspark.sql import functions as F

    _, _, questions, chunks = made(spark, n=120, m=100)
    questions = questions.withColumn("question", F.concat("question", F.lit(" stack queue section 2")))
    chunks = chunks.withColumn("section_number", F.col("page_number") % 4).withColumn("section_title", F.lit("Nodes")).withColumn("key_concepts", F.array(F.lit("root")))
    run = lambda: sorted(map(tuple, retrieval.gated(questions, chunks, diagnostics=True).collect()))
    before = shuffled(spark)
    whole = run()
    assert shuffled(spark) - before < 120 * 100 / 4 and len(whole) > 400
    monkeypatch.setattr(ranking, "BLOCK", 20)
    monkeypatch.setattr(ranking, "CELLS", 500)
    assert run() == whole


def test_rerank_moves_no_texts(spark, monkeypatch):
    """What of the question's terms a chunk has comes with the ranking, for each row of a repeated chunk_id too."""
    monkeypatch.setattr(ranking, "BLOCK", 50)
    _, _, questions, chunks = made(spark, n=120, m=60)
    more = [("a", "c003", 50, "all tree heap"), ("a", "c004", 51, "leaf"), ("b", "c003", 1, "tree heap stack")]
    chunks = chunks.unionByName(spark.createDataFrame(more, chunks.schema))
    own = retrieval.bm25(questions, chunks, 12, padded=True, matched=True)
    rows = lambda x: sorted((r["question_id"], r["rank"], r["chunk_id"], r["page_number"], round(r["score"], 9)) for r in x.collect())
    found = retrieval.rerank(own, questions, chunks)
    assert rows(found) == rows(retrieval.rerank(own.drop("matched"), questions, chunks))
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    """Columns read from each table, as the plan has them."""
    import re

    return [re.findall(r"(\w+)#", r) for r in re.findall(r"FileScan parquet \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())]


def test_sections_of_chunks_leave_the_sections_texts(spark):
    from leafmill.queries import reference

    read = scans(reference._titled(spark, "/root/testdata/sf0.001"))
    assert read and not any("section_text" in r for r in read)
    assert sum("text" in r for r in read) == 1


def test_backfilled_ranks_once_and_reads_texts_for_it_only(spark):
    import __spark_entry__

    df = __spark_entry__.queries()["backfilled_top5"](spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroups" not in df._jdf.queryExecution().executedPlan().toString()
    assert not any("text" in r for r in scans(df))


def test_citations_read_texts_for_the_ranking_only(spark):
    import __spark_entry__

    assert not any("text" in r for r in scans(__spark_entry__.queries()["citations"](spark, "/root/testdata/sf0.001")))


def test_composed_answers_rank_once_and_move_no_sentences(spark):
    from leafmill.operators import evaluate

    chunks = spark.createDataFrame([("c1", "A tree has roots. The heap is a tree of nodes. A heap."), ("c2", "A heap. Nodes of the heap and the tree!"), ("c3", None), ("c4", "Nothing here.")], "chunk_id string, text string")
    questions = spark.createDataFrame([(1, "What is a heap tree?"), (2, "Which queue?"), (3, "heap")], "question_id bigint, question string")
    ranked = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (1, "c3", 3), (2, "c4", 1), (2, "c3", 2), (3, "c3", 1)], "question_id bigint, chunk_id string, rank int")
    found = evaluate.composed_answers(questions, ranked, chunks)
    assert {r[0]: r[1] for r in found.collect()} == {1: "The heap is a tree of nodes. Nodes of the heap and the tree! A heap.", 2: "Nothing here."}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0


@pytest.mark.parametrize("block", [20, 5_000])
def test_copies_of_rows_are_one_where_they_are_ranked(spark, monkeypatch, block):
    """Equal rows count once; those that differ in the text, null or empty among them, count each."""
    monkeypatch.setattr(ranking, "BLOCK", block)
    _, c, questions, chunks = made(spark, n=120, m=60)
    more = [*c[:70], *c[:5], ("a", "c001", c[1][2], c[1][3] + "!"), ("a", "c002", c[2][2], None), ("a", "c002", c[2][2], None), ("a", "c002", c[2][2], ""), ("a", None, None, "all heap"), ("a", None, None, "all heap"), (None, "c9", 1, "all")]
    chunks = chunks.unionByName(spark.createDataFrame(more, chunks.schema))
    rows = lambda x: sorted((r["question_id"], r["rank"], r["chunk_id"] or "", r["page_number"] or 0, round(r["score"], 9)) for r in x.collect())
    assert rows(retrieval.bm25(questions, chunks, 12, padded=True, copies=True)) == rows(retrieval.bm25(questions, chunks.distinct(), 12, padded=True))


def test_contexts_move_texts_for_the_join_only(spark, monkeypatch):
    from leafmill.queries import reference

    def none(df, *_):
        raise AssertionError("chunks are settled")

    monkeypatch.setattr(ranking, "settle", none)
    plan = reference.question_contexts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(chunk_id#\d+, \d+\), REPARTITION", plan)) == 1


def test_questions_of_a_scope_lie_together(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TOGETHER", 20)
    q = spark.createDataFrame([(i, "a" if i < 100 else f"b{i % 3}") for i in range(130)] + [(0, "z"), (1, "a")], "question_id bigint, scope string")
    found = spark.createDataFrame([(i, i) for i in range(130)], "question_id bigint, rank int")
    near = {r["question_id"]: r["near"] for r in retrieval.together(found, q).collect()}
    assert len(near) == 130
    assert len({near[i] for i in range(100)}) == 5
    assert all(len({near[i] for i in range(100, 130) if i % 3 == j}) == 1 for j in range(3))


def test_measures_are_alike_where_questions_lie_together(spark):
    from leafmill.operators import evaluate

    _, _, questions, chunks = made(spark, n=40, m=20)
    questions = questions.selectExpr("*", "substring(question, 5) as answer", "case when question_id % 3 > 0 then 'tree' end as source_text")
    questions = questions.unionByName(questions.where("question_id = 1").selectExpr("question_id", "scope", "question", "'heap' as answer", "null as source_text"))
    questions = questions.unionByName(questions.where("question_id = 2").selectExpr("null as question_id", "scope", "question", "answer", "source_text"))
    found = retrieval.bm25(questions.where("question_id is not null"), chunks, 5)
    rows = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    near = evaluate.evaluate_depths(retrieval.together(questions, questions), retrieval.together(found, questions), chunks, [1, 3])
    assert rows(near) == rows(evaluate.evaluate_depths(questions, found, chunks, [1, 3])) and near.count() == 2 * 24


def test_best_configuration_moves_texts_for_the_join_only(spark, monkeypatch):
    from leafmill.queries import reference

    def none(df, *_):
        raise AssertionError("chunks are settled")

    monkeypatch.setattr(ranking, "settle", none)
    plan = reference.best_configuration(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(chunk_id#\d+, \d+\), REPARTITION", plan)) == 1
