from pyspark.sql import functions as F

from leafmill.operators import progress, quiz
from leafmill.streaming import progress as streams


def test_correct(spark):
    rows = [("multiple_choice", "B) two", "b", ["one", "two"], True), ("multiple_choice", "two", "B", ["one", "two"], True), ("multiple_choice", "one", "B", ["one", "two"], False), ("true_false", " TRUE ", "true", None, True), ("short_answer", "divides input", "It divides input in two", None, True), ("short_answer", "", "x", None, False), ("short_answer", None, "x", None, False), ("short_answer", "zzz", "x", None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, g string, e string, o array<string>, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", quiz.correct(F.col("k"), F.col("g"), F.col("e"), F.col("o")).alias("got")).collect())


def test_grading(spark):
    df = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", False), (1, 3, "c", False), (1, 4, "b", False), (2, 1, "a", True)], "s int, question_no int, topic string, is_correct boolean")
    got = {r.s: tuple(r)[1:] for r in quiz.graded(df, "s").collect()}
    assert got == {1: (25, 1, 3, ["b", "c"]), 2: (100, 1, 0, [])}


def test_made_questions(spark):
    text = "Breadth first search visits every node of graphs quickly. Another wonderful sentence explains exploration of the nodes. Too short here."
    df = spark.createDataFrame([(1, 1, text), (1, 2, None), (2, 1, "")], "s int, o int, t string")
    rows = quiz.cloze(df, "s", ["o"], "t", []).orderBy("question_no").collect()
    assert rows[0].prompt == "Fill in the blank: _____ first search visits every node of graphs quickly." and rows[0].answer == "Breadth" and len(rows[0].options) == 4 and len(rows) == 2
    mc = quiz.multiple_choice(df, "s", ["o"], "t").orderBy("question_no").collect()
    assert len(mc) == 2 and all(len(r.options) == 4 and r.options[0] == r.answer for r in mc)


def test_exam_and_score(spark):
    good = '{"questions":[{"question":" Q1 ","type":"Multiple Choice","options":["a"],"answer":"","topic":null},{"question":""},{"question":"Q2","type":"odd"}]}'
    df = spark.createDataFrame([(1, good), (2, "no json"), (3, None)], "k int, p string")
    assert [(r.k, r.no, r.type, r.question, r.answer, r.topic) for r in quiz.normal_exam(df, "k", "p").collect()] == [(1, 1, "multiple_choice", "Q1", "Review the related study material.", "General"), (1, 2, "short_answer", "Q2", "Review the related study material.", "General")]
    s = spark.createDataFrame([("Score: 85 good",), ("score: 900",), ("none",), (None,)], "t string")
    assert [r[0] for r in s.select(quiz.parsed_score(F.col("t"))).collect()] == [85, 100, None, None]


def test_related(spark):
    q = spark.createDataFrame([(1, 1, "graph traversal queues"), (2, 1, "nothing"), (3, 1, None)], "question_id int, session_id int, text string")
    s = spark.createDataFrame([(1, 1, "graph queues"), (1, 2, "graph traversal"), (1, 3, None)], "session_id int, section_number int, text string")
    assert [tuple(r) for r in quiz.related_sections(q, s).collect()] == [(1, 1, 2)]


SAVES = "id bigint, user_id bigint, session_id bigint, section_number int, completed int, quiz_score double, explanation_text string, updated_at int"


def test_progress(spark):
    rows = [(1, 7, 1, 1, 1, 80.0, "a", 5), (2, 7, 1, 1, 0, None, None, 3), (3, 7, 1, 2, 0, 60.0, "b", 4), (3, 7, 1, 2, 0, 60.0, "b", 4)]
    saves = spark.createDataFrame(rows, SAVES)
    got = {r.section_number: (r.completed, r.quiz_score, r.explanation_text, r.saves) for r in progress.merged_progress(saves).collect()}
    assert got == {1: (1, None, None, 2), 2: (0, 60.0, "b", 1)}
    assert {r.id for r in progress.latest(saves, ["session_id", "section_number"], "updated_at").collect()} == {1, 3}
    merged = progress.merged_progress(saves).drop("saves")
    new = spark.createDataFrame([(7, 1, 1, 0, 90.0, "n"), (7, 1, 3, 1, None, None)], "user_id bigint, session_id bigint, section_number int, completed int, quiz_score double, explanation_text string")
    up = {r.section_number: (r.completed, r.quiz_score) for r in progress.upsert_progress(merged, new).collect()}
    assert up == {1: (1, 90.0), 2: (0, 60.0), 3: (1, None)}
    assert progress.replaced(merged, new, ["session_id"]).count() == 2 and progress.key_faults(saves, ["id"]).count() == 1
    assert progress.merged_progress(saves.where("false")).count() == 0


def test_timer_and_format(spark):
    ev = spark.createDataFrame([(1, 7, 10, "view"), (2, 7, 20, "view"), (3, 7, 75, "click"), (4, 7, 80, "click"), (5, 7, 90, "view")], "event_id int, user_id int, s int, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    assert [tuple(r) for r in progress.study_seconds(ev, "user_id", "ts", "event_type", "view", ["click"], "event_id").collect()] == [(7, 65, 1)]
    df = spark.createDataFrame([(65,), (3700,), (-3,)], "s int")
    assert [r[0] for r in df.select(progress.format_seconds(F.col("s"))).collect()] == ["1m 5s", "1h 1m", "0m 0s"]
    m = spark.range(1).select(progress.overlay(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first().m
    assert m == {"a": 1, "b": 3}


def test_streams(spark, tmp_path):
    saves = spark.createDataFrame([(1, 7, 1, 1, 1, 80.0, "a", 5), (2, 7, 1, 1, 0, None, None, 3)], SAVES)
    saves.write.parquet(str(tmp_path / "saves"))
    live = spark.readStream.schema(saves.schema).parquet(str(tmp_path / "saves"))
    q = streams.progress_stream(live).writeStream.format("memory").queryName("prog").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.completed, r.quiz_score) for r in spark.sql("select * from prog").collect()] == [(1, None)]
    ev = spark.createDataFrame([(1, 7, 10, "view"), (2, 7, 20, "view"), (3, 7, 75, "click")], "event_id bigint, user_id bigint, s bigint, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    ev.write.parquet(str(tmp_path / "ev"))
    q = streams.study_time(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("timer").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from timer").collect()] == [(7, 65)]
    store = {"df": spark.createDataFrame([("a", 0, 1)], "chunk_id string, ordinal int, v int")}
    new = spark.createDataFrame([("a", 0, 5), ("b", 1, 6)], "chunk_id string, ordinal int, v int")
    streams.index_upserts(lambda: store["df"], lambda d: store.update(df=d))(new, 0)
    assert sorted(tuple(r) for r in store["df"].collect()) == [("a", 0, 5), ("b", 2, 6)]
