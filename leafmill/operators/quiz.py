"""Questions made from texts, checks of given questions, and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

# What fills up options, and words that stand for no topic.
FILL_OPTIONS = ["analysis", "document", "concept", "process", "method", "record"]
FILL_DISTRACTORS = ["The opposite conclusion", "An unrelated definition", "A random example"]
GRADING_STOP = "about answer based explain from idea important material question review section study this with".split()
QUESTION_TYPES = ["multiple_choice", "true_false", "short_answer"]
_EDGE = r"""^[.,;:()\[\]"'`]+|[.,;:()\[\]"'`]+$"""


def _longest(words: Column) -> Column:
    """The longest of an array of words, the first of equals."""
    ranked = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.get(F.array_sort(ranked), F.lit(0))["w"]


def cloze(texts: DataFrame, scope: str, order: list[str], text: str, stop: list[str], n: int = 3) -> DataFrame:
    """(scope, question_no, prompt, answer, options): sentences of eight or more words with their longest word (above
    five characters, no stop word) left out once; options are it and the first three other such words of the scope."""
    s = texts.select(scope, *order, F.posexplode(tx.sentences(tx.clean(text), 8)).alias("_no", "_s"))
    words = F.filter(F.transform(F.split("_s", r"\s+"), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: (F.length(w) > 5) & ~F.lower(w).isin(stop))
    s = s.withColumn("answer", _longest(words)).where(F.col("answer").isNotNull())
    place = F.instr("_s", F.col("answer"))
    s = s.withColumn("prompt", F.concat(F.lit("Fill in the blank: "), F.substring(F.col("_s"), F.lit(1), place - 1), F.lit("_____"), F.substring(F.col("_s"), place + F.length("answer"), F.length("_s"))))
    s = s.withColumn("at", F.struct(*order, "_no"))
    pool = s.groupBy(scope, F.lower("answer").alias("low")).agg(F.min(F.struct("at", "answer")).alias("f"))
    pool = pool.withColumn("r", F.row_number().over(Window.partitionBy(scope).orderBy("f.at"))).where("r <= 4").groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "f.answer"))), lambda x: x["answer"]).alias("pool"))
    first = s.groupBy(scope, "prompt").agg(F.min(F.struct("at", "answer")).alias("f"))
    first = first.withColumn("question_no", F.row_number().over(Window.partitionBy(scope).orderBy("f.at"))).where(F.col("question_no") <= n)
    other = F.filter(F.concat("pool", F.array(*[F.lit(x) for x in FILL_OPTIONS])), lambda w: F.lower(w) != F.lower("f.answer"))
    return first.join(pool, scope).select(scope, "question_no", "prompt", F.col("f.answer").alias("answer"), F.concat(F.array("f.answer"), F.slice(other, 1, 3)).alias("options"))


def multiple_choice(texts: DataFrame, scope: str, order: list[str], text: str, n: int = 5) -> DataFrame:
    """(scope, question_no, answer, options): the first eight words of a sentence of seven or more as the answer, those
    of the next sentences that differ as distractors, however far on they are.

    Of every phrase the first place after each of the ``n`` questions is a minimum that tasks combine; the three nearest
    are kept.
    """
    s = texts.select(scope, *order, F.posexplode(tx.sentences(text, 7, at_lines=True)).alias("_no", "_s"))
    phrase = F.array_join(F.slice(F.regexp_extract_all(F.substring("_s", 1, 220), F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0)), 1, 8), " ")
    s = s.select(scope, phrase.alias("answer"), F.row_number().over(Window.partitionBy(scope).orderBy(*order, "_no")).alias("question_no"))
    asked = s.where(F.col("question_no") <= n)
    first = s.where("answer <> ''").groupBy(scope, F.col("answer").alias("other")).agg(*[F.min(F.when(F.col("question_no") > i, F.col("question_no"))).alias(f"_{i}") for i in range(1, n + 1)])
    later = first.select(scope, "other", F.explode(F.array(*[F.struct(F.lit(i).alias("question_no"), F.col(f"_{i}").alias("at")) for i in range(1, n + 1)])).alias("x")).select(scope, "other", "x.question_no", "x.at").where("at is not null")
    near = later.join(asked, [scope, "question_no"]).where(F.lower("other") != F.lower("answer"))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(scope, "question_no").orderBy("at"))).where("_r <= 3")
    near = near.groupBy(scope, "question_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "other"))), lambda x: x["other"]).alias("others"))
    other = F.slice(F.concat(F.coalesce("others", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in FILL_DISTRACTORS])), 1, 3)
    return asked.join(near, [scope, "question_no"], "left").select(scope, "question_no", "answer", F.concat(F.array("answer"), other).alias("options"))


def valid_question(options: Column, answer: Column) -> Column:
    """Whether a question has exactly four options and the answer is one of them; false where either is null."""
    return F.coalesce((F.size(options) == 4) & F.array_contains(options, answer), F.lit(False))


def normal_answer(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*[A-Da-d][.)]\s*", ""), r"\s+", " ")))


def option_letter(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Da-d])(?:[.)]|\s*$)", 1))


def correct(kind: Column, given: Column, expected: Column, options: Column) -> Column:
    """Whether an answer is right: equal, of the same letter, or the option of the expected letter; a short answer also
    if either holds the other. No answer is wrong."""
    g, e = normal_answer(given), normal_answer(expected)
    gl, el = option_letter(given), option_letter(expected)
    by_letter = F.coalesce(normal_answer(F.get(options, F.when(el != "", F.ascii(el) - 97))) == g, F.lit(False))
    closed = (g == e) | F.when((gl != "") & (el != ""), gl == el).otherwise((el != "") & by_letter)
    short = (g != "") & ((g == e) | e.contains(g) | g.contains(e))
    return F.when(F.coalesce(given, F.lit("")) == "", False).when(kind.isin("multiple_choice", "true_false"), closed).otherwise(short)


def graded(answers: DataFrame, by: str) -> DataFrame:
    """(by, score, right, wrong, weak_topics) from (by, question_no, topic, is_correct): percent rounded half to even;
    topics of wrong answers in the order in which they first come."""
    weak = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_correct"), F.struct("question_no", "topic")))), lambda x: x["topic"])
    x = answers.groupBy(by).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("right"), F.array_distinct(weak).alias("weak_topics"))
    return x.select(by, F.bround(F.col("right") * 100 / F.greatest(F.lit(1), F.col("n"))).cast("int").alias("score"), "right", (F.col("n") - F.col("right")).alias("wrong"), "weak_topics")


def grading_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z][a-z0-9-]{3,}"), F.lit(0)), lambda w: ~w.isin(GRADING_STOP)))


def related_sections(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, section_number, overlap): the section of a question's session with most of its words; the first of
    equals, none without any. Questions (question_id, session_id, text), sections (session_id, section_number, text)."""
    q = questions.select("question_id", "session_id", F.explode(grading_tokens(F.col("text"))).alias("w"))
    s = sections.select("session_id", "section_number", F.explode(grading_tokens(F.col("text"))).alias("w"))
    n = q.join(s, ["session_id", "w"]).groupBy("question_id", "section_number").agg(F.count("*").alias("overlap"))
    r = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("overlap"), "section_number"))
    return n.withColumn("r", r).where("r = 1").drop("r")


def parsed_score(c: Column) -> Column:
    """The number after 'Score:', from 0 to 100; null without one."""
    value = F.nullif(F.regexp_extract(c, r"(?i)score:\s*(\d{1,9})", 1), F.lit("")).cast("int")
    return F.when(value.isNotNull(), F.least(F.lit(100), value))


def normal_exam(exams: DataFrame, key: str, payload: str, most: int = 25) -> DataFrame:
    """(key, no, type, question, answer, topic) from JSON text {"questions": [...]}: unknown types are short answers,
    missing answers and topics get a default, questions without text are left out, as is what is no JSON."""
    kind = "struct<questions:array<struct<id:int,type:string,question:string,options:array<string>,answer:string,topic:string>>>"
    x = exams.select(key, F.posexplode(F.from_json(payload, kind)["questions"]).alias("at", "q")).where(F.trim("q.question") != "")
    t = F.regexp_replace(F.lower(F.trim("q.type")), " ", "_")
    no = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return x.withColumn("no", no).where(F.col("no") <= max(1, most)).select(key, "no", F.when(t.isin(QUESTION_TYPES), t).otherwise("short_answer").alias("type"), F.trim("q.question").alias("question"), F.coalesce(F.nullif("q.answer", F.lit("")), F.lit("Review the related study material.")).alias("answer"), F.coalesce("q.topic", F.lit("General")).alias("topic"))
