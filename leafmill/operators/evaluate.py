"""Measures of retrieval and answers, one row for each question, and their averages for each configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx


def token_f1(answer: Column | str, truth: Column | str) -> Column:
    """F1 of the distinct white-space words in lower case; 0 where either has none."""
    a, b = F.array_distinct(tx.blank_words(answer)), F.array_distinct(tx.blank_words(truth))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def precision_at(texts: Column, source: Column | str) -> Column:
    """Share of the retrieved texts that hold the source text, whatever the case; null without a source or texts."""
    s = F.lower(F.trim(tx.col(source)))
    hit = F.size(F.filter(texts, lambda t: F.lower(t).contains(s)))
    return F.when((F.coalesce(s, F.lit("")) != "") & (F.size(texts) > 0), hit / F.size(texts))


def recall_at(texts: Column, source: Column | str) -> Column:
    """1 if any retrieved text holds the source text, else 0; null as precision."""
    p = precision_at(texts, source)
    return F.when(p.isNotNull(), F.when(p > 0, 1.0).otherwise(0.0))


def grounding(answer: Column | str, context: Column | str) -> Column:
    """Share of the answer's distinct words that the context has; 0 for an empty answer."""
    a = F.array_distinct(tx.blank_words(answer))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, F.array_distinct(tx.blank_words(context)))) / F.size(a))


def evaluate(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, answer, f1, precision, recall, grounding): the answer is the retrieved texts one after the other.

    ``questions``: (question_id, answer, source_text); ``retrieved``: (question_id, chunk_id, rank); ``chunks``: (scope,
    chunk_id, text). Questions for which nothing was retrieved have zeros and nulls.
    """
    return _measured(_texts(questions, retrieved, chunks).withColumn("texts", F.col("r.text")))


def evaluate_depths(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame, depths: list[int]) -> DataFrame:
    """The same for the first so many of the retrieved, as ``depth``: texts are joined once for all depths. Where questions and
    retrieved have ``near``, copies of a text are moved behind one another."""
    x = _texts(questions, retrieved, chunks).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    return _measured(x.withColumn("texts", F.transform(F.filter("r", lambda t: t["rank"] <= F.col("depth")), lambda t: t["text"])), "depth")


def _texts(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    if "near" in retrieved.columns:
        return _near_texts(questions, retrieved, chunks)
    texts = retrieved.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r"))
    return questions.select("question_id", "answer", "source_text").join(texts, "question_id", "left")


def _near_texts(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same where questions and retrieved have ``near`` (``retrieval.together``): one shuffle by it brings both together."""
    t = retrieved.join(chunks.select("chunk_id", "text"), "chunk_id").select("near", "question_id", F.struct("rank", "text").alias("t"))
    q = questions.select("near", "question_id", F.struct("answer", "source_text").alias("q"))
    x = q.unionByName(t, allowMissingColumns=True).repartition("near").groupBy("near", "question_id").agg(F.collect_list("q").alias("q"), F.array_sort(F.collect_list("t")).alias("r"))
    return x.select("question_id", F.explode("q").alias("q"), "r").select("question_id", "q.answer", "q.source_text", "r")


def _measured(x: DataFrame, *more: str) -> DataFrame:
    x = x.withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    context = F.array_join("texts", "\n")
    return x.select("question_id", *more, token_f1(context, "answer").alias("f1"), precision_at(F.col("texts"), "source_text").alias("precision"), recall_at(F.col("texts"), "source_text").alias("recall"), grounding(context, context).alias("grounding"))


def averages(rows: DataFrame, by: str = "config") -> DataFrame:
    """For each configuration: means (nulls don't count for precision and recall), number of questions and of labelled ones."""
    r = lambda c: F.round(F.avg(c), 4).alias(c)
    return rows.groupBy(by).agg(r("f1"), r("precision"), r("recall"), r("grounding"), F.count("*").alias("questions"), F.count("precision").alias("labelled"))


def best_config(summary: DataFrame, measure: str, order: str = "config", least: bool = False) -> DataFrame:
    """The configuration best in a measure; of equal ones the first."""
    key = F.asc_nulls_last(measure) if least else F.desc_nulls_last(measure)
    return summary.orderBy(key, order).limit(1)


def best_sentence(question: Column | str, texts: Column | str, most: int = 260) -> Column:
    """The sentence with most of the question's distinct terms, the first of equals, cut to ``most`` characters."""
    q = F.array_distinct(tx.plain_terms(question))
    s = F.filter(F.transform(F.split(F.trim(tx.col(texts)), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    ranked = F.transform(s, lambda x, i: F.struct((-F.size(F.array_intersect(q, F.array_distinct(tx.plain_terms(x))))).alias("o"), i.alias("i"), x.alias("s")))
    return tx.ellipsis(F.coalesce(F.get(F.array_sort(ranked), F.lit(0))["s"], F.lit("")), most)


# Words that are no keyword of a question.
KEYWORD_STOP = "what is a an the of in on for to about does do how why can should with as and or from that this are be it".split()
# What else a keyword goes by.
SYNONYMS = {"inner": ["inner join", "join"], "join": ["inner join", "join"], "sql": ["structured query language", "sql"], "rdbms": ["relational database management system", "relational database"], "select": ["select"], "table": ["table"]}


def keywords(c: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(tx.col(c), F.lit(""))), F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"), F.lit(0)), lambda w: ~w.isin(KEYWORD_STOP))


def reliable(question: Column | str, texts: Column, least: float = 0.4) -> Column:
    """Whether the texts have enough of the question's keywords, or what else these go by."""
    t = F.lower(F.array_join(texts, "\n\n"))
    kw = keywords(question)
    names = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    has = lambda w: t.contains(w) | F.coalesce(F.exists(F.try_element_at(names, w), lambda s: t.contains(s)), F.lit(False))
    share = F.size(F.filter(kw, has)) / F.nullif(F.size(kw), F.lit(0))
    inner = F.lower(tx.col(question)).contains("inner join") & ~t.contains("join")
    return (F.size(texts) > 0) & (F.size(kw) > 0) & ~inner & F.coalesce(share >= least, F.lit(False))


def confidence(contexts: DataFrame, weak: float = 0.05) -> DataFrame:
    """(question_id, confidence, level, weak) from the best score of each question's contexts (question_id, score)."""
    best = contexts.groupBy("question_id").agg(F.max("score").alias("best"))
    value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best"))) * F.when(F.col("best") < weak, 0.45).otherwise(1.0), 3)
    x = best.select("question_id", value.alias("confidence"), (F.col("best") < weak).alias("weak"))
    return x.withColumn("level", F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.35, "medium").otherwise("low"))


def ordered_distinct(df: DataFrame, by: str, value: str, order: str, name: str) -> DataFrame:
    """Distinct values of each group in the order in which they first come, as an array."""
    first = df.groupBy(by, value).agg(F.min(order).alias("_o"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))


def last_messages(messages: DataFrame, by: str, order: str, n: int = 12) -> DataFrame:
    """The last ``n`` rows of each group."""
    return messages.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def composed_answers(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, most: int = 500) -> DataFrame:
    """(question_id, answer): the three distinct sentences of the ranked chunks with most of the question's keywords, the
    shorter first among equals; without any, the first two chunks; cut at a word to ``most`` characters."""
    texts = ranked.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("r"))
    x = texts.join(questions.groupBy("question_id").agg(F.collect_list(keywords("question")).alias("kw")), "question_id")
    sentences = lambda t: F.filter(F.transform(F.split(F.coalesce(t["text"], F.lit("")), r"(?<=[.!?])\s+"), F.trim), lambda v: v != "")
    words = lambda v: F.regexp_extract_all(F.lower(v), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    with_words = F.flatten(F.transform("r", lambda t: F.transform(sentences(t), lambda v, no: F.struct(t["rank"].alias("rank"), no.alias("no"), v.alias("s"), words(v).alias("w")))))
    overlap = lambda v: F.array_max(F.transform("kw", lambda kw: F.size(F.filter(kw, lambda k: F.array_contains(v["w"], k)))))
    counted = F.filter(F.transform(with_words, lambda v: F.struct((-overlap(v)).alias("o"), F.length(v["s"]).alias("n"), v["rank"].alias("rank"), v["no"].alias("no"), v["s"].alias("s"))), lambda v: v["o"] < 0)
    best = F.slice(F.array_distinct(F.transform(F.array_sort(counted), lambda v: v["s"])), 1, 3)
    first = F.transform(F.filter("r", lambda t: (t["rank"] <= 2) & (F.coalesce(t["text"], F.lit("")) != "")), lambda t: t["text"])
    x = x.select("question_id", best.alias("a"), first.alias("f")).where(F.size("f") > 0)
    full = x.select("question_id", tx.clean(F.array_join(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("f")), " ")).alias("t"))
    return full.select("question_id", F.when(F.length("t") > most, F.concat(F.regexp_replace(F.substring("t", 1, most - 3), r" [^ ]*$", ""), F.lit("..."))).otherwise(F.col("t")).alias("answer"))
