"""Ranking of chunks for batches of questions: BM25, gated lexical retrieval, cosine, fusion, reranking and baselines.

Questions and chunks carry a scope (the document asked about); a question is ranked against the chunks of its scope, and
term statistics are those of the scope. Chunks are (scope, chunk_id, page_number, text), questions (question_id, scope,
question). Pairs of questions and chunks are scored in blocks (``ranking``); the words of ``important_words`` meet in a join
over ``PARTS`` hashed parts of each scope, with the questions' few terms in every part. Ties go to the earlier page, then the smaller chunk_id. Null texts and questions count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import ranking
from leafmill.sources.tables import settle

PARTS = 8
#: Chunks of one scope that are numbered by one sort, about.
NUMBERED_AT_ONCE = 5_000
#: Questions of one scope that lie together, about.
TOGETHER = 2_000


def top(df: DataFrame, k: int, *order: Column, by: str = "question_id") -> DataFrame:
    """The first ``k`` rows of each question under ``order``, with their rank; none for k <= 0."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _order() -> tuple[Column, ...]:
    return F.desc(F.round("score", 9)), F.asc("page_number"), F.asc("chunk_id")


def _part(column: str = "chunk_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def _in_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def bm25(questions: DataFrame, chunks: DataFrame, k: int = 3, padded: bool = False, matched: bool = False, copies: bool = False) -> DataFrame:
    """(question_id, chunk_id, page_number, score, rank). ``padded``: chunks without a common term follow with 0, in
    order, where fewer than ``k`` have one; questions without terms have no rows either way. ``matched`` adds what
    ``rerank`` needs of the texts, as ``ranking.top_of_blocks`` counts it. ``copies``: chunks may have copies of a row, which
    are one where the blocks are ranked: no texts move before."""
    words = lambda c: F.array_join(tx.plain_terms(c), " ").alias("words")
    made = [words("text"), F.xxhash64("text").alias("digest")]  # equal words and an equal hash: the same text
    c = chunks.select("scope", "chunk_id", "page_number", *["text"] if copies else made[:1])
    found = ranking.top_of_blocks(questions.select("question_id", "scope", words("question")), c, k, bm25=True, padded=padded, matched=matched, made=made if copies else None)
    return top(found, k, *_order())


def together(found: DataFrame, questions: DataFrame) -> DataFrame:
    """``found`` with ``near``: one number for the questions of a scope, several for those of a scope of more than TOGETHER.
    Questions of a scope find the same chunks; rows spread by ``near`` have copies of a text behind one another, which then
    take next to no room in a shuffle."""
    own = questions.groupBy("question_id").agg(F.min("scope").alias("scope"))
    parts = F.ceil(F.col("_n") / F.lit(TOGETHER)).cast("int")
    many = F.broadcast(own.groupBy("scope").agg(F.count("*").alias("_n")).where(F.col("_n") > TOGETHER).select("scope", parts.alias("_parts")))  # at most one row for each TOGETHER questions
    near = F.hash("scope", F.pmod(F.xxhash64("question_id"), F.coalesce("_parts", F.lit(1))))
    return found.join(own.join(many, "scope", "left").select("question_id", near.alias("near")), "question_id", "left")


def query_terms(questions: DataFrame) -> DataFrame:
    """(question_id, scope, tokens, ignored, phrases): meaningful terms, left out ones (sorted, distinct), 4- to 2-grams."""
    raw = F.filter(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit(tx.TERM), F.lit(0)), lambda x: F.length(x) > 1)
    grams = lambda n: F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - n + 1)), lambda i: F.slice("tokens", i, n))).otherwise(F.array().cast("array<array<string>>"))
    own = questions.withColumn("tokens", tx.terms("question")).withColumn("raw", raw)
    phrases = F.transform(F.filter(F.concat(grams(4), grams(3), grams(2)), lambda g: ~F.exists(g, lambda t: t.rlike(r"^\d+$"))), lambda g: F.array_join(g, " "))
    return own.select("question_id", "scope", "tokens", F.array_sort(F.array_distinct(F.array_except("raw", "tokens"))).alias("ignored"), phrases.alias("phrases"))


# Terms that stand for others.
SYNONYMS = {
    "learn": ["learning", "learned"],
    "learning": ["learn"],
    "memory": ["memories"],
    "memories": ["memory"],
    "explain": ["explanation"],
    "explanation": ["explain"],
    "summarize": ["summary"],
    "summary": ["summarize", "main", "idea", "key"],
    "main": ["summary", "key"],
    "idea": ["summary", "point"],
    "ideas": ["summary", "idea", "points"],
    "chapter": ["section", "topic"],
    "section": ["chapter", "topic"],
    "topic": ["chapter", "section"],
}


def expanded_terms(text: Column | str) -> Column:
    """A text's distinct terms with their synonyms, singular or plural, and numbers as words or digits; sorted."""
    own = F.array_distinct(tx.terms(text))
    known = F.create_map(*[c for t, others in SYNONYMS.items() for c in (F.lit(t), F.array(*[F.lit(o) for o in others]))])
    plural = lambda t: F.when(~t.endswith("s") & (F.length(t) > 2), F.concat(t, F.lit("s"))).when(t.endswith("s") & (F.length(t) == 3), F.concat(t, F.lit("s")))
    more = F.flatten(F.transform(own, lambda t: F.concat(F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")), tx.variants(t), F.array_compact(F.array(plural(t))))))
    return F.array_sort(F.array_distinct(F.concat(own, more)))


def gated(questions: DataFrame, chunks: DataFrame, k: int = 5, least_score: float = 1.0, diagnostics: bool = False) -> DataFrame:
    """(question_id, chunk_id, page_number, score, matched, passed_by, rank): lexical retrieval with an acceptance gate.

    Chunks have section_number, section_title and key_concepts too. Terms count with their variants. A chunk scores
    BM25 over its text, 2.5 and 2 idf for a term in title and concepts, three times the idf of each word of a phrase it
    has, 10 for being the section asked for and 8 for the chapter. It needs ``least_score`` and evidence: the number
    asked for, or a phrase, or two matched tokens, or else 2.5 times as much score, unless the question has one token.

    Pairs are scored and gated in blocks where the chunks lie. ``diagnostics`` adds unmatched and ignored terms, phrases met
    and threshold.
    """
    threshold = max(1.0, float(least_score))
    joined = lambda x: F.array_join(x, " ")
    c = chunks.select("scope", "chunk_id", "page_number", F.coalesce("section_number", F.lit(0)).alias("section_number"), *[joined(tx.terms(x)).alias(n) for x, n in (("text", "nt"), ("section_title", "ni"), (F.array_join(F.coalesce("key_concepts", F.array().cast("array<string>")), " "), "nc"))])
    q = query_terms(questions).select("question_id", "scope", joined("tokens").alias("tokens"))
    refs = questions.select("question_id", joined(tx.numbered_references("question", ["section", "sections"], ["חלק"]).cast("array<string>")).alias("sections"), joined(tx.numbered_references("question", ["chapter", "chapters", "ch"], ["פרק", "פרקים"]).cast("array<string>")).alias("chapters"))
    x = top(ranking.gated_of_blocks(q.join(refs, "question_id"), c, k, threshold), k, *_order())
    if diagnostics:
        x = x.join(query_terms(questions).select("question_id", joined("ignored").alias("ignored")), "question_id")
    more = ["unmatched", "ignored", "phrases", F.lit(threshold).alias("threshold")] if diagnostics else []
    return x.select("question_id", "chunk_id", "page_number", F.round("score", 4).alias("score"), "matched", "passed_by", "rank", *more)


def minmax(df: DataFrame, by: str = "question_id", score: str = "score", to: str = "norm") -> DataFrame:
    """Scores scaled to 0..1 within each question; all 1 where they are alike."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    near = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return df.withColumn(to, F.when(near, 1.0).otherwise((F.col(score) - lo) / F.nullif(hi - lo, F.lit(0.0))))


def fuse(semantic: DataFrame, keyword: DataFrame, k: int = 3, weight: float = 0.65) -> DataFrame:
    """(question_id, chunk_id, page_number, score, rank): full outer join of two rankings' scaled scores, weighted."""
    a = minmax(semantic).select("question_id", "chunk_id", F.col("page_number").alias("pa"), F.col("norm").alias("a"), F.col("rank").alias("ra"))
    b = minmax(keyword).select("question_id", "chunk_id", F.col("page_number").alias("pb"), F.col("norm").alias("b"), F.col("rank").alias("rb"))
    both = a.join(b, ["question_id", "chunk_id"], "full_outer").select("question_id", "chunk_id", F.coalesce("pa", "pb").alias("page_number"), (weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))).alias("score"), "ra", "rb")
    return top(both, k, F.desc(F.round("score", 9)), F.asc_nulls_last("ra"), F.asc_nulls_last("rb")).select("question_id", "chunk_id", "page_number", "score", "rank")


def rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Candidates' scores plus the share of the question's distinct terms that the chunk has. Texts are joined only where
    the candidates come without ``matched``."""
    if "matched" in candidates.columns:
        asked = questions.select("question_id", F.size(F.array_distinct(tx.plain_terms("question"))).alias("n"))
        x = candidates.drop("rank").join(asked, "question_id").withColumn("m", F.explode("matched"))
        x = x.withColumn("score", F.col("score") + F.when(F.col("n") == 0, 0.0).otherwise(F.col("m") / F.col("n")))
        return top(x, k, *_order()).select("question_id", "chunk_id", "page_number", "score", "rank")
    q = questions.select("question_id", "scope", F.array_distinct(tx.plain_terms("question")).alias("qt"))
    x = candidates.drop("rank").join(q, "question_id").join(chunks.select("scope", "chunk_id", F.array_distinct(tx.plain_terms("text")).alias("ct")), ["scope", "chunk_id"])
    cover = F.when(F.size("qt") == 0, 0.0).otherwise(F.size(F.array_intersect("qt", "ct")) / F.size("qt"))
    return top(x.withColumn("score", F.col("score") + cover), k, *_order()).select("question_id", "chunk_id", "page_number", "score", "rank")


def keyword_overlap(questions: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Baseline: common white-space words; chunks without any are left out."""
    words = lambda c: F.array_join(F.array_distinct(tx.blank_words(c)), " ").alias("words")
    found = ranking.top_of_blocks(questions.select("question_id", "scope", words("question")), chunks.select("scope", "chunk_id", "page_number", words("text")), k, bm25=False)
    return top(found, k, *_order())


def document_order(questions: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Baseline: the first chunks of the document."""
    first = top(chunks.select("scope", "chunk_id", "page_number"), k, F.asc("page_number"), F.asc("chunk_id"), by="scope")
    return questions.select("question_id", "scope").join(first, "scope").select("question_id", "chunk_id", "page_number", "rank")


def random_order(questions: DataFrame, chunks: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Baseline: ``k`` chunks drawn from all of the scope by a seed and the question, so repeated runs agree.

    Chunks are numbered within their scope by the counts of hashed parts, so that no scope is sorted as a whole. Each
    question draws distinct numbers by Floyd's method (of 0..i the next, or i itself if that was drawn) in an order of
    hashes; all sets of ``k`` chunks are equally likely. Scopes of up to ``k`` chunks are drawn whole.
    """
    if k <= 0:
        return questions.join(chunks, "scope").select("question_id", "chunk_id", "page_number", F.lit(0).alias("rank")).where("false")
    size = chunks.groupBy("scope").agg(F.count("*").alias("n"))
    spread = chunks.select("scope", "chunk_id", "page_number").join(size, "scope").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / F.lit(NUMBERED_AT_ONCE))))
    before = spread.groupBy("scope", "part").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy("scope").orderBy("part")) - F.col("m")).drop("m")
    numbered = spread.withColumn("r", F.row_number().over(Window.partitionBy("scope", "part").orderBy("chunk_id", "page_number"))).join(before, ["scope", "part"])
    numbered = numbered.select("scope", "chunk_id", "page_number", (F.col("before") + F.col("r") - 1).alias("number"))

    def draw(have: Column, i: Column) -> Column:
        at = F.pmod(F.xxhash64(F.lit(seed), "question_id", i), i + 1)
        return F.concat(have, F.array(F.when(F.array_contains(have, at), i).otherwise(at)))

    drawn = F.aggregate(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("n") - k), F.col("n") - 1), F.array().cast("array<bigint>"), draw)
    asked = questions.select("question_id", "scope").join(size, "scope").select("question_id", "scope", F.explode(drawn).alias("number"))
    x = asked.join(numbered, ["scope", "number"])
    return top(x, k, F.xxhash64("question_id", "number", F.lit(seed + 1)), F.asc("number")).select("question_id", "chunk_id", "page_number", "rank")


BASELINES = ["keyword_overlap", "important_words", "document_order", "random"]


def baselines(questions: DataFrame, chunks: DataFrame, k: int = 3, names: list[str] | None = None) -> DataFrame:
    """(method, question_id, chunk_id, page_number, rank): the baselines side by side."""
    run = {"keyword_overlap": keyword_overlap, "important_words": important_words, "document_order": document_order, "random": random_order}
    parts = [run[n](questions, chunks, k).select(F.lit(n).alias("method"), "question_id", "chunk_id", "page_number", "rank") for n in names or BASELINES]
    return reduce(DataFrame.unionByName, parts)


def overview(chunks: DataFrame, k: int = 8) -> DataFrame:
    """(scope, chunk_id, section_number, rank): the first chunk with text of each section, then all from the start again
    up to ``k``, so that a chunk may come twice."""
    full = chunks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("scope", "chunk_id", "page_number", F.coalesce("section_number", F.lit(0)).alias("section_number"))
    order = [F.asc("page_number"), F.asc("chunk_id")]
    firsts = full.withColumn("r", F.row_number().over(Window.partitionBy("scope", "section_number").orderBy(*order))).where("r = 1").drop("r").withColumn("turn", F.lit(0))
    again = top(full, k, *order, by="scope").drop("rank").withColumn("turn", F.lit(1))
    return top(firsts.unionByName(again), k, F.asc("turn"), *order, by="scope").select("scope", "chunk_id", "section_number", "rank")


def metadata_filter(df: DataFrame, wanted: dict, equality_only: bool = False) -> DataFrame:
    """Rows that have every wanted value: of source_id or page_number, else of the metadata. A list asks for any of its
    values, unless ``equality_only``; a missing key has no value."""
    conditions = []
    for key, value in wanted.items():
        c = F.col(key) if key in ("source_id", "page_number") else F.try_element_at("metadata", F.lit(key))
        many = isinstance(value, (list, tuple, set)) and not equality_only
        conditions.append(F.coalesce(c.isin([str(v) for v in value] if key not in ("page_number",) else list(value)) if many else c == F.lit(value), F.lit(False)))
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


#: Chunks of one scope that are ranked by vectors at once.
SCOPE_BLOCK = 5_000
#: Questions of a block that are multiplied at once.
QUESTIONS_AT_ONCE = 1_000


def semantic(questions: DataFrame, chunks: DataFrame, k: int = 3, dim: int = 128) -> DataFrame:
    """(question_id, chunk_id, page_number, score, rank): cosine of mock embeddings within each scope.

    A scope's chunks are ranked in hashed blocks of about ``SCOPE_BLOCK`` as matrix products with the scope's questions.
    """
    import numpy as np
    import pandas as pd

    from leafmill.operators.vectors import mock_vector

    n = chunks.groupBy("scope").agg(F.count("*").alias("n"))
    large = F.broadcast(n.where(F.col("n") > SCOPE_BLOCK).select("scope", F.ceil(F.col("n") / F.lit(SCOPE_BLOCK)).alias("blocks")))  # at most one row for each SCOPE_BLOCK chunks
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    # texts are moved and not vectors, which are several times as large
    c = chunks.where("scope is not null").join(large, "scope", "left").select("scope", "chunk_id", "page_number", "text", F.pmod(F.xxhash64("chunk_id"), blocks).alias("block"))
    q = questions.where((F.trim("question") != "") & F.col("scope").isNotNull()).join(large, "scope", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    embed = lambda texts: np.stack([mock_vector(t if isinstance(t, str) else "", dim) for t in texts])

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"question_id": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype=object), "page_number": pd.Series(dtype="int32"), "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values(["page_number", "chunk_id"])
        own, parts = embed(right["text"]), [empty]
        for i in range(0, len(left), QUESTIONS_AT_ONCE):
            asked = left.iloc[i : i + QUESTIONS_AT_ONCE]
            s = np.round(embed(asked["question"]) @ own.T, 12)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            parts.append(pd.DataFrame({"question_id": np.repeat(asked["question_id"].to_numpy(), at.shape[1]), "chunk_id": right["chunk_id"].to_numpy()[at.ravel()], "page_number": right["page_number"].to_numpy()[at.ravel()], "score": np.take_along_axis(s, at, axis=1).ravel()}))
        return pd.concat(parts[1:])

    found = q.select("scope", "block", "question_id", "question").groupBy("scope", "block").cogroup(c.groupBy("scope", "block")).applyInPandas(rank, "question_id bigint, chunk_id string, page_number int, score double")
    return top(found, k, *_order())


#: Length of the character grams by which words are sought inside texts.
INSIDE_GRAM = 5


def important_words(questions: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """Baseline: the question's words of more than four characters, repeated ones too, that stand anywhere in the chunk's
    text, inside other words as well; chunks without any are left out.

    Such a word's first five characters are a gram of the text, so an equi-join on grams finds all candidates.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    gram = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - INSIDE_GRAM + 1)), lambda i: F.substring(text, i, F.lit(INSIDE_GRAM)))
    asked = questions.select("question_id", "scope", F.explode(F.filter(tx.blank_words("question"), lambda w: F.length(w) > 4)).alias("w")).groupBy("question_id", "scope", "w").agg(F.count("*").alias("times"))
    wanted = asked.select("scope", "w").distinct().withColumn("g", F.substring("w", 1, INSIDE_GRAM))
    post = chunks.select("scope", "chunk_id", "page_number", F.explode(F.array_distinct(gram)).alias("g")).withColumn("part", _part())
    maybe = post.join(_in_parts(wanted), ["scope", "part", "g"]).select("scope", "chunk_id", "page_number", "w")
    inside = maybe.join(chunks.select("scope", "chunk_id", text.alias("t")), ["scope", "chunk_id"]).where(F.col("t").contains(F.col("w"))).select("scope", "chunk_id", "page_number", "w").distinct()
    hit = inside.join(asked, ["scope", "w"]).groupBy("question_id", "chunk_id", "page_number").agg(F.sum("times").cast("double").alias("score"))
    return top(hit, k, *_order())


def backfilled(ranked: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 5, enough: int = 3) -> DataFrame:
    """(question_id, chunk_id, page_number, rank): where one or two chunks were found, the first chunk of each further
    page follows up to ``k``; questions with none or with ``enough`` stay as they are."""
    ranked = settle(ranked.select("question_id", "chunk_id", "page_number", "rank"))  # it is read three times
    n = ranked.groupBy("question_id").agg(F.count("*").alias("n")).where(F.col("n") < enough)
    first = chunks.withColumn("r", F.row_number().over(Window.partitionBy("scope", "page_number").orderBy("chunk_id"))).where("r = 1")
    first = top(first.select("scope", "chunk_id", "page_number"), k + enough, F.asc("page_number"), by="scope").drop("rank")
    more = questions.join(n, "question_id").select("question_id", "scope").join(first, "scope").join(ranked.select("question_id", "page_number").distinct(), ["question_id", "page_number"], "left_anti")
    both = ranked.select("question_id", "chunk_id", "page_number", "rank").unionByName(more.select("question_id", "chunk_id", "page_number", F.lit(1 << 20).alias("rank")))
    return top(both.withColumnRenamed("rank", "was"), k, F.asc("was"), F.asc("page_number"), F.asc("chunk_id")).drop("was")


MODES = ("semantic", "bm25", "hybrid")


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 3, mode: str = "semantic", wanted: dict | None = None, reranked: bool = False) -> DataFrame:
    """(question_id, chunk_id, page_number, score, rank) by mode. A filter on source_id, page_number or metadata applies
    before the ranking in semantic mode and to its result in the others. Blank questions have no rows.

    ``chunks`` has source_id and metadata too where there is a filter. Unknown modes and k <= 0 are an error.
    """
    if mode not in MODES or k <= 0:
        raise ValueError(f"mode must be one of {MODES} and k positive")
    asked = questions.where(F.trim("question") != "")
    if mode == "semantic":
        return semantic(asked, metadata_filter(chunks, wanted) if wanted else chunks, k)
    if mode == "bm25":
        found = bm25(asked, chunks, k, padded=True)
    else:
        inner = 4 * k if reranked else k
        found = fuse(semantic(asked, chunks, 4 * inner), bm25(asked, chunks, 4 * inner, padded=True), inner)
        found = rerank(found, asked, chunks, k) if reranked else found
    return found.join(metadata_filter(chunks, wanted, equality_only=True).select("chunk_id").distinct(), "chunk_id", "left_semi").select("question_id", "chunk_id", "page_number", "score", "rank") if wanted else found


def diagnostics(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, results): what was found for each question as one array in order."""
    x = ranked.join(chunks.select("chunk_id", F.col("scope").alias("source"), "text"), "chunk_id")
    return x.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source", "page_number", "score", "text"))).alias("results"))
