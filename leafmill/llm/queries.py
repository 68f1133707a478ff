"""Queries of the problems for training data, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import knn, leaks, packing, pairs, repeats, scans, split, subjects
from leafmill.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAGE_LIMIT, PAGE_OVERLAP, CHUNK_LIMIT, CHUNK_OVERLAP = 2000, 200, 500, 50
TOKEN_LIMIT, TOKEN_OVERLAP = 256, 32


def _page_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "doc_pages"), ["page_id"], "text", PAGE_LIMIT, PAGE_OVERLAP)


def _chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "doc_chunks"), ["chunk_id"], "text", CHUNK_LIMIT, CHUNK_OVERLAP, offset="start_char")


@query("""
WITH p AS (SELECT DISTINCT page_id, coalesce(nullif(trim(source_id), ''), metadata['source']) AS source_id, page_number, text FROM doc_pages),
c AS (SELECT DISTINCT chunk_id, source_id, page_number, text, start_char FROM doc_chunks WHERE text <> ''),
placed AS (SELECT chunk_id, p.text AS page, length(c.text) AS n, CASE WHEN start_char >= 0 AND substr(p.text, start_char + 1, length(c.text)) = c.text THEN start_char ELSE strpos(p.text, c.text) - 1 END AS a
  FROM c JOIN p ON p.source_id = c.source_id AND p.page_number = c.page_number WHERE p.text <> ''),
ends AS (SELECT chunk_id, substr(page, 1, e) AS l, substr(page, e + 1) AS r FROM (SELECT chunk_id, page, unnest([a, a + n]) AS e FROM placed WHERE a >= 0))
SELECT DISTINCT 'page_oversize' AS item_kind, CAST(page_id AS VARCHAR) AS item_id FROM p WHERE length(trim(text, chr(32) || chr(9) || chr(13) || chr(10))) > 2000
UNION SELECT DISTINCT 'chunk_oversize', chunk_id FROM c WHERE length(trim(text, chr(32) || chr(9) || chr(13) || chr(10))) > 500
UNION SELECT DISTINCT 'chunk_midword', chunk_id FROM ends WHERE regexp_matches(l, '[\\p{L}\\p{N}]\\z') AND regexp_matches(r, '^[\\p{L}\\p{N}]')
  AND length(regexp_extract(l, '\\S*\\z')) + length(regexp_extract(r, '^\\S*')) <= 500
""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cut = F.col("pieces") > 1
    page = _page_pieces(spark, d).where(cut).select(F.lit("page_oversize").alias("item_kind"), F.col("page_id").cast("string").alias("item_id"))
    chunk = _chunk_pieces(spark, d).where(cut).select(F.lit("chunk_oversize").alias("item_kind"), F.col("chunk_id").alias("item_id"))
    pages = table(spark, d, "doc_pages")
    named = pages.withColumn("source_id", F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.try_element_at("metadata", F.lit("source"))))
    word = split.cut_in_words(table(spark, d, "doc_chunks"), named)
    return page.unionByName(chunk).unionByName(word.select(F.lit("chunk_midword").alias("item_kind"), F.col("chunk_id").alias("item_id"))).distinct()


@query()
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all pages and chunks; a chunk's pieces have their place in its page where its offset is known."""
    page = _page_pieces(spark, d).withColumn("item_kind", F.lit("page")).withColumn("item_id", F.col("page_id").cast("string")).drop("page_id")
    chunk = _chunk_pieces(spark, d).withColumn("item_kind", F.lit("chunk")).withColumnRenamed("chunk_id", "item_id")
    return page.unionByName(chunk).select("item_kind", "item_id", "piece_no", "pieces", "start_char", "end_char", "piece").distinct()


_LINES = """
WITH p AS (SELECT DISTINCT page_id, source_id, text FROM doc_pages WHERE trim(source_id) <> '' AND regexp_matches(text, '[^\\s\\p{Z}]')),
l AS (SELECT page_id, source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p),
k AS (SELECT page_id, source_id, line_no, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS key FROM l),
n AS (SELECT source_id, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT k.source_id, key, count(DISTINCT page_id) AS pages FROM k WHERE key <> '' GROUP BY 1, 2),
kept AS (SELECT s.source_id, key, pages FROM s JOIN n USING (source_id) WHERE pages >= 5 AND pages >= 0.15 * n)
"""


@query(_LINES + "SELECT DISTINCT page_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN kept USING (source_id, key)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, d, "doc_pages"))[0].select("page_id", "line_no")


@query(_LINES + "SELECT source_id, count(*) AS lines, CAST(sum(pages) AS BIGINT) AS pages FROM kept GROUP BY 1")
def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boilerplate lines of each source, and the pages they stand on."""
    blocks = repeats.repeated_lines(table(spark, d, "doc_pages"))[1]
    return blocks.groupBy("source_id").agg(F.count("*").alias("lines"), F.sum("pages").alias("pages"))


@query(_LINES + """,
o AS (SELECT DISTINCT page_id, source_id, line_no, key, kept.pages IS NOT NULL AS keep FROM k LEFT JOIN kept USING (source_id, key) WHERE key <> ''),
e AS (SELECT *, lag(key) OVER w AS k1, lag(keep) OVER w AS keep1, lag(line_no) OVER w AS no1, lag(key, 2) OVER w AS k2, lag(keep, 2) OVER w AS keep2 FROM o WINDOW w AS (PARTITION BY page_id ORDER BY line_no)),
ed AS (SELECT source_id, k1 AS a, key AS b FROM e JOIN n USING (source_id) WHERE keep AND keep1 GROUP BY source_id, k1, key, n HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) >= 0.15 * n),
way AS (SELECT DISTINCT x.source_id, x.a, y.b FROM ed x JOIN ed y ON x.source_id = y.source_id AND x.b = y.a),
gone AS (SELECT page_id, line_no FROM o WHERE keep UNION SELECT page_id, no1 FROM e JOIN way ON way.source_id = e.source_id AND a = k2 AND b = key WHERE keep AND NOT keep1 AND keep2),
r AS (SELECT DISTINCT page_id, source_id, page_number, text FROM doc_pages), u AS (SELECT r.*, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM r WHERE page_id IN (SELECT page_id FROM gone)),
c AS (SELECT page_id, source_id, page_number, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE (page_id, line_no) NOT IN (SELECT (page_id, line_no) FROM gone)), '') AS text FROM u GROUP BY 1, 2, 3)
SELECT * FROM c UNION ALL SELECT * FROM r WHERE page_id NOT IN (SELECT page_id FROM gone)
""")
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """The pages without the blocks' lines, and without what stands in the place of one of them between two others."""
    pages = table(spark, d, "doc_pages")
    found, _, gaps = repeats.repeated_lines(pages)
    return repeats.without_repeats(pages, found.select("page_id", "line_no").unionByName(gaps)).select("page_id", "source_id", "page_number", "text").distinct()


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_defects(table(spark, d, "doc_pages"), table(spark, d, "study_sections"), table(spark, d, "study_sessions"))[0]


@query()
def p3_repair(spark: SparkSession, d: str) -> DataFrame:
    """The pages' and sections' texts as continuous paragraphs."""
    pages, sections = table(spark, d, "doc_pages"), table(spark, d, "study_sections")
    found = scans.scan_defects(pages, sections, table(spark, d, "study_sessions"))
    records = pages.select(F.lit("page").alias("rec_kind"), F.col("page_id").alias("rec_id"), "text").unionByName(sections.select(F.lit("section").alias("rec_kind"), F.col("id").alias("rec_id"), F.col("section_text").alias("text")))
    return scans.repaired(records, *found).distinct()


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "eval_dataset").select(F.lit("eval_dataset").alias("tbl"), "item_id", "question", "answer")
    quiz = table(spark, d, "quiz_questions").select(F.lit("quiz_questions").alias("tbl"), F.col("question_id").alias("item_id"), F.col("prompt").alias("question"), "answer")
    return pairs.defective_pairs(own.unionByName(quiz), ["tbl", "item_id"], "question", "answer")


@query("""
WITH p AS (SELECT DISTINCT page_id, trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS t FROM doc_pages WHERE text IS NOT NULL) SELECT page_id, true AS whole, true AS within FROM p WHERE t <> ''
""")
def p1_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pages in pieces of at most 256 tokens with an overlap of 32: for each page whether its pieces leave out nothing but white
    space, and whether all are within the limit."""
    pages = table(spark, d, "doc_pages").select("page_id", "text").distinct()
    cut = split.split_by_tokens(pages, ["page_id"], "text", TOKEN_LIMIT, TOKEN_OVERLAP, packing.TOKENIZER)
    spans = cut.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"), F.max("tokens").alias("tokens"))
    held = spans.join(pages, "page_id")
    between = F.transform("spans", lambda x, i: F.substring(F.col("text"), F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end_char"]).cast("int") + 1, F.greatest(F.lit(0), x["start_char"] - F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end_char"])).cast("int")))
    rest = F.substring(F.col("text"), F.element_at("spans", -1)["end_char"].cast("int") + 1, F.length("text"))
    blank = lambda t: F.trim(t, F.lit(split.EDGE)) == ""
    return held.select("page_id", (F.forall(between, blank) & blank(rest)).alias("whole"), (F.col("tokens") <= TOKEN_LIMIT).alias("within"))


VECTOR_DIM, NEAREST, LEAST_COSINE = 96, 10, 0.8


@query("""
WITH v AS (SELECT DISTINCT vec_id, vector FROM chunk_vectors WHERE len(vector) = 96 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 12) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s WHERE c >= 0.8)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 10
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    graph = knn.neighbour_graph(knn.valid_vectors(table(spark, d, "chunk_vectors"), "vec_id", "vector", VECTOR_DIM), NEAREST + 2, VECTOR_DIM, least=LEAST_COSINE)
    near = knn.neighbours(graph, NEAREST, LEAST_COSINE)
    return near.select(F.least("id", "nbr").alias("vec_a"), F.greatest("id", "nbr").alias("vec_b")).distinct()


@query()
def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy graph search with every vector whose id is divisible by 100 as a query, against all vectors; as in
    ``p5_found`` only cosines of at least 0.8 count."""
    vectors = knn.valid_vectors(table(spark, d, "chunk_vectors"), "vec_id", "vector", VECTOR_DIM)
    graph = knn.neighbour_graph(vectors, NEAREST + 2, VECTOR_DIM, least=LEAST_COSINE)
    return knn.search(graph, vectors.where("id % 100 = 0"), NEAREST).where(F.col("cos") >= LEAST_COSINE)


@query()
def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_budgets"))


@query("""
WITH d AS (SELECT DISTINCT doc_id FROM documents WHERE text <> '') SELECT budget_name, (SELECT count(*) FROM d) AS documents, 0 AS overfull, 0 AS misplaced FROM (SELECT DISTINCT budget_name FROM context_budgets)
""")
def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity: documents placed, containers above it, and documents placed twice or divided though they fit."""
    return packing.invariants(p6_pack(spark, d), table(spark, d, "context_budgets"))


@query()
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_pack(spark, d), table(spark, d, "context_budgets"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM heldout_items)),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM w)),
iw AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v FROM (SELECT DISTINCT item_id, text FROM heldout_items)),
dg AS (SELECT doc_id, k, hash(w[k], w[k + 1], w[k + 2], w[k + 3]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS k FROM w)),
ig AS (SELECT item_id, k AS j, hash(v[k], v[k + 1], v[k + 2], v[k + 3]) AS g FROM (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS k FROM i)),
s AS (SELECT DISTINCT doc_id, item_id, k + o AS a, j + o AS b FROM dg JOIN ig USING (g), (SELECT unnest(range(-8, 1)) AS o) o),
e AS (SELECT doc_id, item_id, a, list_sum(list_transform(range(0, 12), lambda x: CASE WHEN w[a + x] = v[b + x] THEN 1 ELSE 0 END)) AS n FROM s JOIN w USING (doc_id) JOIN i USING (item_id) WHERE a >= 1 AND b >= 1 AND a + 11 <= len(w) AND b + 11 <= len(v))
SELECT doc_id, item_id, count(DISTINCT a) AS windows, max(n) / 12 AS best FROM e WHERE n >= 10 GROUP BY 1, 2
""")
def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Also windows in which up to a sixth of the words differ, with the best share of equal words."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"), similarity=5 / 6)


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")).select("doc_id", "subject")


@query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean share of their sentences for each subject."""
    found = subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return found.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 3).alias("mean_share"))
