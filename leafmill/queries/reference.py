"""Queries of the study and retrieval operators over the domain tables, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import assemble, chunking, evaluate, planner, progress, quiz, retrieval, vectors
from leafmill.queries import query
from leafmill.sources.tables import table


def pages(spark: SparkSession, d: str) -> DataFrame:
    """DocumentPage rows, each page_id once; the scope is the source_id, else the name in the metadata, else null."""
    name = F.nullif(F.trim(F.try_element_at("metadata", F.lit("source"))), F.lit(""))
    scope = F.when(F.trim("source_id") != "", F.col("source_id")).otherwise(name)
    return table(spark, d, "doc_pages").select("page_id", scope.alias("scope"), "page_number", "text").distinct()


def named_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which the document is known."""
    return pages(spark, d).where(F.col("scope").isNotNull())


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """DocumentChunk rows as they stand, with their copies."""
    return table(spark, d, "doc_chunks").select(F.col("source_id").alias("scope"), "chunk_id", "page_number", "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """DocumentChunk rows, each once, spread by chunk_id: joins on it move no texts again."""
    return chunk_rows(spark, d).repartition("chunk_id").distinct()


def question_rows(spark: SparkSession, d: str) -> DataFrame:
    """Questions as they stand, with their copies."""
    return table(spark, d, "eval_dataset").where("pdf is not null and question is not null").select(F.col("item_id").alias("question_id"), F.col("pdf").alias("scope"), "question", "answer", "source_text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return question_rows(spark, d).distinct()


def _ranked_rows(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(questions, BM25 of the chunks), both with ``near``: nothing but the chunks' words moves for it."""
    rows = question_rows(spark, d)
    q = rows.repartition("question_id").distinct()
    return retrieval.together(q, rows), retrieval.together(retrieval.bm25(q, chunk_rows(spark, d), k, copies=True), rows)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "study_sessions").distinct()


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "study_sections").distinct()


def saves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "section_progress").distinct()


_SCOPE = "CASE WHEN trim(source_id) <> '' THEN source_id ELSE nullif(trim(metadata['source']), '') END"
_PP = f"p AS (SELECT DISTINCT page_id, {_SCOPE} AS scope, page_number, text FROM doc_pages)"
_P = f"p AS (SELECT DISTINCT page_id, {_SCOPE} AS scope, page_number, text FROM doc_pages WHERE {_SCOPE} IS NOT NULL)"
_C = "c AS (SELECT DISTINCT source_id AS scope, chunk_id, page_number, text FROM doc_chunks)"
_Q = "q AS (SELECT DISTINCT item_id AS question_id, pdf AS scope, question, answer, source_text FROM eval_dataset WHERE pdf IS NOT NULL AND question IS NOT NULL)"
_NAMED = f"np AS (SELECT DISTINCT page_id, {_SCOPE} AS scope, page_number, text FROM doc_pages WHERE {_SCOPE} IS NOT NULL)"
_TIDY = "trim(regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s]+'), lambda x: x <> '')"
_LIST = lambda words: "['" + "', '".join(words) + "']"
_LEVEL = "CASE WHEN n = 0 THEN 'Easy' WHEN chars / n > 6.3 OR long / n > 0.22 THEN 'Hard' WHEN chars / n > 5.2 OR long / n > 0.12 THEN 'Medium' ELSE 'Easy' END"
_TIMES = "CASE level WHEN 'Easy' THEN 1.0 WHEN 'Hard' THEN 1.45 ELSE 1.2 END"
_SIZES = f"len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, len(list_filter(w, lambda x: length(x) >= 10)) AS long"


# --- scans and text


@query(f"WITH {_P} SELECT scope, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')) AS readable FROM p GROUP BY scope")
def readable_pages(spark: SparkSession, d: str) -> DataFrame:
    return named_pages(spark, d).groupBy("scope").agg(F.count("*").alias("pages"), F.count_if(tx.clean("text") != "").alias("readable"))


@query("SELECT DISTINCT page_id, page_number FROM doc_pages WHERE metadata['loader'] IN ('ocr', 'pypdf') AND metadata['lang'] = 'en'")
def metadata_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.metadata_filter(table(spark, d, "doc_pages"), {"loader": ["ocr", "pypdf"], "lang": "en"}).select("page_id", "page_number").distinct()


@query(f"""WITH {_PP}, w AS (SELECT page_id, text, {_WORDS} AS w FROM p), z AS (SELECT page_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+')) AS words, {_SIZES} FROM w),
l AS (SELECT *, {_LEVEL} AS level FROM z) SELECT page_id, CAST(words AS INTEGER) AS words, level, CASE WHEN words = 0 THEN 0.0 ELSE round(greatest(1.0, words / 160 * {_TIMES}), 6) END AS workload FROM l""")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", tx.word_count("text").alias("words"), tx.difficulty("text").alias("level"), F.round(planner.page_workload("text"), 6).alias("workload"))


@query(f"""WITH {_PP}, s AS (SELECT page_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM p)
SELECT page_id, count(*) AS sentences FROM (SELECT page_id, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s FROM s) WHERE s <> '' AND len(string_split(s, ' ')) >= 5 GROUP BY page_id""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", F.size(tx.sentences("text", 5, at_lines=True)).cast("bigint").alias("sentences")).where("sentences > 0")


@query(f"""WITH {_PP}, l AS (SELECT page_id, unnest(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1:8]) AS l FROM p),
k AS (SELECT page_id, trim(regexp_replace(l, '[\\s\\p{{Z}}]+', ' ', 'g')) AS l FROM l), u AS (SELECT *, regexp_replace(l, '[^A-Za-z]', '', 'g') AS letters, len(string_split(l, ' ')) AS n FROM k WHERE l <> '' AND length(l) <= 100)
SELECT DISTINCT page_id FROM u WHERE regexp_matches(l, '(?i)^(chapter|lecture|section|unit|module)\\s+\\d+(\\.\\d+)?\\b') OR regexp_matches(l, '^\\d+(\\.\\d+)+\\s+[A-Za-z\\x{{0590}}-\\x{{05FF}}]') OR regexp_matches(l, '^\\d+\\s+[A-Z][A-Za-z][^\\n]{{2,80}}$')
OR (n BETWEEN 2 AND 9 AND length(letters) > 0 AND length(regexp_replace(letters, '[^A-Z]', '', 'g')) / length(letters) > 0.65)""")
def heading_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where(tx.starts_with_heading("text")).select("page_id")


_STOPS = ", ".join(f"'{w}'" for w in tx.CONCEPT_STOP_WORDS)
_CONCEPTS = f"""words AS (SELECT id, unnest(regexp_extract_all(coalesce(section_text, ''), '[A-Za-z\\x{{0590}}-\\x{{05FF}}][A-Za-z0-9\\x{{0590}}-\\x{{05FF}}-]{{4,}}')) AS word, generate_subscripts(regexp_extract_all(coalesce(section_text, ''), '[A-Za-z\\x{{0590}}-\\x{{05FF}}][A-Za-z0-9\\x{{0590}}-\\x{{05FF}}-]{{4,}}'), 1) AS pos FROM (SELECT DISTINCT id, section_text FROM study_sections)),
k AS (SELECT id, trim(lower(word), '-') AS k, word, pos FROM words), g AS (SELECT id, k, count(*) AS n, min(pos) AS pos, arg_min(word, pos) AS word FROM k WHERE length(k) >= 5 AND k NOT IN ({_STOPS}) GROUP BY id, k),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS rank, trim(word, ' -:') AS t FROM g)"""


@query(f"WITH {_CONCEPTS} SELECT id, CAST(rank AS INTEGER) AS rank, CASE WHEN upper(t) = t AND lower(t) <> t THEN t ELSE upper(substr(t, 1, 1)) || lower(substr(t, 2)) END AS concept, n FROM r WHERE rank <= 5")
def key_concepts(spark: SparkSession, d: str) -> DataFrame:
    return planner.key_concepts(sections(spark, d).select("id", "section_text"), "id", "section_text")


@query(f"""WITH {_CONCEPTS}, m AS (SELECT id, count(*) AS c FROM r WHERE rank <= 5 GROUP BY id), w AS (SELECT id, text, {_WORDS} AS w FROM (SELECT DISTINCT id, section_text AS text FROM study_sections)),
z AS (SELECT id, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+')) AS words, {_SIZES} FROM w), l AS (SELECT z.*, coalesce(c, 0) AS c, {_LEVEL} AS level FROM z LEFT JOIN m USING (id)),
e AS (SELECT *, (words / 160 + c * 2 + (CASE WHEN c = 0 THEN 3 WHEN c >= 3 THEN 4 ELSE c + 1 END) * 1.5 + 5) * {_TIMES} AS score FROM l)
SELECT id, CAST(words AS INTEGER) AS words, level, CAST(greatest(8, least(CASE WHEN words >= 5000 THEN 90 ELSE 60 END, greatest(5, round_even(score / 5, 0) * 5))) AS INTEGER) AS minutes FROM e""")
def section_estimates(spark: SparkSession, d: str) -> DataFrame:
    own = sections(spark, d).select("id", "section_text")
    n = planner.key_concepts(own, "id", "section_text").groupBy("id").agg(F.count("*").alias("c"))
    x = own.select("id", tx.word_count("section_text").alias("words"), tx.difficulty("section_text").alias("level")).join(n, "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    aims = F.when(F.col("c") == 0, 3).when(F.col("c") >= 3, 4).otherwise(F.col("c") + 1)
    return x.select("id", "words", "level", planner.estimate(F.col("words"), F.col("c"), aims, F.col("level")).alias("minutes"))


@query(f"""WITH {_P}, w AS (SELECT scope, text, {_WORDS} AS w FROM p), z AS (SELECT scope, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+')) AS words, regexp_matches(text, '[^\\s\\p{{Z}}]') AS filled, {_SIZES} FROM w),
t AS (SELECT scope, sum(words) AS words, sum(n) AS n, sum(chars) AS chars, sum(long) AS long, count(*) FILTER (WHERE filled) AS pages FROM z GROUP BY scope),
k AS (SELECT scope, trim(lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{0590}}-\\x{{05FF}}][A-Za-z0-9\\x{{0590}}-\\x{{05FF}}-]{{4,}}'))), '-') AS k FROM p),
c AS (SELECT scope, count(DISTINCT k) AS c FROM k WHERE length(k) >= 5 AND k NOT IN ({_STOPS}) GROUP BY scope), l AS (SELECT t.*, coalesce(c, 0) AS c, {_LEVEL} AS level FROM t LEFT JOIN c USING (scope)),
e AS (SELECT scope, pages, CASE WHEN words <= 0 THEN 0.0 ELSE (words / 160 + least(10, c) * 2 + greatest(1, ceil(words / 1500)) * 5) * {_TIMES} END AS minutes FROM l)
SELECT scope, round(minutes, 4) AS minutes, CAST(greatest(1, least(CASE WHEN pages > 0 THEN least(15, pages) ELSE 15 END, CASE WHEN minutes <= 0 THEN 1 ELSE ceil(minutes / 30) END)) AS INTEGER) AS sessions FROM e""")
def suggested_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions for each document, from sums over its pages: its text is never put together."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    p = named_pages(spark, d)
    z = p.select("scope", tx.word_count("text").alias("words"), F.size(words).alias("n"), F.aggregate(words, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), F.size(F.filter(words, lambda x: F.length(x) >= 10)).alias("long"), (tx.clean("text") != "").cast("int").alias("full"))
    t = z.groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("words", "n", "chars", "long")], F.sum("full").alias("pages"))
    keys = p.select("scope", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tx.CONCEPT), F.lit(0)), lambda w: F.regexp_replace(F.lower(w), "^-+|-+$", "")))).alias("k")).where((F.length("k") >= 5) & ~F.col("k").isin(tx.CONCEPT_STOP_WORDS)).distinct()
    t = t.join(keys.groupBy("scope").agg(F.count("*").alias("c")), "scope", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    mean, share = F.col("chars") / F.nullif("n", F.lit(0)), F.col("long") / F.nullif("n", F.lit(0))
    level = F.when(F.col("n") == 0, "Easy").when((mean > 6.3) | (share > 0.22), "Hard").when((mean > 5.2) | (share > 0.12), "Medium").otherwise("Easy")
    minutes = planner.total_workload(F.col("words"), F.col("c"), level)
    return t.select("scope", F.round(minutes, 4).alias("minutes"), planner.suggested_sessions(minutes, F.col("pages")).alias("sessions"))


@query("""WITH s AS (SELECT DISTINCT id, section_text FROM study_sections), t AS (SELECT id, trim(regexp_replace(coalesce(section_text, ''), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM s),
p AS (SELECT id, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '' AND len(string_split(x, ' ')) >= 6 AND NOT regexp_matches(lower(x), 'what i have outlined|the content above|this content|source page|uploaded pdf|chunk|metadata') AND NOT regexp_matches(lower(x), '(^|[^\\p{L}\\p{N}_])(chunk|metadata|source|file name)($|[^\\p{L}\\p{N}_])')) AS p FROM t),
j AS (SELECT id, array_to_string(p[1:3], ' ') AS j FROM p) SELECT id, CASE WHEN length(j) > 420 THEN rtrim(substr(j, 1, 420)) || '...' ELSE j END AS summary FROM j""")
def section_summaries(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("id", planner.summary("section_text").alias("summary"))


@query()
def study_plan(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan(named_pages(spark, d), pages_per_section=5)


@query("SELECT CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS fault WHERE false")
def plan_faults(spark: SparkSession, d: str) -> DataFrame:
    """Plans with overlapping, backward or missing pages: there are none."""
    return planner.coverage_faults(study_plan(spark, d), named_pages(spark, d))


# --- chunks


_NORMAL = "trim(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), chr(32) || chr(9) || chr(10) || chr(160))"


@query(f"""WITH p AS (SELECT DISTINCT page_id, text FROM doc_pages), n AS (SELECT page_id, {_NORMAL} AS t FROM p),
s AS (SELECT page_id, t, unnest(range(0, greatest(1, CAST(ceil(greatest(0, length(t) - 500) / 450) AS BIGINT) * 450 + 1), 450)) AS a FROM n WHERE t <> '')
SELECT page_id, CAST(a AS INTEGER) AS start_char, CAST(least(a + 500, length(t)) AS INTEGER) AS end_char, trim(substr(t, a + 1, 500), chr(32) || chr(9) || chr(10) || chr(160)) AS text FROM s WHERE trim(substr(t, a + 1, 500), chr(32) || chr(9) || chr(10) || chr(160)) <> ''""")
def chunk_sliding(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "doc_pages").select("page_id", "text").distinct()
    return p.select("page_id", F.explode(chunking.spans("sliding_window", "text", 500, 50)).alias("c")).select("page_id", "c.start_char", "c.end_char", "c.text")


_TRIMMED = "chr(32) || chr(9) || chr(10) || chr(160)"


def _last(sep: str, keep: int) -> str:
    """SQL for the place after the last ``sep`` of a window past 60 % of its size, or null."""
    size = f"length(sub) - strpos(reverse(sub), reverse({sep})) - length({sep}) + 1"
    return f"CASE WHEN strpos(reverse(sub), reverse({sep})) > 0 AND {size} > 300 THEN {size} + {keep} END"


_RECURSIVE = f"""WITH RECURSIVE p AS (SELECT DISTINCT page_id, text FROM doc_pages), n AS (SELECT page_id, {_NORMAL} AS t FROM p),
w AS (SELECT page_id, t, 0 AS no, CAST(0 AS BIGINT) AS a, CAST(CASE WHEN length(t) <= 500 THEN length(t) ELSE coalesce({{c0}}, {{c1}}, {{c2}}, {{c3}}, 500) END AS BIGINT) AS b FROM (SELECT page_id, t, substr(t, 1, 500) AS sub FROM n WHERE t <> '')
UNION ALL SELECT page_id, t, no + 1, a, CAST(CASE WHEN length(t) - a <= 500 THEN length(t) ELSE a + coalesce({{c0}}, {{c1}}, {{c2}}, {{c3}}, 500) END AS BIGINT) FROM (SELECT page_id, t, no, greatest(b - 50, a + 1) AS a, substr(t, CAST(greatest(b - 50, a + 1) AS BIGINT) + 1, 500) AS sub FROM w WHERE b < length(t)))
SELECT page_id, CAST(no AS INTEGER) AS chunk_no, trim(substr(t, a + 1, b - a), {_TRIMMED}) AS text, CAST(a + length(substr(t, a + 1, b - a)) - length(ltrim(substr(t, a + 1, b - a), {_TRIMMED})) AS INTEGER) AS start_char FROM w WHERE trim(substr(t, a + 1, b - a), {_TRIMMED}) <> ''""".format(c0=_last("chr(10) || chr(10)", 0), c1=_last("chr(10)", 0), c2=_last("'. '", 1), c3=_last("' '", 0))
_TOKEN = f"""WITH p AS (SELECT DISTINCT page_id, text FROM doc_pages), n AS (SELECT page_id, regexp_extract_all({_NORMAL}, '[^\\s\\p{{Z}}]+[\\s\\p{{Z}}]*') AS w FROM p),
k AS (SELECT page_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 125) / 113) AS BIGINT)))) AS k FROM n WHERE len(w) > 0)
SELECT page_id, CAST(k AS INTEGER) AS chunk_no, rtrim(array_to_string(w[k * 113 + 1:k * 113 + 125], ''), {_TRIMMED}) AS text, CAST(coalesce(list_sum(list_transform(w[1:k * 113], lambda x: length(x))), 0) AS INTEGER) AS start_char FROM k"""


def _chunked(strategy: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "doc_pages").select("page_id", "text").distinct()
        size, overlap = (1400, 160) if strategy == "collapsed" else (500, 50)
        return p.select("page_id", F.posexplode(chunking.spans(strategy, "text", size, overlap)).alias("chunk_no", "c")).select("page_id", "chunk_no", "c.text", "c.start_char", *([] if sql else ["c.end_char", "c.parent_id"]))

    run.__name__ = f"chunk_{strategy}"
    query(sql)(run)


_chunked("recursive", _RECURSIVE)
_chunked("token", _TOKEN)
_COLLAPSED = """WITH RECURSIVE p AS (SELECT DISTINCT page_id, text FROM doc_pages), n AS (SELECT page_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM p),
w AS (SELECT page_id, t, 0 AS no, CAST(0 AS BIGINT) AS a, CAST(CASE WHEN length(t) <= 1400 THEN length(t) WHEN length(sub) - strpos(reverse(sub), ' ') > 700 AND strpos(reverse(sub), ' ') > 0 THEN length(sub) - strpos(reverse(sub), ' ') + 1 ELSE 1400 END AS BIGINT) AS b FROM (SELECT page_id, t, substr(t, 1, 1400) AS sub FROM n WHERE t <> '')
UNION ALL SELECT page_id, t, no + 1, a, CAST(CASE WHEN length(t) - a <= 1400 THEN length(t) WHEN length(sub) - strpos(reverse(sub), ' ') > 700 AND strpos(reverse(sub), ' ') > 0 THEN a + length(sub) - strpos(reverse(sub), ' ') + 1 ELSE a + 1400 END AS BIGINT) FROM (SELECT page_id, t, no, greatest(b - 160, a + 1) AS a, substr(t, CAST(greatest(b - 160, a + 1) AS BIGINT) + 1, 1400) AS sub FROM w WHERE b < length(t)))
SELECT page_id, CAST(no AS INTEGER) AS chunk_no, trim(substr(t, a + 1, b - a)) AS text, CAST(a AS INTEGER) AS start_char FROM w WHERE trim(substr(t, a + 1, b - a)) <> ''"""
_chunked("collapsed", _COLLAPSED)
for _name in ("sentence", "parent_child", "semantic"):
    _chunked(_name)


# --- joins by page


@query("""WITH t AS (SELECT DISTINCT id AS session_id, filename FROM study_sessions), s AS (SELECT DISTINCT session_id, section_number, title, start_page, end_page FROM study_sections),
p AS (SELECT DISTINCT CASE WHEN trim(source_id) <> '' THEN source_id ELSE nullif(trim(metadata['source']), '') END AS source_id, page_number FROM doc_pages), j AS (SELECT t.session_id, p.page_number, min(s.section_number) AS section_number FROM t JOIN p ON p.source_id = t.filename LEFT JOIN s ON s.session_id = t.session_id AND p.page_number BETWEEN s.start_page AND s.end_page GROUP BY 1, 2)
SELECT session_id, CAST(coalesce(section_number, 0) AS INTEGER) AS section_number, count(*) AS pages FROM j GROUP BY 1, 2""")
def pages_by_section(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each session's document by the first section that holds them, 0 for none."""
    own = sessions(spark, d).select(F.col("id").alias("session_id"), F.col("filename").alias("source")).distinct()
    p = named_pages(spark, d).select(F.col("scope").alias("source"), "page_number").distinct().join(own, "source").select(F.col("session_id").alias("scope"), "page_number")
    s = sections(spark, d).select(F.col("session_id").alias("scope"), "section_number", "title", "start_page", "end_page")
    return assemble.page_sections(p, s).groupBy(F.col("scope").alias("session_id"), "section_number").agg(F.count("*").alias("pages"))


@query(f"""WITH {_P}, t AS (SELECT DISTINCT id AS session_id, filename FROM study_sessions), s AS (SELECT DISTINCT id, session_id, start_page, end_page FROM study_sections),
x AS (SELECT page_id, scope, page_number, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM p)
SELECT s.id, md5(string_agg(x.text, chr(10) || chr(10) ORDER BY x.page_number, x.page_id)) AS digest, count(*) AS pages FROM s JOIN t USING (session_id) JOIN x ON x.scope = t.filename AND x.page_number BETWEEN s.start_page AND s.end_page WHERE x.text <> '' GROUP BY s.id""")
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    own = sections(spark, d).select("id", "session_id", "start_page", "end_page").join(sessions(spark, d).select(F.col("id").alias("session_id"), F.col("filename").alias("scope")).distinct(), "session_id").distinct()
    p = named_pages(spark, d)
    joined = assemble.texts_in_range(own, p, "id")
    n = own.select("id", "scope", F.explode(F.sequence("start_page", "end_page")).alias("page_number")).join(p.where(F.regexp_replace("text", r"^\s+|\s+\z", "") != ""), ["scope", "page_number"]).groupBy("id").agg(F.count("*").alias("pages"))
    return joined.select("id", F.md5(F.encode("text", "UTF-8")).alias("digest")).join(n, "id")


_NUMBERS = "one two three four five six seven eight nine ten".split()
_DOC_SECTIONS = """first_s AS (SELECT filename AS scope, min(id) AS session_id FROM study_sessions GROUP BY 1), ds AS (SELECT DISTINCT scope, section_number, title, start_page, end_page FROM study_sections JOIN first_s USING (session_id))"""
_CHAPTERS = f"""{_NAMED}, {_DOC_SECTIONS}, ln AS (SELECT scope, page_number, rtrim(substr(regexp_split_to_array({_TIDY}, '(\\.)\\s{{{{2,}}}}')[1], 1, 140)) AS line FROM np),
lh AS (SELECT *, regexp_matches(line, '(?i)^(chapter|ch\\.?)\\s+(\\d{{{{1,2}}}}|{'|'.join(_NUMBERS)})([^\\p{{{{L}}}}\\p{{{{N}}}}_]|$)') AS named, regexp_matches(line, '^(\\d{{{{1,2}}}})(\\.\\s+|\\s+)[A-Z][A-Za-z].{{{{2,80}}}}') AS plain FROM ln WHERE line <> '' AND len(regexp_split_to_array(line, '\\s+')) <= 14),
hd AS (SELECT scope, page_number, CASE WHEN named THEN lower(regexp_extract(line, '(?i)^(chapter|ch\\.?)\\s+(\\d{{{{1,2}}}}|{'|'.join(_NUMBERS)})', 2)) ELSE regexp_extract(line, '^(\\d{{{{1,2}}}})', 1) END AS token,
regexp_replace(CASE WHEN named THEN regexp_extract(line, '(?i)^(chapter|ch\\.?)\\s+(\\d{{{{1,2}}}}|{'|'.join(_NUMBERS)})[:.\\-\\s]*(.*)', 3) ELSE regexp_extract(line, '^(\\d{{{{1,2}}}})(\\.\\s+|\\s+)([A-Z][A-Za-z].{{{{2,80}}}})', 3) END, '^[ :\\-]+|[ :\\-]+$', '', 'g') AS suffix FROM lh WHERE named OR plain),
hn AS (SELECT scope, page_number, coalesce(try_cast(token AS INTEGER), list_position([{', '.join(f"'{w}'" for w in _NUMBERS)}], token)) AS n, suffix FROM hd), ht AS (SELECT scope, page_number, n, 'Chapter ' || n || CASE WHEN suffix <> '' THEN ': ' || suffix ELSE '' END AS title FROM hn),
hf AS (SELECT scope, n, min(struct_pack(a := page_number, b := title)) AS f FROM ht GROUP BY 1, 2), la AS (SELECT scope, max(page_number) AS last FROM np WHERE {_TIDY} <> '' GROUP BY 1),
hc AS (SELECT scope, n AS chapter_number, f.b AS title, f.a AS start_page, greatest(f.a, coalesce(lead(f.a) OVER (PARTITION BY scope ORDER BY f.a, n) - 1, last)) AS end_page, 'heading' AS matched_by FROM hf JOIN la USING (scope)),
sf AS (SELECT scope, section_number AS chapter_number, min(struct_pack(a := start_page, b := end_page, c := coalesce(nullif(title, ''), 'Section ' || section_number))) AS s FROM ds WHERE section_number <> 0 AND scope NOT IN (SELECT scope FROM hc) GROUP BY 1, 2),
ch AS (SELECT * FROM hc UNION ALL SELECT scope, chapter_number, s.c, s.a, s.b, 'section_fallback' FROM sf)"""


def _document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each document's first session."""
    first = sessions(spark, d).groupBy(F.col("filename").alias("scope")).agg(F.min("id").alias("session_id"))
    return sections(spark, d).join(first, "session_id").select("scope", "section_number", "title", "start_page", "end_page").distinct()


@query("WITH " + _CHAPTERS.format() + " SELECT scope, CAST(chapter_number AS INTEGER) AS chapter_number, title, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page, matched_by FROM ch")
def chapter_index(spark: SparkSession, d: str) -> DataFrame:
    return assemble.document_chapters(named_pages(spark, d), _document_sections(spark, d))


@query()
def chapter_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the chapters that questions name."""
    asked = questions(spark, d).select(F.col("question_id").alias("request_id"), "scope", tx.numbered_references("question", ["chapter", "chapters", "ch"], ["פרק", "פרקים"]).alias("chapters")).where(F.size("chapters") > 0)
    return assemble.chapter_contexts(asked, chapter_index(spark, d), named_pages(spark, d))


# --- ranking


_BM25 = f"""WITH {_C}, {_Q}, l AS (SELECT scope, chunk_id, page_number, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM c),
st AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM l GROUP BY scope), po AS (SELECT scope, chunk_id, page_number, len, term, count(*) AS tf FROM (SELECT scope, chunk_id, page_number, len(t) AS len, unnest(t) AS term FROM l) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM po GROUP BY ALL), qt AS (SELECT question_id, scope, term, count(*) AS qf FROM (SELECT question_id, scope, unnest(list_transform(regexp_extract_all(question, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM q) GROUP BY ALL),
sc AS (SELECT question_id, chunk_id, page_number, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))) AS score FROM qt JOIN po USING (scope, term) JOIN df USING (scope, term) JOIN st USING (scope) GROUP BY 1, 2, 3),
bm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS rank FROM sc)"""


@query(_BM25 + " SELECT question_id, chunk_id, page_number, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 3")
def bm25_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(questions(spark, d), chunks(spark, d)).withColumn("score", F.round("score", 6))


@query(_BM25 + """, al AS (SELECT question_id, chunk_id, page_number, coalesce(score, 0.0) AS score FROM (SELECT q.question_id, c.chunk_id, c.page_number FROM q JOIN c USING (scope) WHERE regexp_matches(question, '[A-Za-z0-9_]')) LEFT JOIN sc USING (question_id, chunk_id, page_number))
SELECT question_id, chunk_id, page_number, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS rank FROM al) WHERE rank <= 5""")
def bm25_zero_padded(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(questions(spark, d), chunks(spark, d), 5, padded=True).withColumn("score", F.round("score", 6))


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the section of their document's first session. What a page has of its section is found without texts
    and joined to them once."""
    first = table(spark, d, "study_sessions").groupBy(F.col("filename").alias("scope")).agg(F.min("id").alias("session_id"))
    s = table(spark, d, "study_sections").select("session_id", "section_number", "title", "start_page", "end_page", "key_concepts").distinct().join(first, "session_id").drop("session_id")
    own = assemble.page_sections(table(spark, d, "doc_chunks").select(F.col("source_id").alias("scope"), "page_number").distinct(), s)
    concepts = s.groupBy("scope", "section_number").agg(F.min("key_concepts").alias("key_concepts"))
    own = own.join(concepts, ["scope", "section_number"], "left").select(F.col("scope").alias("_s"), F.col("page_number").alias("_p"), "section_number", "section_title", F.from_json("key_concepts", "array<string>").alias("key_concepts"))
    return chunks(spark, d).join(own, F.col("scope").eqNullSafe(F.col("_s")) & F.col("page_number").eqNullSafe(F.col("_p"))).drop("_s", "_p")


def _chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without their texts."""
    return table(spark, d, "doc_chunks").select(F.col("source_id").alias("scope"), "chunk_id", "page_number").distinct()


_NUMBER = "(?:\\d{1,2}|" + "|".join(_NUMBERS) + ")"


def _terms(x: str) -> str:
    """SQL for the meaningful terms of a text."""
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9\\x{{0590}}-\\x{{05FF}}]+'), lambda y: length(y) > 1 AND NOT list_contains({_LIST(tx.STOP_WORDS)}, y))"


def _variants(t: str) -> str:
    """SQL for a term and its variants."""
    plain = f"regexp_replace({t}, '^0+([0-9])', '\\1')"
    return f"list_filter([{t}, CASE WHEN suffix({t}, 's') AND length({t}) > 3 THEN {t}[:-2] WHEN length({t}) > 2 AND regexp_matches({t}, '^[a-z]+$') THEN {t} || 's' END, CASE WHEN list_contains({_LIST(_NUMBERS)}, {plain}) THEN CAST(list_position({_LIST(_NUMBERS)}, {plain}) AS VARCHAR) WHEN try_cast({plain} AS INTEGER) BETWEEN 1 AND 10 AND regexp_matches({plain}, '^[0-9]+$') THEN {_LIST(_NUMBERS)}[CAST(try_cast({plain} AS INTEGER) AS BIGINT)] END], lambda z: z IS NOT NULL)"


def _references(name: str, labels: list[str], hebrew: list[str]) -> str:
    """SQL for a table of (question_id, n): the numbers that questions name after a label."""
    value = lambda x: f"coalesce(try_cast({x} AS INTEGER), CAST(list_position({_LIST(_NUMBERS)}, {x}) AS INTEGER))"
    pattern = "\\b(" + "|".join(labels) + ")\\.?\\s+(" + _NUMBER + ")(?:\\s*(?:-|to|and|&)\\s*(" + _NUMBER + "))?"
    more = "(" + "|".join(hebrew) + ")\\s+(\\d{1,2})(?:\\s*(?:-|ו|and)\\s*(\\d{1,2}))?"
    return f"""{name}_p AS (SELECT question_id, unnest(regexp_extract_all(lower(question), '{pattern}', 2)) AS a, unnest(regexp_extract_all(lower(question), '{pattern}', 3)) AS b FROM q UNION ALL SELECT question_id, unnest(regexp_extract_all(lower(question), '{more}', 2)), unnest(regexp_extract_all(lower(question), '{more}', 3)) FROM q),
{name}_v AS (SELECT question_id, {value('a')} AS a, {value('b')} AS b FROM {name}_p), {name} AS (SELECT DISTINCT question_id, n FROM (SELECT question_id, unnest(CASE WHEN b > a AND b - a <= 10 THEN generate_series(a, b) ELSE [a, b] END) AS n FROM {name}_v) WHERE n BETWEEN 1 AND 99)"""


_GATED = f"""WITH {_C}, {_Q}, first_s AS (SELECT filename AS scope, min(id) AS session_id FROM study_sessions GROUP BY 1), ts AS (SELECT DISTINCT scope, section_number, title, start_page, end_page, key_concepts FROM study_sections JOIN first_s USING (session_id)),
tc AS (SELECT c.scope, c.chunk_id, c.page_number, c.text, min(struct_pack(n := section_number, t := title)) FILTER (WHERE section_number IS NOT NULL) AS s FROM c LEFT JOIN ts ON ts.scope = c.scope AND c.page_number BETWEEN start_page AND end_page GROUP BY 1, 2, 3, 4),
kc AS (SELECT scope, section_number, min(key_concepts) AS key_concepts FROM ts GROUP BY 1, 2),
ix AS (SELECT tc.scope, chunk_id, page_number, coalesce(s.n, 0) AS section_number, {_terms('text')} AS nt, {_terms("CASE WHEN s IS NULL THEN 'Unassigned section' ELSE s.t END")} AS ni, {_terms("array_to_string(coalesce(TRY_CAST(json_transform(key_concepts, '[\"VARCHAR\"]') AS VARCHAR[]), []), ' ')")} AS nc FROM tc LEFT JOIN kc ON kc.scope = tc.scope AND kc.section_number = coalesce(s.n, 0)),
vx AS (SELECT *, flatten(list_transform(nt, lambda t: {_variants('t')})) AS tt, flatten(list_transform(ni, lambda t: {_variants('t')})) AS tits, flatten(list_transform(nc, lambda t: {_variants('t')})) AS co FROM ix),
st AS (SELECT scope, count(*) AS n, avg(greatest(1, len(tt))) AS avgdl FROM vx GROUP BY 1),
po AS (SELECT scope, chunk_id, page_number, len, term, count(*) FILTER (WHERE f = 't') AS t, count(*) FILTER (WHERE f = 'i') AS i, count(*) FILTER (WHERE f = 'c') AS c FROM (SELECT scope, chunk_id, page_number, len(tt) AS len, unnest(tt) AS term, 't' AS f FROM vx UNION ALL SELECT scope, chunk_id, page_number, len(tt), unnest(tits), 'i' FROM vx UNION ALL SELECT scope, chunk_id, page_number, len(tt), unnest(co), 'c' FROM vx) GROUP BY ALL),
df AS (SELECT scope, term, greatest(0.1, ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf, avgdl FROM (SELECT scope, term, count(*) AS df FROM po GROUP BY ALL) JOIN st USING (scope)),
qt AS (SELECT question_id, scope, {_terms('question')} AS tokens FROM q), tk AS (SELECT question_id, scope, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM qt),
av AS (SELECT question_id, scope, term, list(DISTINCT pos) AS poss FROM (SELECT question_id, scope, pos, unnest({_variants('token')}) AS term FROM tk) GROUP BY ALL),
ba AS (SELECT question_id, scope, chunk_id, page_number, sum(idf * (t * 2.5 / (t + 1.5 * (0.25 + 0.75 * greatest(1, len) / greatest(1.0, avgdl))) + CASE WHEN i > 0 THEN 2.5 ELSE 0 END + CASE WHEN c > 0 THEN 2.0 ELSE 0 END)) AS base, flatten(list(poss)) AS poss FROM av JOIN po USING (scope, term) JOIN df USING (scope, term) GROUP BY 1, 2, 3, 4),
{_references('sx', ['section', 'sections'], ['חלק'])}, {_references('cx', ['chapter', 'chapters', 'ch'], ['פרק', 'פרקים'])},
nb AS (SELECT DISTINCT question_id, q.scope, chunk_id, page_number FROM (SELECT * FROM sx UNION SELECT * FROM cx) r JOIN q USING (question_id) JOIN qt USING (question_id) JOIN ix ON ix.scope = q.scope AND ix.section_number = n WHERE len(tokens) > 0),
al AS (SELECT question_id, scope, chunk_id, page_number, sum(base) AS base, flatten(list(poss)) AS poss FROM (SELECT * FROM ba UNION ALL SELECT question_id, scope, chunk_id, page_number, 0.0, [] FROM nb) GROUP BY 1, 2, 3, 4),
ph AS (SELECT question_id, unnest(list_filter(flatten(list_transform([4, 3, 2], lambda k: list_transform(range(1, greatest(1, len(tokens) - k + 2)), lambda p: tokens[p:p + k - 1]))), lambda g: len(list_filter(g, lambda t: regexp_matches(t, '^[0-9]+$'))) = 0)) AS g FROM qt),
fp AS (SELECT al.question_id, al.chunk_id, list(g) AS found, sum(list_sum(list_transform(g, lambda t: 0.0)) ) AS zero FROM al JOIN ph USING (question_id) JOIN ix ON ix.scope = al.scope AND ix.chunk_id = al.chunk_id WHERE contains(' ' || array_to_string(nt, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') OR contains(' ' || array_to_string(ni, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') OR contains(' ' || array_to_string(nc, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') GROUP BY 1, 2),
fw AS (SELECT question_id, chunk_id, flatten(found) AS words, len(found) AS phrases FROM fp), fb AS (SELECT w.question_id, w.chunk_id, 3.0 * sum(coalesce(idf, 0.1)) AS bonus FROM (SELECT question_id, chunk_id, unnest(words) AS term FROM fw) w JOIN q USING (question_id) LEFT JOIN df ON df.scope = q.scope AND df.term = w.term GROUP BY 1, 2),
sc AS (SELECT al.*, tokens, coalesce(words, []) AS words, coalesce(phrases, 0) AS phrases, section_number > 0 AND section_number IN (SELECT n FROM sx WHERE sx.question_id = al.question_id) AS by_section, section_number > 0 AND section_number IN (SELECT n FROM cx WHERE cx.question_id = al.question_id) AS by_chapter, base + coalesce(bonus, 0.0) AS plain FROM al JOIN qt USING (question_id) JOIN ix ON ix.scope = al.scope AND ix.chunk_id = al.chunk_id LEFT JOIN fw ON fw.question_id = al.question_id AND fw.chunk_id = al.chunk_id LEFT JOIN fb ON fb.question_id = al.question_id AND fb.chunk_id = al.chunk_id),
sd AS (SELECT *, plain + CASE WHEN by_section THEN 10.0 ELSE 0 END + CASE WHEN by_chapter THEN 8.0 ELSE 0 END AS score, list_filter(tokens, lambda t, i: list_contains(poss, i) OR list_contains(words, t)) AS matched FROM sc),
ga AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS rank FROM sd WHERE score >= 1 AND (by_section OR by_chapter OR (len(matched) > 0 AND (phrases > 0 OR len(matched) >= 2 OR CASE WHEN len(tokens) = 1 THEN score >= 1 ELSE score >= 2.5 END))))"""


@query(_GATED + """ SELECT question_id, chunk_id, page_number, round(score, 4) AS score, array_to_string(matched, ' ') AS matched, CASE WHEN phrases > 0 OR by_section OR by_chapter THEN array_to_string(list_filter([CASE WHEN phrases > 0 THEN 'phrase boost' END, CASE WHEN by_section THEN 'requested section number' END, CASE WHEN by_chapter THEN 'requested chapter mapped to section' END], lambda x: x IS NOT NULL), ', ') ELSE 'bm25 score' END AS passed_by, CAST(rank AS INTEGER) AS rank FROM ga WHERE rank <= 5""")
def gated_top5(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.gated(questions(spark, d), _titled(spark, d))


_TITLED = """first_s AS (SELECT filename AS scope, min(id) AS session_id FROM study_sessions GROUP BY 1), ts AS (SELECT DISTINCT scope, section_number, title, start_page, end_page FROM study_sections JOIN first_s USING (session_id)),
tc AS (SELECT c.scope, c.chunk_id, c.page_number, c.text, coalesce(min(section_number), 0) AS section_number FROM c LEFT JOIN ts ON ts.scope = c.scope AND c.page_number BETWEEN start_page AND end_page GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_C}, {_TITLED}, fu AS (SELECT DISTINCT scope, chunk_id, page_number, section_number FROM tc WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
fs AS (SELECT * EXCLUDE (r), 0 AS turn FROM (SELECT *, row_number() OVER (PARTITION BY scope, section_number ORDER BY page_number, chunk_id) AS r FROM fu) WHERE r = 1), ag AS (SELECT * EXCLUDE (r), 1 AS turn FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY page_number, chunk_id) AS r FROM fu) WHERE r <= 8)
SELECT scope, chunk_id, CAST(section_number AS INTEGER) AS section_number, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY turn, page_number, chunk_id) AS rank FROM (SELECT * FROM fs UNION ALL SELECT * FROM ag)) WHERE rank <= 8""")
def overview_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.overview(_titled(spark, d))


@query(f"""WITH {_C}, {_Q}, cw AS (SELECT DISTINCT scope, chunk_id, page_number, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM c),
qw AS (SELECT DISTINCT question_id, scope, unnest(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS w FROM q), s AS (SELECT question_id, chunk_id, page_number, CAST(count(*) AS DOUBLE) AS score FROM qw JOIN cw USING (scope, w) GROUP BY ALL)
SELECT question_id, chunk_id, page_number, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_number, chunk_id) AS rank FROM s) WHERE rank <= 3""")
def keyword_overlap_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_overlap(questions(spark, d), chunks(spark, d))


@query(f"WITH {_C}, {_Q} SELECT question_id, chunk_id, page_number, CAST(rank AS INTEGER) AS rank FROM (SELECT scope, chunk_id, page_number, row_number() OVER (PARTITION BY scope ORDER BY page_number, chunk_id) AS rank FROM c) JOIN q USING (scope) WHERE rank <= 3")
def document_order_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_order(questions(spark, d), chunks(spark, d))


@query()
def random_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.random_order(questions(spark, d), chunks(spark, d))


def _slots(name: str, source: str, key: str, text: str) -> str:
    """SQL for (key, slot, value): the mock embedding's components that are not 0."""
    return f"""{name}_n AS (SELECT {key}, (unicode(ch) + i - 1) % 128 AS slot, count(*) AS n FROM (SELECT {key}, unnest(string_split(substr({text}, 1, 5000), '')) AS ch, generate_subscripts(string_split(substr({text}, 1, 5000), ''), 1) AS i FROM {source} WHERE {text} <> '') GROUP BY ALL),
{name} AS (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM {name}_n)"""


_SEMANTIC = f"""{_slots('ec', 'c', 'chunk_id', 'text')}, {_slots('eq', 'q', 'question_id', 'question')},
cs AS (SELECT q.question_id, c.chunk_id, c.page_number, coalesce(s, 0.0) AS score FROM q JOIN c USING (scope) LEFT JOIN (SELECT q.question_id, c.chunk_id, sum(eq.value * ec.value) AS s FROM eq JOIN q ON q.question_id = eq.question_id JOIN c ON c.scope = q.scope JOIN ec ON ec.chunk_id = c.chunk_id AND ec.slot = eq.slot GROUP BY 1, 2) USING (question_id, chunk_id) WHERE trim(question) <> ''),
sm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS rank FROM cs)"""


@query(f"WITH {_C}, {_Q}, {_SEMANTIC} SELECT question_id, chunk_id, page_number, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sm WHERE rank <= 3")
def semantic_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.semantic(questions(spark, d), chunks(spark, d)).withColumn("score", F.round("score", 6))


@query(_BM25 + f""", {_SEMANTIC}, al AS (SELECT question_id, chunk_id, page_number, coalesce(score, 0.0) AS score FROM (SELECT q.question_id, c.chunk_id, c.page_number FROM q JOIN c USING (scope) WHERE regexp_matches(question, '[A-Za-z0-9_]')) LEFT JOIN sc USING (question_id, chunk_id, page_number)),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS rank FROM al) WHERE rank <= 12), se AS (SELECT * FROM sm WHERE rank <= 12),
kn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-9 * max(abs(score)) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM kw WINDOW w AS (PARTITION BY question_id)),
sn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-9 * max(abs(score)) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM se WINDOW w AS (PARTITION BY question_id)),
fu AS (SELECT question_id, chunk_id, coalesce(s.page_number, k.page_number) AS page_number, 0.65 * coalesce(s.norm, 0.0) + 0.35 * coalesce(k.norm, 0.0) AS score, s.rank AS rs, k.rank AS rk FROM sn s FULL JOIN kn k USING (question_id, chunk_id))
SELECT question_id, chunk_id, page_number, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, rs NULLS LAST, rk NULLS LAST) AS r FROM fu) WHERE r <= 3""")
def hybrid_top3(spark: SparkSession, d: str) -> DataFrame:
    q, c = questions(spark, d), chunks(spark, d)
    return retrieval.fuse(retrieval.semantic(q, c, 12), retrieval.bm25(q, c, 12, padded=True)).withColumn("score", F.round("score", 6))


@query(_BM25 + """, al AS (SELECT question_id, chunk_id, page_number, coalesce(score, 0.0) AS score FROM (SELECT q.question_id, c.chunk_id, c.page_number FROM q JOIN c USING (scope) WHERE regexp_matches(question, '[A-Za-z0-9_]')) LEFT JOIN sc USING (question_id, chunk_id, page_number)),
b12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS r FROM al) WHERE r <= 12),
qd AS (SELECT question_id, list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS qt FROM q),
rr AS (SELECT question_id, chunk_id, b12.page_number, score + len(list_intersect(qt, list_distinct(t))) / len(qt) AS score FROM b12 JOIN qd USING (question_id) JOIN l USING (chunk_id))
SELECT question_id, chunk_id, page_number, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, page_number, chunk_id) AS rank FROM rr) WHERE rank <= 3""")
def reranked_top3(spark: SparkSession, d: str) -> DataFrame:
    q, c = questions(spark, d), chunks(spark, d)
    return retrieval.rerank(retrieval.bm25(q, c, 12, padded=True, matched=True), q, c).withColumn("score", F.round("score", 6))


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12)"


@query(f"""SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 3""")
def cosine_top3(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: ids divisible by 100, against all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.cosine_top(e, e.where("id % 100 = 0"), 3).withColumn("score", F.round("score", 6))


@query(f"""SELECT query, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND b.label = 3) WHERE rank <= 3""")
def cosine_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    """The filter before the ranking: always three of the label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors.cosine_top(e.where("label = 3"), e.where("id % 100 = 0"), 3).withColumn("score", F.round("score", 6))


@query(f"""SELECT query, id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10 AND label = 3""")
def cosine_postfiltered(spark: SparkSession, d: str) -> DataFrame:
    """The filter after the ranking: what the first ten have of the label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors.cosine_top(e, e.where("id % 100 = 0"), 10).join(e.select("id", "label"), "id").where("label = 3").select("query", "id", "rank")


@query(f"WITH {_C}, {_slots('e', 'c', 'chunk_id', 'text')} SELECT chunk_id, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM e")
def mock_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.mock_slots(chunks(spark, d), "chunk_id", "text")
    return e.select("chunk_id", F.posexplode("vector").alias("slot", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query("""WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM doc_chunks), h AS (SELECT DISTINCT 'mock:default:' || sha256(source_text) AS k FROM eval_dataset WHERE source_text IS NOT NULL)
SELECT 'mock:default:' || sha256(text) AS cache_key, text FROM t WHERE 'mock:default:' || sha256(text) NOT IN (SELECT k FROM h)""")
def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Chunks' texts that a cache made from the evaluation's source texts does not have."""
    have = table(spark, d, "eval_dataset").where("source_text is not null").select(vectors.cache_key("mock", "default", F.col("source_text")).alias("cache_key")).distinct()
    return vectors.cache_misses(table(spark, d, "doc_chunks"), have, "mock", "default")


# --- evaluation


_EVAL = _BM25 + """, rt AS (SELECT question_id, k, string_agg(c.text, chr(10) ORDER BY rank) AS context, list(c.text) AS texts FROM bm JOIN c USING (chunk_id), (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY 1, 2),
b AS (SELECT q.question_id, k.k, answer, source_text, coalesce(context, '') AS context, coalesce(texts, []) AS texts FROM q CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) k LEFT JOIN rt ON rt.question_id = q.question_id AND rt.k = k.k),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(context), '\\s+'), lambda x: x <> '')) AS cw, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(answer, '')), '\\s+'), lambda x: x <> '')) AS aw, lower(trim(source_text)) AS src FROM b),
m AS (SELECT question_id, k, CASE WHEN len(cw) = 0 OR len(aw) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(cw, aw)) / (len(cw) + len(aw)) END AS f1, CASE WHEN coalesce(src, '') <> '' AND len(texts) > 0 THEN len(list_filter(texts, lambda x: contains(lower(x), src))) / len(texts) END AS precision, CASE WHEN len(cw) = 0 THEN 0.0 ELSE 1.0 END AS grounding FROM w),
ev AS (SELECT question_id, k, f1, precision, CASE WHEN precision IS NOT NULL THEN CASE WHEN precision > 0 THEN 1.0 ELSE 0.0 END END AS recall, grounding FROM m)"""


def _evaluated(spark: SparkSession, d: str, k: int) -> DataFrame:
    q, c = questions(spark, d), chunks(spark, d)
    return evaluate.evaluate(q, retrieval.bm25(q, c, k), c)


@query(_EVAL + " SELECT question_id, round(f1, 6) AS f1, round(precision, 6) AS precision, recall, grounding FROM ev WHERE k = 3")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, 3).withColumn("f1", F.round("f1", 6)).withColumn("precision", F.round("precision", 6))


def _grid(spark: SparkSession, d: str, labelled: bool = True) -> DataFrame:
    """Averages of three depths; without labels no source texts are moved."""
    q, found = _ranked_rows(spark, d, 5)
    if not labelled:
        q = q.withColumn("source_text", F.lit(None).cast("string"))
    rows = evaluate.evaluate_depths(q, found, chunks(spark, d), [1, 3, 5]).withColumn("config", F.concat(F.lit("top"), F.col("depth").cast("string")))
    return evaluate.averages(rows)


@query(_EVAL + " SELECT 'top' || k AS config, round(avg(f1), 4) AS f1, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(grounding), 4) AS grounding, count(*) AS questions, count(precision) AS labelled FROM ev GROUP BY k")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


@query(_EVAL + " SELECT 'top' || k AS config FROM ev GROUP BY k ORDER BY round(avg(f1), 4) DESC, 1 LIMIT 1")
def best_configuration(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_config(_grid(spark, d, labelled=False), "f1").select("config")


@query()
def best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of the best chunk that answers each question best, and whether it can be relied on."""
    q, c = questions(spark, d), chunks(spark, d)
    x = retrieval.bm25(q, c, 1).join(c.select("chunk_id", "text"), "chunk_id").join(q.select("question_id", "question"), "question_id")
    return x.select("question_id", evaluate.best_sentence("question", "text").alias("sentence"), evaluate.reliable("question", F.array("text")).alias("reliable"))


_STOPWORDS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(f"""WITH {_Q}, r AS (SELECT question_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9\\x{{0590}}-\\x{{05FF}}]+'), lambda x: length(x) > 1) AS r FROM q), t AS (SELECT question_id, r, list_filter(r, lambda x: NOT list_contains([{_STOPWORDS}], x)) AS t FROM r)
SELECT question_id, array_to_string(t, ' ') AS tokens, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: NOT list_contains(t, x)))), ' ') AS ignored FROM t""")
def query_analysis(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.query_terms(questions(spark, d)).select("question_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ignored", " ").alias("ignored"))


@query(f"WITH {_Q}, {_references('cx', ['chapter', 'chapters', 'ch'], ['פרק', 'פרקים'])} SELECT question_id, list(n ORDER BY n) AS chapters FROM cx GROUP BY 1")
def numbered_references(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("question_id", tx.numbered_references("question", ["chapter", "chapters", "ch"], ["פרק", "פרקים"]).alias("chapters")).where(F.size("chapters") > 0)


# --- contexts


@query(_BM25 + """, bl AS (SELECT question_id, rank, '[Page ' || bm.page_number || ']' || chr(10) || trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS b FROM bm JOIN c USING (chunk_id) WHERE rank <= 5),
lf AS (SELECT *, 1200 - (sum(length(b) + 2) OVER (PARTITION BY question_id ORDER BY rank) - (length(b) + 2)) AS room FROM bl)
SELECT question_id, string_agg(CASE WHEN length(b) > room THEN rtrim(regexp_replace(substr(b, 1, CAST(room AS BIGINT)), '(?s) [^ ]*$', '')) ELSE b END, chr(10) || chr(10) ORDER BY rank) AS context FROM lf WHERE room > 0 GROUP BY question_id""")
def question_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of each question in 1,200 characters."""
    _, found = _ranked_rows(spark, d, 5)
    block = F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), tx.clean("text"))
    x = found.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").select("near", "question_id", "rank", block.alias("block")).repartition("near")
    return assemble.budgeted(x, ["near", "question_id"], ["rank"], "block", 1200).drop("near")


@query("""WITH s AS (SELECT DISTINCT * FROM study_sections), x AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, coalesce(TRY_CAST(json_transform(key_concepts, '["VARCHAR"]') AS VARCHAR[]), []) AS k, trim(regexp_replace(coalesce(section_text, ''), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM s),
y AS (SELECT session_id, section_number, 'Section ' || section_number || ': ' || coalesce(nullif(title, ''), 'Section ' || section_number) || chr(10) || CASE WHEN start_page = end_page THEN 'Page: ' || start_page ELSE 'Pages: ' || start_page || '-' || end_page END || CASE WHEN coalesce(trim(summary), '') <> '' THEN chr(10) || 'Summary: ' || trim(summary) ELSE '' END
|| CASE WHEN array_to_string(k[1:8], ', ') <> '' THEN chr(10) || 'Key concepts: ' || array_to_string(k[1:8], ', ') ELSE '' END || CASE WHEN t <> '' THEN chr(10) || 'Representative text: ' || rtrim(substr(t, 1, CAST(greatest(300, least(1200, floor(12000 / n) - 250)) AS BIGINT))) ELSE '' END AS b FROM x),
l AS (SELECT *, 12000 - (sum(length(b) + 2) OVER (PARTITION BY session_id ORDER BY section_number) - (length(b) + 2)) AS room FROM y)
SELECT session_id, string_agg(CASE WHEN length(b) > room THEN rtrim(regexp_replace(substr(b, 1, CAST(room AS BIGINT)), '(?s) [^ ]*$', '')) ELSE b END, chr(10) || chr(10) ORDER BY section_number) AS context FROM l WHERE room > 0 GROUP BY 1""")
def exam_contexts(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    own = s.withColumn("key_concepts", F.from_json("key_concepts", "array<string>")).withColumn("scope", F.col("session_id"))
    texts = s.select("id", F.col("section_text").alias("text"))
    return assemble.budgeted(assemble.exam_blocks(own, texts, "id"), "scope", ["section_number"], "block", 12_000).withColumnRenamed("scope", "session_id")


@query(_BM25 + """, lb AS (SELECT question_id, coalesce(nullif(trim(c.scope), ''), 'document') || ', page ' || bm.page_number AS label, min(rank) AS rank FROM bm JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY 1, 2)
SELECT question_id, string_agg(label, '; ' ORDER BY rank) AS labels FROM lb GROUP BY question_id""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    q, c = questions(spark, d), chunks(spark, d)
    x = retrieval.bm25(q, c, 5).join(_chunk_keys(spark, d).select("chunk_id", "scope").distinct(), "chunk_id").withColumn("label", assemble.citation_label(F.col("scope"), F.create_map().cast("map<string,string>"), F.col("page_number")))
    return evaluate.ordered_distinct(x, "question_id", "label", "rank", "labels").withColumn("labels", F.array_join("labels", "; "))


# --- quizzes


def _quiz(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quiz_questions").distinct()


@query("SELECT DISTINCT question_id FROM quiz_questions WHERE len(options) = 4 AND list_contains(options, answer)")
def valid_questions(spark: SparkSession, d: str) -> DataFrame:
    return _quiz(spark, d).where(quiz.valid_question(F.col("options"), F.col("answer"))).select("question_id")


_GIVEN = """z AS (SELECT DISTINCT question_id, session_id, section_number, options, answer FROM quiz_questions WHERE answer IS NOT NULL), g AS (SELECT *, CASE WHEN len(options) > 0 THEN options[1 + question_id % len(options)] END AS given FROM z),
x AS (SELECT *, lower(trim(regexp_replace(regexp_replace(coalesce(given, ''), '^\\s*[A-Da-d][.)]\\s*', ''), '\\s+', ' ', 'g'))) AS gn, lower(trim(regexp_replace(regexp_replace(answer, '^\\s*[A-Da-d][.)]\\s*', ''), '\\s+', ' ', 'g'))) AS an, lower(regexp_extract(coalesce(given, ''), '^\\s*([A-Da-d])([.)]|\\s*$)', 1)) AS gl, lower(regexp_extract(answer, '^\\s*([A-Da-d])([.)]|\\s*$)', 1)) AS al FROM g),
ok AS (SELECT *, coalesce(given, '') <> '' AND (gn = an OR CASE WHEN gl <> '' AND al <> '' THEN gl = al ELSE al <> '' AND coalesce(lower(trim(regexp_replace(regexp_replace(options[ascii(al) - 96], '^\\s*[A-Da-d][.)]\\s*', ''), '\\s+', ' ', 'g'))) = gn, false) END) AS ok FROM x)"""


@query(f"""WITH {_GIVEN} SELECT session_id, CAST(round_even(count(*) FILTER (WHERE ok) * 100 / count(*), 0) AS INTEGER) AS score, count(*) FILTER (WHERE ok) AS "right", count(*) FILTER (WHERE NOT ok) AS wrong FROM ok GROUP BY session_id""")
def quiz_scores(spark: SparkSession, d: str) -> DataFrame:
    """Grading of made answers: each question with an answer gets the option its id points to, none where it has no options;
    letters count as well as texts."""
    return quiz.graded(graded_answers(spark, d), "session_id").drop("weak_topics")


def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    x = _quiz(spark, d).where(F.col("answer").isNotNull()).select("question_id", "session_id", "section_number", "options", "answer").distinct()
    given = F.when(F.size("options") > 0, F.get("options", F.pmod("question_id", F.size("options")).cast("int")))
    return x.select("session_id", "section_number", F.col("question_id").alias("question_no"), F.col("section_number").cast("string").alias("topic"), quiz.correct(F.lit("multiple_choice"), given, F.col("answer"), F.col("options")).alias("is_correct"))


_GRADING = ", ".join(f"'{w}'" for w in quiz.GRADING_STOP)


@query(f"""WITH z AS (SELECT DISTINCT question_id, session_id, prompt || ' ' || coalesce(answer, '') AS text FROM quiz_questions), s AS (SELECT DISTINCT session_id, section_number, coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(key_concepts, '') || ' ' || coalesce(learning_objectives, '') AS text FROM study_sections),
zw AS (SELECT DISTINCT question_id, session_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{3,}}')) AS w FROM z), sw AS (SELECT DISTINCT session_id, section_number, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{3,}}')) AS w FROM s),
n AS (SELECT question_id, section_number, count(*) AS overlap FROM zw JOIN sw USING (session_id, w) WHERE w NOT IN ({_GRADING}) GROUP BY ALL)
SELECT question_id, section_number, overlap FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, section_number) AS r FROM n) WHERE r = 1""")
def related_sections(spark: SparkSession, d: str) -> DataFrame:
    q = _quiz(spark, d).select("question_id", "session_id", F.concat("prompt", F.lit(" "), F.coalesce("answer", F.lit(""))).alias("text"))
    words = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "key_concepts", "learning_objectives")])
    s = sections(spark, d).select("session_id", "section_number", words.alias("text")).distinct()
    return quiz.related_sections(q, s)


_SENT = "regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g')"


@query(f"""WITH t AS (SELECT DISTINCT session_id, section_number, id, trim(regexp_replace(coalesce(section_text, ''), '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM study_sections),
p AS (SELECT session_id, section_number, id, unnest(string_split({_SENT.format('t')}, chr(1))) AS s, generate_subscripts(string_split({_SENT.format('t')}, chr(1)), 1) AS no FROM t), f AS (SELECT * REPLACE (trim(s) AS s) FROM p WHERE trim(s) <> '' AND len(string_split(trim(s), ' ')) >= 8),
w AS (SELECT *, list_filter(list_transform(string_split(s, ' '), lambda x: regexp_replace(x, '^[.,;:()\\[\\]"''`]+|[.,;:()\\[\\]"''`]+$', '', 'g')), lambda x: length(x) > 5 AND NOT list_contains({_LIST(tx.CONCEPT_STOP_WORDS)}, lower(x))) AS ws FROM f),
a AS (SELECT session_id, section_number, id, no, s, list_sort(list_transform(ws, lambda x, i: struct_pack(l := -length(x), i := i, w := x)))[1].w AS answer FROM w WHERE len(ws) > 0),
q AS (SELECT *, 'Fill in the blank: ' || substr(s, 1, strpos(s, answer) - 1) || '_____' || substr(s, strpos(s, answer) + length(answer)) AS prompt, struct_pack(a := section_number, b := id, c := no) AS pos FROM a),
po AS (SELECT session_id, lower(answer) AS low, arg_min(answer, pos) AS answer, min(pos) AS pos FROM q GROUP BY 1, 2), pr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS r FROM po), pl AS (SELECT session_id, list(answer ORDER BY r) AS pool FROM pr WHERE r <= 4 GROUP BY 1),
fi AS (SELECT session_id, prompt, arg_min(answer, pos) AS answer, min(pos) AS pos FROM q GROUP BY 1, 2), nu AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS question_no FROM fi)
SELECT session_id, CAST(question_no AS INTEGER) AS question_no, prompt, answer, [answer] || list_filter(pool || {_LIST(quiz.FILL_OPTIONS)}, lambda x: lower(x) <> lower(answer))[1:3] AS options FROM nu JOIN pl USING (session_id) WHERE question_no <= 3""")
def cloze_questions(spark: SparkSession, d: str) -> DataFrame:
    return quiz.cloze(sections(spark, d).select("session_id", "section_number", "id", "section_text"), "session_id", ["section_number", "id"], "section_text", tx.CONCEPT_STOP_WORDS)


@query(f"""WITH t AS (SELECT DISTINCT session_id, section_number, id, coalesce(section_text, '') AS t FROM study_sections), p AS (SELECT session_id, section_number, id, unnest(string_split(regexp_replace(t, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(t, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), 1) AS no FROM t),
f AS (SELECT * REPLACE (trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s) FROM p), n AS (SELECT session_id, array_to_string(regexp_extract_all(substr(s, 1, 220), '[A-Za-z][A-Za-z0-9-]*')[1:8], ' ') AS answer, row_number() OVER (PARTITION BY session_id ORDER BY section_number, id, no) AS question_no FROM f WHERE s <> '' AND len(string_split(s, ' ')) >= 7),
q AS (SELECT * FROM n WHERE question_no <= 5), o AS (SELECT q.session_id, q.question_no, n.answer AS other, min(n.question_no) AS pos FROM q JOIN n ON n.session_id = q.session_id AND n.question_no > q.question_no WHERE n.answer <> '' AND lower(n.answer) <> lower(q.answer) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, question_no ORDER BY pos) AS r FROM o), l AS (SELECT session_id, question_no, list(other ORDER BY r) AS others FROM r WHERE r <= 3 GROUP BY 1, 2)
SELECT session_id, CAST(question_no AS INTEGER) AS question_no, answer, [answer] || (coalesce(others, []) || {_LIST(quiz.FILL_DISTRACTORS)})[1:3] AS options FROM q LEFT JOIN l USING (session_id, question_no)""")
def choice_questions(spark: SparkSession, d: str) -> DataFrame:
    return quiz.multiple_choice(sections(spark, d).select("session_id", "section_number", "id", "section_text"), "session_id", ["section_number", "id"], "section_text")


# --- progress


_MERGED = """WITH v AS (SELECT DISTINCT * FROM section_progress), mg AS (SELECT user_id, session_id, section_number, max(completed) AS completed, arg_max(struct_pack(a := quiz_score, b := explanation_text), id) AS l, count(DISTINCT id) AS saves FROM v GROUP BY 1, 2, 3),
m AS (SELECT user_id, session_id, section_number, completed, l.a AS quiz_score, l.b AS explanation_text, saves FROM mg)"""


@query(_MERGED + " SELECT * FROM m")
def merged_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress.merged_progress(saves(spark, d))


@query("WITH v AS (SELECT DISTINCT * FROM section_progress) SELECT user_id, session_id, section_number, id, completed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, section_number ORDER BY updated_at DESC, id DESC) AS r FROM v) WHERE r = 1")
def latest_saves(spark: SparkSession, d: str) -> DataFrame:
    """The newest save of each section by its time, which may differ from the last to arrive."""
    return progress.latest(saves(spark, d).select("user_id", "session_id", "section_number", "id", "completed", "updated_at"), ["user_id", "session_id", "section_number"], "updated_at", "id").drop("updated_at")


@query(_MERGED + " SELECT user_id, round(coalesce(avg(quiz_score), 0.0), 4) AS average, count(quiz_score) AS scored FROM m GROUP BY user_id")
def quiz_averages(spark: SparkSession, d: str) -> DataFrame:
    return progress.quiz_average(progress.merged_progress(saves(spark, d)))


@query("""WITH t AS (SELECT DISTINCT * FROM study_sessions), s AS (SELECT DISTINCT session_id, section_number FROM study_sections), n AS (SELECT session_id AS id, count(*) AS sections FROM s GROUP BY 1),
dn AS (SELECT v.session_id AS id, v.user_id, count(*) AS completed FROM (SELECT DISTINCT user_id, session_id, section_number FROM section_progress WHERE completed = 1) v JOIN s USING (session_id, section_number) GROUP BY 1, 2)
SELECT t.id, t.user_id, t.title, coalesce(sections, 0) AS sections, coalesce(completed, 0) AS completed, CAST(round_even(coalesce(completed, 0) * 100 / greatest(1, coalesce(sections, 0)), 0) AS INTEGER) AS percent,
CAST(row_number() OVER (PARTITION BY t.user_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, t.id DESC) AS INTEGER) AS place FROM t LEFT JOIN n USING (id) LEFT JOIN dn ON dn.id = t.id AND dn.user_id = t.user_id""")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    return progress.session_list(sessions(spark, d), sections(spark, d), saves(spark, d))


@query("""WITH s AS (SELECT DISTINCT session_id, section_number FROM study_sections), f AS (SELECT DISTINCT session_id, section_number FROM section_progress WHERE completed = 1), l AS (SELECT * FROM s EXCEPT SELECT * FROM f)
SELECT session_id, section_number, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY section_number) AS r FROM l) WHERE r <= 3""")
def next_sections(spark: SparkSession, d: str) -> DataFrame:
    return progress.next_sections(sections(spark, d), progress.merged_progress(saves(spark, d)))


@query("SELECT page_id, count(*) AS rows FROM doc_pages GROUP BY page_id HAVING count(*) > 1")
def repeated_page_ids(spark: SparkSession, d: str) -> DataFrame:
    return progress.key_faults(table(spark, d, "doc_pages").select("page_id"), ["page_id"])


@query("SELECT DISTINCT id, session_id, section_number FROM study_sections WHERE session_id IN (SELECT id FROM study_sessions)")
def sections_of_sessions(spark: SparkSession, d: str) -> DataFrame:
    return progress.without_orphans(sections(spark, d), sessions(spark, d), "session_id", "id").select("id", "session_id", "section_number")


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS before FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, lead(event_type) OVER w AS next, lead(ts) OVER w AS until FROM m WHERE NOT (event_type = 'view' AND coalesce(before, '') = 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(sum(floor((epoch_us(until) - epoch_us(ts)) / 1000000)) AS BIGINT) AS seconds, count(*) AS spans FROM x WHERE event_type = 'view' AND next = 'click' GROUP BY user_id""")
def study_seconds(spark: SparkSession, d: str) -> DataFrame:
    return progress.study_seconds(table(spark, d, "events"), "user_id", "ts", "event_type", "view", ["click"], "event_id")


# --- more of ranking, planning and assembly


@query(f"""WITH {_C}, {_Q}, qw AS (SELECT question_id, scope, unnest(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: length(x) > 4)) AS w FROM q),
s AS (SELECT question_id, chunk_id, page_number, CAST(count(*) AS DOUBLE) AS score FROM qw JOIN c USING (scope) WHERE contains(lower(coalesce(text, '')), w) GROUP BY ALL)
SELECT question_id, chunk_id, page_number, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_number, chunk_id) AS rank FROM s) WHERE rank <= 3""")
def important_words_top3(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.important_words(questions(spark, d), chunks(spark, d))


@query(_GATED + """, ra AS (SELECT question_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9\\x{0590}-\\x{05FF}]+'), lambda x: length(x) > 1) AS r FROM q), fs AS (SELECT question_id, chunk_id, array_to_string(list_sort(list_distinct(list_transform(found, lambda g: array_to_string(g, ' ')))), '; ') AS phrases FROM fp)
SELECT ga.question_id, ga.chunk_id, array_to_string(list_filter(tokens, lambda t, i: NOT list_contains(matched, t) AND list_position(tokens, t) = i), ' ') AS unmatched, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: NOT list_contains(tokens, x)))), ' ') AS ignored, coalesce(fs.phrases, '') AS phrases, 1.0 AS threshold FROM ga JOIN ra ON ra.question_id = ga.question_id LEFT JOIN fs ON fs.question_id = ga.question_id AND fs.chunk_id = ga.chunk_id WHERE rank <= 5""")
def gated_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Of each chunk found: the question's terms it lacks, those that don't count, the phrases it has."""
    return retrieval.gated(questions(spark, d), _titled(spark, d), diagnostics=True).select("question_id", "chunk_id", "unmatched", "ignored", "phrases", "threshold")


@query(_GATED + """, g5 AS (SELECT * FROM ga WHERE rank <= 5), fe AS (SELECT question_id FROM g5 GROUP BY 1 HAVING count(*) < 3), fi AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY page_number) AS r FROM (SELECT scope, page_number, min(chunk_id) AS chunk_id FROM c GROUP BY 1, 2)),
mo AS (SELECT fe.question_id, fi.chunk_id, fi.page_number FROM fe JOIN q USING (question_id) JOIN fi USING (scope) WHERE r <= 8 AND (fe.question_id, fi.page_number) NOT IN (SELECT (question_id, page_number) FROM g5)),
bo AS (SELECT question_id, chunk_id, page_number, rank AS was FROM g5 UNION ALL SELECT question_id, chunk_id, page_number, 1048576 FROM mo)
SELECT question_id, chunk_id, page_number, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY was, page_number, chunk_id) AS rank FROM bo) WHERE rank <= 5""")
def backfilled_top5(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return retrieval.backfilled(retrieval.gated(q, _titled(spark, d)), q, _chunk_keys(spark, d))


@query()
def study_roadmap(spark: SparkSession, d: str) -> DataFrame:
    return planner.roadmap(named_pages(spark, d), pages_per_section=5)


@query()
def composed_answers(spark: SparkSession, d: str) -> DataFrame:
    q, c = questions(spark, d), chunks(spark, d)
    return evaluate.composed_answers(q, retrieval.bm25(q, c, 3), c)


@query(f"""WITH {_Q}, n AS (SELECT question_id, lower(question) AS t FROM q) SELECT question_id, CASE WHEN regexp_matches(t, '\\b(chapters?|ch)\\.?\\s+(\\d{{1,2}}|one|two|three|four|five|six|seven|eight|nine|ten)') OR regexp_matches(t, '(פרק|פרקים)\\s+\\d') THEN 'chapter_summary'
WHEN regexp_matches(t, '\\bsections?\\.?\\s+(\\d{{1,2}}|one|two|three|four|five|six|seven|eight|nine|ten)') OR regexp_matches(t, 'חלק\\s+\\d') THEN 'section_summary' WHEN regexp_matches(t, '\\b(study plan|prepare for|help me study)\\b|תוכנית לימוד') THEN 'study_plan'
WHEN (regexp_matches(t, '\\b(pdf|document|material)\\b') AND (regexp_matches(t, '\\b(summarize|summary|explain|overview)\\b|סכם|סיכום') OR regexp_matches(t, '\\b(main ideas?|key ideas?|main points?|about)\\b|רעיון מרכזי'))) OR regexp_matches(t, 'מהמסמך|מהחומר') THEN 'general_pdf_summary' WHEN trim(t) <> '' THEN 'factual_question' ELSE 'unknown' END AS intent FROM n""")
def query_intents(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("question_id", tx.query_intent("question").alias("intent"))
