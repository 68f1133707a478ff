"""Queries of the study operators over sessions, sections and quizzes, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import planner, progress, retrieval, study
from leafmill.queries import query
from leafmill.queries.reference import _C, _GIVEN, _MERGED, _NAMED, _Q, chunks, graded_answers, named_pages, questions, saves, sections, sessions, _terms
from leafmill.sources.tables import table

_S = "s AS (SELECT DISTINCT * FROM study_sections)"
_T = "t AS (SELECT DISTINCT * FROM study_sessions)"
_TIDIED = "trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'))"
_ARRAY = "coalesce(TRY_CAST(json_transform({0}, '[\"VARCHAR\"]') AS VARCHAR[]), [])"


def full_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections with their lists read from JSON."""
    read = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c)
    return sections(spark, d).select("id", "session_id", "section_number", "title", "start_page", "end_page", "estimated_minutes", "difficulty", "summary", read("key_concepts"), read("learning_objectives"), "section_text")


@query(f"WITH {_S} SELECT session_id, CAST(sum(coalesce(estimated_minutes, 0)) AS BIGINT) AS minutes, count(*) AS sections FROM s GROUP BY 1")
def session_minutes(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).groupBy("session_id").agg(F.sum(F.coalesce("estimated_minutes", F.lit(0))).alias("minutes"), F.count("*").alias("sections"))


@query(f"""WITH {_T}, j AS (SELECT id, CASE WHEN json_valid(coalesce(progress_state, '')) THEN progress_state ELSE '{{}}' END AS p FROM t)
SELECT id, array_to_string(list_sort(list_distinct(coalesce(CAST(json_extract(p, '$.completed_sections') AS INTEGER[]), []))), ',') AS completed, greatest(0, coalesce(CAST(json_extract(p, '$.actual_study_seconds') AS BIGINT), 0)) AS seconds FROM j""")
def session_states(spark: SparkSession, d: str) -> DataFrame:
    """Sections completed and seconds studied by each session's own JSON."""
    x = sessions(spark, d).select("id", study.progress_state("progress_state").alias("s"))
    return x.select("id", F.array_join(F.col("s.completed_sections").cast("array<string>"), ",").alias("completed"), F.col("s.actual_study_seconds").alias("seconds"))


@query(_MERGED + f""", {_T}, j AS (SELECT id, user_id, CASE WHEN json_valid(coalesce(progress_state, '')) THEN progress_state ELSE '{{}}' END AS p FROM t),
a AS (SELECT id, user_id, unnest(coalesce(CAST(json_extract(p, '$.completed_sections') AS INTEGER[]), [])) AS n FROM j UNION SELECT session_id, user_id, section_number FROM m WHERE completed = 1),
c AS (SELECT id, user_id, string_agg(DISTINCT n, ',' ORDER BY n) AS completed FROM a GROUP BY 1, 2) SELECT t.id, t.user_id, coalesce(completed, '') AS completed FROM t LEFT JOIN c ON c.id = t.id AND c.user_id = t.user_id""")
def opened_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sections that are completed when a session is opened: by its JSON or by its user's saves."""
    x = study.merged_sessions(sessions(spark, d), progress.merged_progress(saves(spark, d)))
    return x.select("id", "user_id", F.array_join(F.col("completed_sections").cast("array<string>"), ",").alias("completed"))


@query(f"WITH {_T}, {_S}, n AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1) SELECT id, CAST(greatest(0, least(coalesce(current_section_index, 0), coalesce(n, 0) - 1)) AS INTEGER) AS section_index FROM t LEFT JOIN n ON n.session_id = id")
def current_sections(spark: SparkSession, d: str) -> DataFrame:
    n = sections(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    return sessions(spark, d).join(n, "id", "left").select("id", study.section_index(F.col("current_section_index"), F.coalesce("n", F.lit(0))).cast("int").alias("section_index"))


@query(f"WITH {_S}, v AS (SELECT session_id, section_number, max(struct_pack(i := id, t := explanation_text, q := quiz_score)) AS l FROM (SELECT DISTINCT * FROM section_progress) GROUP BY 1, 2) SELECT s.session_id, s.section_number, coalesce(l.t, '') AS explanation, l.q AS quiz_score FROM (SELECT DISTINCT session_id, section_number FROM s) s LEFT JOIN v USING (session_id, section_number)")
def section_state_rows(spark: SparkSession, d: str) -> DataFrame:
    """The state of every section, by the last save to arrive."""
    last = saves(spark, d).groupBy("session_id", "section_number").agg(F.max_by(F.struct("explanation_text", "quiz_score"), "id").alias("l"))
    saved = last.select("session_id", "section_number", F.col("l.explanation_text").alias("explanation"), "l.quiz_score", F.lit(None).cast("array<string>").alias("feedback"), F.lit("").alias("question"), F.lit("").alias("answer"))
    return study.section_states(sections(spark, d), saved).select("session_id", "section_number", "explanation", "quiz_score")


@query("SELECT 'chunk_vectors' AS collection, count(*) FILTER (WHERE len(vector) > 0) AS num_vectors, count(DISTINCT chunk_id) AS num_chunks FROM (SELECT DISTINCT vec_id, chunk_id, vector FROM chunk_vectors)")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    return study.store_statistics(table(spark, d, "chunk_vectors").select("vec_id", "chunk_id", "vector").distinct(), "chunk_vectors")


@query("SELECT DISTINCT chunk_id, page_number, coalesce(start_char, 0) AS start_char, coalesce(end_char, 0) AS end_char, coalesce(parent_id, '') AS parent_id FROM doc_chunks")
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return study.stored_chunks(table(spark, d, "doc_chunks").select("chunk_id", "page_number", "start_char", "end_char", "parent_id").distinct())


@query("SELECT DISTINCT chunk_id, page_number, coalesce(start_char, 0) AS start_char, nullif(parent_id, '') AS parent_id FROM doc_chunks")
def restored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return study.restored_chunks(stored_chunks(spark, d)).select("chunk_id", "page_number", "start_char", "parent_id")


def _exam_sql() -> str:
    def branch(code: str) -> str:
        question, choices, truths, free, topic = study.EXAM_TEXTS[code]
        listed = lambda x: "['" + "', '".join(x) + "']"
        a, b = question.split("{}")
        return f"SELECT id, no, kind AS type, '{a}' || no || '{b}' AS question, CASE kind WHEN 'multiple_choice' THEN {listed(choices)} WHEN 'true_false' THEN {listed(truths)} ELSE [] END AS options, CASE kind WHEN 'multiple_choice' THEN '{choices[0]}' WHEN 'true_false' THEN '{truths[0]}' ELSE '{free}' END AS answer, '{topic}' AS topic FROM k WHERE {'' if code == 'he' else 'NOT '}he"

    return f"WITH {_T}, k AS (SELECT id, coalesce(lower(trim(language)) IN ('he', 'iw', 'hebrew'), false) AS he, unnest([1, 2, 3, 4, 5, 6]) AS no, unnest(['multiple_choice', 'true_false', 'short_answer', 'multiple_choice', 'true_false', 'short_answer']) AS kind FROM t), u AS ({branch('he')} UNION ALL {branch('en')}) SELECT * REPLACE (array_to_string(options, ' / ') AS options) FROM u"


@query(_exam_sql())
def fallback_exams(spark: SparkSession, d: str) -> DataFrame:
    """An exam of six questions for each session whose exam could not be made, in its language."""
    x = study.fallback_exams(sessions(spark, d).select("id", "language", F.lit(6).alias("n")), "id", "language", "n")
    return x.withColumn("options", F.array_join("options", " / "))


@query(f"""WITH {_GIVEN}, tt AS (SELECT session_id, section_number, min(title) AS title FROM (SELECT DISTINCT * FROM study_sections) GROUP BY 1, 2), w AS (SELECT ok.session_id, title, min(question_id) AS q FROM ok JOIN tt USING (session_id, section_number) WHERE NOT ok AND trim(coalesce(title, '')) <> '' GROUP BY 1, 2),
n AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE ok) AS "right" FROM ok GROUP BY 1), l AS (SELECT session_id, list(title ORDER BY q) AS weak FROM w GROUP BY 1)
SELECT session_id, CAST(round_even("right" * 100 / n, 0) AS INTEGER) AS score, "right", n - "right" AS wrong, array_to_string(coalesce(weak, []), '; ') AS weak_sections, CASE WHEN len(coalesce(weak, [])) > 0 THEN 'Review ' || weak[1] || ' first, then retry the missed questions.' ELSE 'Good work. Revisit your notes briefly before moving on.' END AS recommendation FROM n LEFT JOIN l USING (session_id)""")
def exam_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of each session with its weak sections and what to do next."""
    title = sections(spark, d).groupBy("session_id", "section_number").agg(F.min("title").alias("section_title"))
    x = graded_answers(spark, d).join(title, ["session_id", "section_number"], "left").withColumn("topic", F.lit(None).cast("string"))
    return study.exam_results(x, "session_id").drop("weak_topics").withColumn("weak_sections", F.array_join("weak_sections", "; "))


@query(f"WITH {_GIVEN} SELECT session_id, section_number, count(*) AS questions, count(*) FILTER (WHERE ok) AS \"right\" FROM ok GROUP BY 1, 2")
def section_results(spark: SparkSession, d: str) -> DataFrame:
    """Right answers by section, letter answers among them."""
    return graded_answers(spark, d).groupBy("session_id", "section_number").agg(F.count("*").alias("questions"), F.count_if("is_correct").alias("right"))


@query(_MERGED + f""", {_S}, tt AS (SELECT session_id, section_number, min(title) AS title FROM s GROUP BY 1, 2), lo AS (SELECT session_id, title, min(section_number) AS no FROM m JOIN tt USING (session_id, section_number) WHERE quiz_score < 80 AND coalesce(title, '') <> '' GROUP BY 1, 2)
SELECT session_id, string_agg(title, '; ' ORDER BY no, title) AS weak_sections FROM lo GROUP BY 1""")
def weak_sections(spark: SparkSession, d: str) -> DataFrame:
    title = sections(spark, d).groupBy("session_id", "section_number").agg(F.min("title").alias("title"))
    x = progress.merged_progress(saves(spark, d)).join(title, ["session_id", "section_number"])
    return study.weak_sections(x).withColumn("weak_sections", F.array_join("weak_sections", "; "))


@query(f"""WITH {_S}, c AS (SELECT session_id, section_number, start_page, coalesce(nullif({_ARRAY.format('key_concepts')}[1], ''), title) AS c FROM s)
SELECT session_id, section_number, 2 AS no, 'true_false' AS type, 'True or False: ' || c || ' is discussed in this section.' AS question, 'True' AS answer, start_page AS source_page FROM c
UNION ALL SELECT session_id, section_number, 3, 'short_answer', 'In one sentence, explain why ' || c || ' matters in this section.', 'A strong answer should use the section text and mention the main idea clearly.', start_page FROM c""")
def section_quizzes(spark: SparkSession, d: str) -> DataFrame:
    return study.section_quiz(full_sections(spark, d)).drop("options")


@query(f"""WITH {_S}, k AS (SELECT session_id, section_number, 'Session ' || section_number || ': ' || coalesce(title, '') || chr(10) || CASE WHEN start_page = end_page THEN 'Page: ' || start_page ELSE 'Pages: ' || start_page || '-' || end_page END || chr(10) || 'Estimated time: ' || coalesce(estimated_minutes, 0) || ' minutes' || chr(10) || 'Difficulty: ' || coalesce(difficulty, '') || chr(10) || 'Summary: ' || coalesce(summary, '')
|| CASE WHEN array_to_string({_ARRAY.format('key_concepts')}[1:8], ', ') <> '' THEN chr(10) || 'Key concepts: ' || array_to_string({_ARRAY.format('key_concepts')}[1:8], ', ') ELSE '' END || CASE WHEN array_to_string({_ARRAY.format('learning_objectives')}[1:4], '; ') <> '' THEN chr(10) || 'Learning objectives: ' || array_to_string({_ARRAY.format('learning_objectives')}[1:4], '; ') ELSE '' END AS b FROM s)
SELECT session_id, string_agg(b, chr(10) || chr(10) ORDER BY section_number) AS plan FROM k GROUP BY 1""")
def plan_texts(spark: SparkSession, d: str) -> DataFrame:
    return study.plan_text(full_sections(spark, d))


@query(f"WITH {_S} SELECT session_id, md5(string_agg(coalesce(title, '') || chr(10) || coalesce(section_text, ''), chr(10) || chr(10) ORDER BY section_number)) AS digest FROM s GROUP BY 1")
def study_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digest of all a session has to study."""
    return study.study_text(sections(spark, d)).select("session_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(f"""WITH {_NAMED}, n AS (SELECT scope, count(*) AS n FROM np WHERE scope IS NOT NULL GROUP BY 1), x AS (SELECT scope, page_number, page_id, substr({_TIDIED}, 1, CAST(greatest(120, least(1200, floor(14000 / n))) AS BIGINT)) AS t FROM np JOIN n USING (scope)),
k AS (SELECT scope, page_number, page_id, 'Page ' || page_number || chr(10) || t AS b FROM x WHERE t <> '') SELECT scope, md5(substr(string_agg(b, chr(10) || chr(10) ORDER BY page_number, page_id), 1, 14000)) AS digest FROM k GROUP BY 1""")
def page_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each document's pages, cut to share 14,000 characters."""
    return study.pages_text(named_pages(spark, d)).select("scope", F.md5(F.encode("context", "UTF-8")).alias("digest"))


_PAGE_STOPS = ", ".join(f"'{w}'" for w in study.PAGE_STOP)


@query(f"""WITH {_NAMED}, {_Q}, qw AS (SELECT DISTINCT question_id, scope, unnest(regexp_extract_all(lower(question), '[a-z][a-z0-9-]{{2,}}')) AS w FROM q), pw AS (SELECT DISTINCT scope, page_number, page_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9-]{{2,}}')) AS w FROM np),
h AS (SELECT question_id, page_number, page_id, count(*) AS score FROM qw JOIN pw USING (scope, w) WHERE w NOT IN ({_PAGE_STOPS}) GROUP BY ALL) SELECT question_id, page_number, page_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_number, page_id) AS rank FROM h) WHERE rank <= 8""")
def ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).withColumn("start_page", F.lit(None).cast("int")).withColumn("end_page", F.lit(None).cast("int"))
    return study.ranked_pages(q, named_pages(spark, d))


@query(f"WITH {_NAMED} SELECT scope, count(*) AS pages, CAST(coalesce(sum(length(coalesce(text, ''))), 0) AS BIGINT) AS chars FROM np GROUP BY 1")
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The first two parts of each document's signature."""
    parts = F.split("signature", ":")
    return study.text_signature(named_pages(spark, d)).select("scope", F.get(parts, F.lit(0)).cast("bigint").alias("pages"), F.get(parts, F.lit(1)).cast("bigint").alias("chars"))


@query(_MERGED + f""", {_S}, dn AS (SELECT DISTINCT session_id, section_number FROM m WHERE completed = 1), av AS (SELECT session_id, avg(quiz_score) AS average FROM m GROUP BY 1), lf AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY section_number) AS rank FROM s WHERE (session_id, section_number) NOT IN (SELECT (session_id, section_number) FROM dn))
SELECT session_id, section_number, CAST(rank AS INTEGER) AS rank, coalesce(nullif({_ARRAY.format('key_concepts')}[1], ''), title) AS topic, CASE WHEN average > 0 AND average < 80 THEN 'low quiz' ELSE 'not completed' END AS reason FROM lf LEFT JOIN av USING (session_id) WHERE rank <= 3""")
def review_items(spark: SparkSession, d: str) -> DataFrame:
    merged = progress.merged_progress(saves(spark, d))
    return study.review_items(full_sections(spark, d), merged, merged.groupBy("session_id").agg(F.avg("quiz_score").alias("average")))


@query(f"WITH {_C}, {_Q}, w AS (SELECT DISTINCT pdf AS scope, page FROM eval_dataset WHERE pdf IS NOT NULL AND page IS NOT NULL) SELECT scope, count(*) AS cited FROM w GROUP BY 1")
def cited_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many pages of each document the evaluation's answers cite."""
    return table(spark, d, "eval_dataset").where("pdf is not null and page is not null").groupBy(F.col("pdf").alias("scope")).agg(F.countDistinct("page").alias("cited"))


@query("""WITH q AS (SELECT DISTINCT question_id, session_id, section_number FROM quiz_questions), s AS (SELECT session_id, title, min(section_number) AS first FROM (SELECT DISTINCT * FROM study_sections) WHERE title IS NOT NULL GROUP BY 1, 2), t AS (SELECT DISTINCT session_id, section_number, title FROM study_sections)
SELECT DISTINCT question_id, first AS section_number FROM q JOIN t USING (session_id, section_number) JOIN s USING (session_id, title)""")
def sections_by_title(spark: SparkSession, d: str) -> DataFrame:
    """The first section that has the title of a question's section."""
    s = sections(spark, d)
    first = s.where("title is not null").groupBy("session_id", "title").agg(F.min("section_number").alias("first"))
    q = table(spark, d, "quiz_questions").select("question_id", "session_id", "section_number").distinct()
    return q.join(s.select("session_id", "section_number", "title").distinct(), ["session_id", "section_number"]).join(first, ["session_id", "title"]).select("question_id", F.col("first").alias("section_number")).distinct()


@query(f"""WITH {_T}, dd AS (SELECT DISTINCT document_id FROM t WHERE user_id = 7), o AS (SELECT DISTINCT document_id, max(updated_at) AS updated_at FROM t GROUP BY 1)
SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM dd) THEN TIMESTAMP '2026-01-01 00:00:00' ELSE updated_at END AS updated_at FROM o""")
def touched_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the time of their last change, set anew for those of the user 7."""
    t = sessions(spark, d)
    docs = t.groupBy("document_id").agg(F.max("updated_at").alias("updated_at"))
    return study.touched(docs, t.where("user_id = 7"), "document_id", "document_id", "updated_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query("""WITH o AS (SELECT DISTINCT user_id AS id, user_id FROM study_sessions), n AS (SELECT DISTINCT user_id FROM section_progress WHERE user_id NOT IN (SELECT user_id FROM o))
SELECT id, user_id FROM o UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY user_id), user_id FROM n""")
def inserted_users(spark: SparkSession, d: str) -> DataFrame:
    """The sessions' users under their own numbers, and those who only have progress under the next ones."""
    old = sessions(spark, d).select(F.col("user_id").alias("id"), "user_id").distinct()
    return study.inserted(old, saves(spark, d).select("user_id", F.col("user_id").alias("arrival")).distinct(), ["user_id"])


@query(f"""WITH {_C}, {_Q}, f AS (SELECT scope, chunk_id, page_number, row_number() OVER (PARTITION BY scope ORDER BY page_number, chunk_id) AS rank FROM c), cw AS (SELECT DISTINCT scope, chunk_id, page_number, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS w FROM c),
qw AS (SELECT DISTINCT question_id, scope, unnest(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS w FROM q), ko AS (SELECT question_id, chunk_id, page_number, row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, page_number, chunk_id) AS rank FROM qw JOIN cw USING (scope, w) GROUP BY 1, 2, 3)
SELECT 'document_order' AS method, question_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM f JOIN q USING (scope) WHERE rank <= 3 UNION ALL SELECT 'keyword_overlap', question_id, chunk_id, CAST(rank AS INTEGER) FROM ko WHERE rank <= 3""")
def plain_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The baselines that no seed and no substring decides, side by side."""
    q, c = questions(spark, d), chunks(spark, d)
    return retrieval.baselines(q, c, names=["document_order", "keyword_overlap"]).drop("page_number")


@query(f"WITH {_Q} SELECT question_id, CAST(coalesce(try_cast(nullif(regexp_extract(question, '\\b(10|[1-9])\\b', 1), '') AS INTEGER), 5) AS INTEGER) AS wanted FROM q")
def requested_counts(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("question_id", study.requested_count("question").alias("wanted"))


@query(f"""WITH {_NAMED}, {_T}, {_S}, r AS (SELECT DISTINCT t.id AS session_id, page_number FROM t JOIN np ON np.scope = t.filename WHERE page_number > 0 AND {_TIDIED} <> ''), re AS (SELECT session_id, min(page_number) AS low, max(page_number) AS high FROM r GROUP BY 1),
x AS (SELECT session_id, section_number, coalesce(start_page, 0) AS a, coalesce(end_page, 0) AS b FROM s), y AS (SELECT *, lag(b) OVER (PARTITION BY session_id ORDER BY section_number) AS before FROM x LEFT JOIN re USING (session_id)),
m AS (SELECT DISTINCT x.session_id, section_number, page_number FROM x JOIN r ON r.session_id = x.session_id AND page_number BETWEEN a AND b)
SELECT session_id, 'unreadable' AS fault FROM y WHERE low IS NULL UNION SELECT session_id, 'outside' FROM y WHERE a < low OR b > high UNION SELECT session_id, 'backwards' FROM y WHERE low IS NOT NULL AND a > b UNION SELECT session_id, 'backwards' FROM y WHERE a > b UNION SELECT session_id, 'overlap' FROM y WHERE a <= before
UNION SELECT session_id, 'empty' FROM x WHERE session_id IN (SELECT session_id FROM re) AND (session_id, section_number) NOT IN (SELECT (session_id, section_number) FROM m) UNION SELECT session_id, 'uncovered' FROM r WHERE session_id IN (SELECT session_id FROM x) AND (session_id, page_number) NOT IN (SELECT (session_id, page_number) FROM m)""")
def session_plan_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the sections of each session, held against its document's pages."""
    own = sessions(spark, d).select(F.col("id").alias("session_id"), F.col("filename").alias("source")).distinct()
    pages = named_pages(spark, d).withColumnRenamed("scope", "source").join(own, "source").select(F.col("session_id").alias("scope"), "page_number", "text")
    found = planner.plan_faults(sections(spark, d).select(F.col("session_id").alias("scope"), "section_number", "start_page", "end_page"), pages)
    return found.withColumnRenamed("scope", "session_id")


@query(f"""WITH {_Q}, e AS (SELECT question_id, list_distinct({_terms('question')}) AS t FROM q) SELECT question_id, len(t) AS terms FROM e""")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct meaningful terms of each question."""
    return questions(spark, d).select("question_id", F.size(F.array_distinct(tx.terms("question"))).cast("bigint").alias("terms"))
