"""Study state, exams and texts about sections, as expressions and joins over all sessions at once.

Sections have session_id, section_number, title, start_page, end_page, estimated_minutes, difficulty, summary, key_concepts
and learning_objectives (arrays). Null texts count as empty, null arrays as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

# What an exam is filled with where none could be made, by language and type of question.
EXAM_TYPES = ["multiple_choice", "true_false", "short_answer"]
EXAM_TEXTS = {
    "en": ("Review question {}: explain or identify one important idea from the study material.", ["A key idea from the PDF", "An unrelated topic", "A random definition", "None of the above"], ["True", "False"], "Use your section notes and explanations to support the answer.", "Review"),
    "he": ("שאלת חזרה {}: הסבירו או זהו רעיון חשוב אחד מחומר הלימוד.", ["רעיון מרכזי מה-PDF", "נושא לא קשור", "הגדרה אקראית", "אף תשובה אינה נכונה"], ["נכון", "לא נכון"], "השתמשו בהערות ובהסברים מהחלקים כדי לתמוך בתשובה.", "חזרה"),
}
# What to do next, by language: for a weak section, for a weak topic, for neither.
ADVICE = {
    "en": ("Review {} first, then retry the missed questions.", "Review {} and write a one-sentence summary before retaking the exam.", "Good work. Revisit your notes briefly before moving on."),
    "he": ("חזרו קודם על {}, ואז נסו שוב את השאלות שפספסתם.", "חזרו על {} וכתבו סיכום במשפט אחד לפני ניסיון נוסף במבחן.", "עבודה טובה. עברו בקצרה על ההערות לפני שממשיכים."),
}
# Words of a question that say nothing of its pages.
PAGE_STOP = "what are the for and that this with from does have into about which when where why how is a an of to in on".split()
_PAGE_TERM = "[A-Za-z][A-Za-z0-9-]{2,}"
NONE = "array<string>"


def _filled(template: str, value: Column) -> Column:
    a, b = template.split("{}")
    return F.concat(F.lit(a), value, F.lit(b))


def by_language(language: Column, hebrew: Column, other: Column) -> Column:
    """Hebrew where the language is Hebrew, else English."""
    return F.when(F.lower(F.trim(F.coalesce(language, F.lit("")))).isin("he", "iw", "hebrew"), hebrew).otherwise(other)


# --- state


STATE = "struct<completed_sections:array<int>,quiz_scores:array<double>,section_quiz_scores:map<string,double>,actual_study_seconds:bigint,weak_topics:array<string>,weak_sections:array<string>,final_exam_score:double,timer_running:boolean,timer_started_at:double>"


def progress_state(raw: Column | str) -> Column:
    """A session's state from its JSON: completed sections sorted and distinct, seconds not below 0, lists and flags with
    their defaults. What is no JSON gives the default state."""
    s = F.from_json(F.coalesce(tx.col(raw), F.lit("{}")), STATE, {"mode": "PERMISSIVE"})
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return F.struct(
        F.array_sort(F.array_distinct(empty(s["completed_sections"], "array<int>"))).alias("completed_sections"), empty(s["quiz_scores"], "array<double>").alias("quiz_scores"), F.coalesce(s["section_quiz_scores"], F.create_map().cast("map<string,double>")).alias("section_quiz_scores"),
        F.greatest(F.lit(0).cast("bigint"), F.coalesce(s["actual_study_seconds"], F.lit(0).cast("bigint"))).alias("actual_study_seconds"), empty(s["weak_topics"], NONE).alias("weak_topics"), empty(s["weak_sections"], NONE).alias("weak_sections"), s["final_exam_score"].alias("final_exam_score"), F.coalesce(s["timer_running"], F.lit(False)).alias("timer_running"), s["timer_started_at"].alias("timer_started_at"),
    )


def dumped_state(state: Column) -> Column:
    """The state as JSON, sets in order."""
    return F.to_json(state, {"ignoreNullFields": "false"})


def section_states(sections: DataFrame, saved: DataFrame, reset: bool = False) -> DataFrame:
    """(session_id, section_number, explanation, quiz_score, feedback, question, answer): one state for every section, what is
    saved over the defaults; ``reset`` keeps only the score and the feedback."""
    keys = ["session_id", "section_number"]
    x = sections.select(*keys).distinct().join(saved.select(*keys, "explanation", "quiz_score", "feedback", "question", "answer"), keys, "left")
    text = lambda c: F.lit("") if reset else F.coalesce(c, F.lit(""))
    return x.select(*keys, text("explanation").alias("explanation"), "quiz_score", F.coalesce("feedback", F.array().cast(NONE)).alias("feedback"), text("question").alias("question"), text("answer").alias("answer"))


def merged_sessions(sessions: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, user_id, completed_sections, section_scores): the state a session opens with: sections completed by its JSON or by
    the saved rows of its user, and the rows' scores."""
    own = sessions.select("id", "user_id", progress_state("progress_state")["completed_sections"].alias("c"))
    rows = merged.groupBy(F.col("session_id").alias("id"), "user_id").agg(F.array_sort(F.collect_set(F.when(F.col("completed") == 1, F.col("section_number")))).alias("r"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("quiz_score").isNotNull(), F.struct("section_number", "quiz_score"))))).alias("section_scores"))
    x = own.join(rows, ["id", "user_id"], "left")
    return x.select("id", "user_id", F.array_sort(F.array_union("c", F.coalesce("r", F.array().cast("array<int>")))).alias("completed_sections"), "section_scores")


def section_index(index: Column, sections: Column) -> Column:
    """An index from 0 to the last section, 0 where there is none."""
    return F.greatest(F.lit(0), F.least(F.coalesce(index, F.lit(0)), sections - 1))


def readiness(exam_score: Column, percent: Column) -> Column:
    """The exam's score, else the progress."""
    return F.coalesce(exam_score, percent.cast("double"))


def touched(parents: DataFrame, children: DataFrame, key: str, parent_key: str, column: str, value: Column) -> DataFrame:
    """The parents with ``column`` set where one of the children (``key``) refers to them: an update with a subquery."""
    hit = children.select(F.col(key).alias(parent_key)).distinct().withColumn("_hit", F.lit(True))
    return parents.join(hit, parent_key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


#: Arrival numbers that are ranked by one sort, about.
NUMBERED_AT_ONCE = 100_000


def inserted(old: DataFrame, new: DataFrame, unique: list[str], key: str = "id", order: str = "arrival") -> DataFrame:
    """The old rows and the new ones whose ``unique`` values are not taken, each value once, the first to arrive, under keys
    that go on from the largest. ``order`` is a number; rows are ranked in ranges of it, and the ranges' counts added up."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*unique).orderBy(order))).where("_r = 1").drop("_r").join(old.select(*unique), unique, "left_anti")
    ranged = first.withColumn("_part", F.floor(F.col(order) / NUMBERED_AT_ONCE))
    before = ranged.groupBy("_part").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")).drop("_m")
    most = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_most"))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order, *unique))).join(before, "_part").crossJoin(F.broadcast(most))
    return old.unionByName(numbered.withColumn(key, (F.col("_most") + F.col("_before") + F.col("_n")).cast(old.schema[key].dataType)).select(*old.columns))


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks as a store keeps them: unknown offsets 0, no parent an empty text."""
    return chunks.withColumn("start_char", F.coalesce("start_char", F.lit(0))).withColumn("end_char", F.coalesce("end_char", F.lit(0))).withColumn("parent_id", F.coalesce("parent_id", F.lit("")))


def restored_chunks(stored: DataFrame) -> DataFrame:
    """Chunks from a store: an empty parent is none; an offset of 0 stays."""
    return stored.withColumn("parent_id", F.nullif("parent_id", F.lit("")))


def store_statistics(vectors: DataFrame, collection: str, vector: str = "vector") -> DataFrame:
    """(collection, num_vectors, num_chunks): vectors that are there, and chunks they stand for."""
    return vectors.agg(F.count_if(F.size(vector) > 0).alias("num_vectors"), F.countDistinct("chunk_id").alias("num_chunks")).select(F.lit(collection).alias("collection"), "num_vectors", "num_chunks")


def response_times(rows: DataFrame, started: str, ended: str) -> DataFrame:
    """Rows with seconds, not below 0, and success: whether both times are there; 0 seconds where not."""
    there = F.col(started).isNotNull() & F.col(ended).isNotNull()
    s = (F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1_000_000
    return rows.withColumn("seconds", F.when(there, F.greatest(F.lit(0.0), s)).otherwise(0.0)).withColumn("success", there)


def prepared_text(text: Column, model: str, query: bool) -> Column:
    """A text as a model wants it: models of the e5 kind tell queries from passages by a word before them."""
    return F.concat(F.lit("query: " if query else "passage: "), F.coalesce(text, F.lit(""))) if "e5" in model.lower() else F.coalesce(text, F.lit(""))


def translated(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, language, text) of each wanted (key, language): its text, else the English one, else the key. ``texts``: (key,
    language, text)."""
    own = wanted.join(texts, ["key", "language"], "left")
    english = texts.where("language = 'en'").select("key", F.col("text").alias("_en"))
    return own.join(english, "key", "left").select("key", "language", F.coalesce("text", "_en", "key").alias("text"))


# --- exams


def fallback_exams(requests: DataFrame, key: str, language: str, count: str) -> DataFrame:
    """(key, no, type, question, options, answer, topic): questions for every request where no exam could be made: from 1 to
    10, the types in turn."""
    n = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.col(count), F.lit(1))))
    x = requests.select(key, language, F.explode(F.sequence(F.lit(1), n)).alias("no"))
    kind = F.element_at(F.array(*[F.lit(t) for t in EXAM_TYPES]), F.pmod(F.col("no") - 1, F.lit(3)) + 1)

    def of(code: str) -> dict[str, Column]:
        question, choices, truths, free, topic = EXAM_TEXTS[code]
        lists = F.when(kind == "multiple_choice", F.array(*[F.lit(c) for c in choices])).when(kind == "true_false", F.array(*[F.lit(c) for c in truths])).otherwise(F.array().cast(NONE))
        return {"question": _filled(question, F.col("no").cast("string")), "options": lists, "answer": F.coalesce(F.get(lists, F.lit(0)), F.lit(free)), "topic": F.lit(topic)}

    he, en = of("he"), of("en")
    return x.select(key, "no", kind.alias("type"), *[by_language(F.col(language), he[c], en[c]).alias(c) for c in en])


def exam_results(answers: DataFrame, by: str, language: Column | None = None) -> DataFrame:
    """(by, score, right, wrong, weak_topics, weak_sections, recommendation) from (by, question_no, topic, section_title,
    is_correct): percent rounded half to even; topics and sections of wrong answers in the order in which they first come,
    blank ones left out; then what to do next."""
    wrong = ~F.col("is_correct")
    firsts = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.when(wrong, F.struct("question_no", c)))), lambda x: x[c]), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    extra = [F.min(language).alias("_language")] if language is not None else []
    x = answers.groupBy(by).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("right"), firsts("topic").alias("weak_topics"), firsts("section_title").alias("weak_sections"), *extra)
    lang = F.col("_language") if extra else F.lit("en")

    def advice(code: str) -> Column:
        section, topic, neither = ADVICE[code]
        return F.when(F.size("weak_sections") > 0, _filled(section, F.get("weak_sections", F.lit(0)))).when(F.size("weak_topics") > 0, _filled(topic, F.get("weak_topics", F.lit(0)))).otherwise(F.lit(neither))

    return x.select(by, F.bround(F.col("right") * 100 / F.greatest(F.lit(1), F.col("n"))).cast("int").alias("score"), "right", (F.col("n") - F.col("right")).alias("wrong"), "weak_topics", "weak_sections", by_language(lang, advice("he"), advice("en")).alias("recommendation"))


def answered(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers that were given."""
    return answers.where(F.col(answer).isNotNull())


def weak_sections(scores: DataFrame, least: float = 80.0) -> DataFrame:
    """(session_id, weak_sections): titles of sections with a score below ``least``, each once, in the sections' order.
    ``scores``: (session_id, section_number, title, quiz_score)."""
    low = scores.where((F.col("quiz_score") < least) & (F.coalesce("title", F.lit("")) != "")).groupBy("session_id", "title").agg(F.min("section_number").alias("no"))
    return low.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "title"))), lambda x: x["title"]).alias("weak_sections"))


def section_quiz(sections: DataFrame, cloze: DataFrame | None = None) -> DataFrame:
    """(session_id, section_number, no, type, question, options, answer, source_page): of each section a question with a gap
    where there is one (``cloze``: session_id, section_number, prompt, answer, options), one to judge and one to answer
    freely, on its first concept or else its title."""
    concept = F.coalesce(F.nullif(F.get("key_concepts", F.lit(0)), F.lit("")), "title")
    none = F.array().cast(NONE)
    true = F.struct(F.lit(2).alias("no"), F.lit("true_false").alias("type"), F.concat(F.lit("True or False: "), concept, F.lit(" is discussed in this section.")).alias("question"), F.array(F.lit("True"), F.lit("False")).alias("options"), F.lit("True").alias("answer"))
    short = F.struct(F.lit(3).alias("no"), F.lit("short_answer").alias("type"), F.concat(F.lit("In one sentence, explain why "), concept, F.lit(" matters in this section.")).alias("question"), none.alias("options"), F.lit("A strong answer should use the section text and mention the main idea clearly.").alias("answer"))
    two = sections.select("session_id", "section_number", F.col("start_page").alias("source_page"), F.explode(F.array(true, short)).alias("q")).select("session_id", "section_number", "q.*", "source_page")
    if cloze is None:
        return two
    one = cloze.join(sections.select("session_id", "section_number", F.col("start_page").alias("source_page")).distinct(), ["session_id", "section_number"])
    return two.unionByName(one.select("session_id", "section_number", F.lit(1).alias("no"), F.lit("multiple_choice").alias("type"), F.col("prompt").alias("question"), "options", "answer", "source_page"))


# --- texts about sections and pages


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("Page "), start.cast("string"))).otherwise(F.concat(F.lit("Pages "), start.cast("string"), F.lit("-"), end.cast("string")))


def _joined(by: str, order: str, block: str, name: str) -> tuple[Column, str]:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda x: x[block]), "\n\n").alias(name), by


def plan_text(sections: DataFrame) -> DataFrame:
    """(session_id, plan): lines on each section of a session, in order; what is empty has no line."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    listed = lambda c, n, glue: F.array_join(F.slice(F.coalesce(c, F.array().cast(NONE)), 1, n), glue)
    block = F.concat_ws(
        "\n", F.concat(F.lit("Session "), F.col("section_number").cast("string"), F.lit(": "), F.coalesce("title", F.lit(""))), F.when(F.col("start_page") == F.col("end_page"), F.concat(F.lit("Page: "), F.col("start_page").cast("string"))).otherwise(F.concat(F.lit("Pages: "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))),
        F.concat(F.lit("Estimated time: "), F.coalesce("estimated_minutes", F.lit(0)).cast("string"), F.lit(" minutes")), F.concat(F.lit("Difficulty: "), F.coalesce("difficulty", F.lit(""))), F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))), some("Key concepts: ", listed("key_concepts", 8, ", ")), some("Learning objectives: ", listed("learning_objectives", 4, "; ")),
    )
    text, by = _joined("session_id", "section_number", "block", "plan")
    return sections.select("session_id", "section_number", block.alias("block")).groupBy(by).agg(text)


def study_text(sections: DataFrame) -> DataFrame:
    """(session_id, text): title and text of each section one after the other."""
    text, by = _joined("session_id", "section_number", "block", "text")
    return sections.select("session_id", "section_number", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("section_text", F.lit(""))).alias("block")).groupBy(by).agg(text)


def pages_text(pages: DataFrame, scope: str = "scope", most: int = 14_000) -> DataFrame:
    """(scope, context): the beginning of every page with text, of 120 to 1,200 characters as the number of pages has it,
    under its number, all together at most ``most`` characters. Pages beyond the budget are found by a running sum and never gathered."""
    n = pages.groupBy(scope).agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(120), F.least(F.lit(1200), F.floor(F.lit(most) / F.col("n")))).cast("int")
    x = pages.join(n, scope).select(scope, "page_number", "page_id", F.substring(tx.clean("text"), F.lit(1), each).alias("t")).where("t <> ''")
    x = x.withColumn("block", F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit("\n"), F.col("t")))
    w = Window.partitionBy(scope).orderBy("page_number", "page_id")
    x = x.withColumn("before", F.sum(F.length("block") + 2).over(w) - F.length("block") - 2).where(F.col("before") < most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "block"))), lambda p: p["block"])
    return x.groupBy(scope).agg(F.substring(F.array_join(parts, "\n\n"), 1, most).alias("context"))


def ranked_pages(questions: DataFrame, pages: DataFrame, k: int = 8) -> DataFrame:
    """(question_id, page_number, page_id, score, rank): pages of a question's document by how many of its words they have,
    and one more within the pages of its section (start_page, end_page, null for none); none with 0."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_PAGE_TERM), F.lit(0)))
    q = questions.select("question_id", "scope", F.explode(F.filter(words(F.col("question")), lambda w: ~w.isin(PAGE_STOP))).alias("w"))
    # only words that are asked for are taken from the pages
    asked = q.select("scope", "w").distinct()
    p = pages.where(tx.clean("text") != "").select("scope", "page_number", "page_id", F.explode(words(F.col("text"))).alias("w")).join(asked, ["scope", "w"], "left_semi")
    hit = q.join(p, ["scope", "w"]).groupBy("question_id", "page_number", "page_id").agg(F.count("*").alias("score"))
    inside = questions.where("start_page <= end_page").select("question_id", "scope", F.explode(F.sequence("start_page", "end_page")).alias("page_number")).join(pages.where(tx.clean("text") != "").select("scope", "page_number", "page_id"), ["scope", "page_number"])
    both = hit.unionByName(inside.select("question_id", "page_number", "page_id", F.lit(1).cast("bigint").alias("score"))).groupBy("question_id", "page_number", "page_id").agg(F.sum("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "page_number", "page_id"))).where(F.col("rank") <= k)


def requested_count(question: Column | str, default: int = 5) -> Column:
    """The first number from 1 to 10 that a question has as a word, else the default."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(tx.col(question), F.lit("")), r"\b(10|[1-9])\b", 1), F.lit("")).cast("int"), F.lit(default))


def overview_ideas(chunks: DataFrame, k: int = 5) -> DataFrame:
    """(scope, no, idea): the first sentence of each chunk, in order, under its section's title, each once whatever its case."""
    text = tx.clean("text")
    detail = F.coalesce(F.nullif(F.get(tx.sentences(text), F.lit(0)), F.lit("")), F.rtrim(F.substring(text, 1, 180)))
    x = chunks.withColumn("idea", F.concat(F.coalesce(F.nullif(F.trim("section_title"), F.lit("")), F.lit("Study section")), F.lit(": "), detail)).where(detail != "")
    first = x.groupBy("scope", F.lower("idea").alias("low")).agg(F.min(F.struct("page_number", "chunk_id", "idea")).alias("f"))
    return first.withColumn("no", F.row_number().over(Window.partitionBy("scope").orderBy("f.page_number", "f.chunk_id"))).where(F.col("no") <= k).select("scope", "no", F.col("f.idea").alias("idea"))


def review_items(sections: DataFrame, merged: DataFrame, averages: DataFrame, k: int = 3) -> DataFrame:
    """(session_id, section_number, rank, topic, reason): the first sections that are not completed, with their first concept
    or title, and whether it is for low quizzes (a mean above 0 and below 80). ``averages``: (session_id, average)."""
    done = merged.where("completed = 1").select("session_id", "section_number").distinct()
    left = sections.join(done, ["session_id", "section_number"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("section_number"))).where(F.col("rank") <= k)
    low = (F.col("average") > 0) & (F.col("average") < 80)
    topic = F.coalesce(F.nullif(F.get("key_concepts", F.lit(0)), F.lit("")), "title")
    return left.join(averages, "session_id", "left").select("session_id", "section_number", "rank", topic.alias("topic"), F.when(low, "low quiz").otherwise("not completed").alias("reason"))


def text_signature(pages: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, signature): number of pages, characters and their numbers: changes where a document does."""
    return pages.groupBy(scope).agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))), F.lit(0)).cast("string"), F.sha2(F.array_join(F.array_sort(F.collect_list("page_number")), ","), 256)).alias("signature"))
