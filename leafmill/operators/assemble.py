"""Texts put together under a budget of characters, document indexes, citations and labels.

Blocks join by an empty line. A block beyond what is left of the budget is cut at its last whole word; later ones are
left out. What each block has left is a running sum over the blocks of its group in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx


def budgeted(blocks: DataFrame, by: str | list[str], order: list[str], block: str, most: int) -> DataFrame:
    """(``by``, context): the blocks of each group in order, as many as the budget holds; empty and null ones left out.

    A whole block uses its length and two more. As only the last block kept is ever cut, sums over whole blocks say
    how much is left for each.
    """
    full = blocks.where(F.coalesce(F.col(block), F.lit("")) != "")
    w = Window.partitionBy(by).orderBy(*order)
    left = F.lit(most) - (F.sum(F.length(block) + 2).over(w) - (F.length(block) + 2))
    x = full.withColumn("_left", left).withColumn("_no", F.row_number().over(w)).where(F.col("_left") > 0)
    cut = F.rtrim(F.regexp_replace(F.substring(F.col(block), F.lit(1), F.col("_left").cast("int")), r"(?s) [^ ]*\z", ""))
    text = F.when(F.length(block) > F.col("_left"), cut).otherwise(F.col(block))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_no", text.alias("t")))), lambda p: p["t"])
    return x.groupBy(by).agg(F.trim(F.array_join(F.filter(parts, lambda t: t != ""), "\n\n")).alias("context"))


def prompt_blocks(chunks: DataFrame) -> Column:
    """Header and tidy text of a chunk; null where it has none."""
    t = tx.clean("text")
    head = F.concat(F.lit("[Section "), F.coalesce("section_number", F.lit(0)).cast("string"), F.lit(" | "), F.coalesce("section_title", F.lit("Untitled section")), F.lit(" | Page "), F.coalesce("page_number", F.lit(0)).cast("string"), F.lit("]\n"))
    return F.when(t != "", F.concat(head, t))


def texts_in_range(spans: DataFrame, pages: DataFrame, key: str, glue: str = "\n\n", tidy: bool = False) -> DataFrame:
    """(``key``, text): texts of the pages of each span (scope, start_page, end_page) one after the other; blank pages
    left out. An equi-join on the span's page numbers: a span is expanded to its pages and meets each once."""
    own = spans.where("start_page <= end_page").select(key, "scope", F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    t = tx.clean("text") if tidy else F.regexp_replace("text", r"^\s+|\s+\z", "")
    p = pages.select("scope", "page_number", "page_id", t.alias("t")).where("t <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "t"))), lambda x: x["t"])
    return own.join(p, ["scope", "page_number"]).groupBy(key).agg(F.array_join(parts, glue).alias("text"))


def page_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages with section_number and section_title: those of the first section whose range holds the page, else 0."""
    spans = sections.where("start_page <= end_page").select("scope", "section_number", "title", F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    first = spans.groupBy("scope", "page_number").agg(F.min(F.struct("section_number", "title")).alias("s"))
    return pages.join(first, ["scope", "page_number"], "left").select(pages["*"], F.coalesce("s.section_number", F.lit(0)).alias("section_number"), F.when(F.col("s").isNull(), "Unassigned section").otherwise(F.col("s.title")).alias("section_title"))


def chapter_headings(pages: DataFrame) -> DataFrame:
    """(scope, chapter_number, title, start_page, end_page): chapters by headings at the beginning of pages.

    A page's tidy text counts as one line, of which the first 140 characters are looked at if they have at most 14
    words. A number counts on its first page; a chapter ends before the next one, the last one with the document.
    """
    numbers = "|".join(tx.NUMBER_WORDS)
    line = F.rtrim(F.substring(F.get(F.split(tx.clean("text"), r"(?<=\.)\s{2,}"), F.lit(0)), 1, 140))
    named = rf"(?i)^(?:chapter|ch\.?)\s+(\d{{1,2}}|{numbers})(?![\p{{L}}\p{{N}}_])[:.\-\s]*(.*)"
    plain = r"^(\d{1,2})(?:\.\s+|\s+)([A-Z][A-Za-z][^\n]{2,80})"
    strip = lambda c: F.regexp_replace(c, r"^[ :\-]+|[ :\-]+$", "")
    x = pages.select("scope", "page_number", line.alias("line")).where((F.col("line") != "") & (F.size(F.split("line", r"\s+")) <= 14))
    pattern = F.when(F.col("line").rlike(named), 1).when(F.col("line").rlike(plain), 2)
    token = F.lower(F.when(pattern == 1, F.regexp_extract("line", named, 1)).otherwise(F.regexp_extract("line", plain, 1)))
    suffix = strip(F.when(pattern == 1, F.regexp_extract("line", named, 2)).otherwise(F.regexp_extract("line", plain, 2)))
    number = F.coalesce(F.when(token.rlike(r"^\d+$"), token.try_cast("int")), F.nullif(F.array_position(F.array(*[F.lit(w) for w in tx.NUMBER_WORDS]), token), F.lit(0)).cast("int"))
    x = x.where(pattern.isNotNull()).select("scope", "page_number", number.alias("chapter_number"), F.concat(F.lit("Chapter "), number.cast("string"), F.when(suffix != "", F.concat(F.lit(": "), suffix)).otherwise(F.lit(""))).alias("title"))
    first = x.groupBy("scope", "chapter_number").agg(F.min(F.struct("page_number", "title")).alias("f")).select("scope", "chapter_number", "f.title", F.col("f.page_number").alias("start_page"))
    last = pages.where(tx.clean("text") != "").groupBy("scope").agg(F.max("page_number").alias("last"))
    after = F.lead("start_page").over(Window.partitionBy("scope").orderBy("start_page", "chapter_number"))
    return first.withColumn("next", after).join(last, "scope").select("scope", "chapter_number", "title", "start_page", F.greatest("start_page", F.coalesce(F.col("next") - 1, "last")).alias("end_page"))


def document_chapters(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(scope, chapter_number, title, start_page, end_page, matched_by): chapters by headings; where a scope has none, its
    sections (scope, section_number, title, start_page, end_page) stand for chapters, each number once, the first by
    start_page. A section without a title is called by its number; one without a number is left out."""
    heads = chapter_headings(pages).withColumn("matched_by", F.lit("heading"))
    name = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Section "), F.col("section_number").cast("string")))
    own = sections.where("section_number <> 0").select("scope", F.col("section_number").alias("chapter_number"), name.alias("title"), "start_page", "end_page")
    own = own.groupBy("scope", "chapter_number").agg(F.min(F.struct("start_page", "end_page", "title")).alias("s")).select("scope", "chapter_number", "s.title", "s.start_page", "s.end_page")
    rest = own.join(heads.select("scope").distinct(), "scope", "left_anti").withColumn("matched_by", F.lit("section_fallback"))
    return heads.unionByName(rest)


def exam_blocks(sections: DataFrame, texts: DataFrame, key: str, most: int = 12_000) -> DataFrame:
    """(scope, section_number, block): lines on each section: number and title, pages, summary, concepts, excerpt.

    ``sections`` has key, scope, section_number, title, start_page, end_page, summary, key_concepts (array); ``texts``
    (key, text). The excerpt is 300 to 1,200 characters long, by the number of sections of the scope.
    """
    n = F.count("*").over(Window.partitionBy("scope"))
    x = sections.withColumn("n", n).join(texts, key, "left")
    size = F.greatest(F.lit(300), F.least(F.lit(1200), F.floor(F.lit(most) / F.col("n")) - 250)).cast("int")
    concepts = F.array_join(F.slice(F.coalesce("key_concepts", F.array().cast("array<string>")), 1, 8), ", ")
    sample = F.rtrim(F.substring(tx.clean("text"), F.lit(1), size))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Section "), F.col("section_number").cast("string")))
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    pages = F.when(F.col("start_page") == F.col("end_page"), F.concat(F.lit("Page: "), F.col("start_page").cast("string"))).otherwise(F.concat(F.lit("Pages: "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string")))
    block = F.concat_ws("\n", F.concat(F.lit("Section "), F.col("section_number").cast("string"), F.lit(": "), title), pages, some("Summary: ", F.trim("summary")), some("Key concepts: ", concepts), some("Representative text: ", sample))
    return x.select("scope", "section_number", block.alias("block"))


def citation_label(source: Column, metadata: Column, page: Column) -> Column:
    """Source, else the metadata's, else 'document', and the page."""
    return F.concat(F.coalesce(F.nullif(F.trim(source), F.lit("")), F.try_element_at(metadata, F.lit("source")), F.lit("document")), F.lit(", page "), page.cast("string"))


def first_words(text: Column, most: int) -> Column:
    """Whole words from the beginning with one blank between them, as many as ``most`` characters hold."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))
    step = lambda a, w: F.when(a["full"] | (F.length(a["t"]) + F.length(w) + F.when(a["t"] == "", 0).otherwise(1) > most), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["t"], F.when(a["t"] == "", "").otherwise(" "), w).alias("t"), F.lit(False).alias("full")))
    return F.aggregate(words, start, step)["t"]


def chapter_contexts(requests: DataFrame, chapters: DataFrame, pages: DataFrame, most: int = 9_000) -> DataFrame:
    """(request_id, context, sources) for requests (request_id, scope, chapters array<int>): excerpts of the chapters asked
    for, in that order, each under a line with its number, title and pages; the more chapters, the shorter each excerpt.
    sources has number, title, pages and how it was found of each chapter that has a text, in the same order."""
    asked = requests.select("request_id", "scope", F.posexplode("chapters").alias("at", "chapter_number"))
    if "matched_by" not in chapters.columns:
        chapters = chapters.withColumn("matched_by", F.lit("heading"))
    hit = asked.join(chapters, ["scope", "chapter_number"])
    spans = hit.withColumn("key", F.concat_ws("\x1f", F.col("request_id").cast("string"), F.col("at").cast("string")))
    texts = texts_in_range(spans.select("key", "scope", "start_page", "end_page"), pages, "key", " ", tidy=True)
    n = F.count("*").over(Window.partitionBy("request_id"))
    x = spans.join(texts, "key").withColumn("n", n)
    body = tx.excerpt("text", F.greatest(F.lit(600), F.floor(F.lit(most) / F.col("n")).cast("int") - 160))
    head = F.concat(F.lit("[Chapter "), F.col("chapter_number").cast("string"), F.lit(" | "), "title", F.lit(" | Pages "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit("]\n"))
    x = x.withColumn("block", F.concat(head, body))
    used = Window.partitionBy("request_id").orderBy("at")
    room = F.lit(most) - (F.sum(F.length("block") + 2).over(used) - (F.length("block") + 2))
    sources = x.withColumn("room", room).where("room > 0").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("matched_by") == "heading", "chapter").otherwise("study_section").alias("type"), F.col("chapter_number").alias("number"), "title", "start_page", "end_page"))).alias("sources"))
    return budgeted(x, "request_id", ["at"], "block", most).join(sources, "request_id")
