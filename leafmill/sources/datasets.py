"""Readers of evaluation sets, corpora in JSON, saved sessions and files of documents; writers of reports and quizzes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators.assemble import first_words
from leafmill.operators.chunking import normalized
from leafmill.sources.tables import settle

PAGE = "page_number int, text string, source_id string, metadata map<string,string>"
_EVAL = "question string, answer string, source_text string, pdf string, page int"


def evaluation_set(spark: SparkSession, path: str, dataset: str, pdf: str | None = None) -> DataFrame:
    """(question, answer, source_text, pdf, page, metadata, dataset) of a JSON file with a list of objects, lists in it taken apart.

    Rows without question or answer, rows for another PDF and what is no object are left out; a missing source text is
    the empty one. Fields of other names become metadata.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("j"))
    nested = raw.where(F.trim("j").startswith("[")).select(F.explode(F.from_json("j", "array<string>")).alias("j"))
    rows = raw.unionByName(nested).where(F.trim("j").startswith("{"))
    x = rows.select(F.from_json("j", _EVAL).alias("r"), F.from_json("j", "map<string,string>").alias("m"))
    s = lambda c: F.trim(F.coalesce(F.col(f"r.{c}"), F.lit("")))
    known = ["question", "answer", "source_text", "pdf", "page", "metadata"]
    own = F.coalesce(F.from_json(F.try_element_at("m", F.lit("metadata")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.map_filter("m", lambda k, v: ~k.isin(known))
    x = x.select(s("question").alias("question"), s("answer").alias("answer"), s("source_text").alias("source_text"), F.coalesce(F.nullif(s("pdf"), F.lit("")), F.lit(pdf or "")).alias("pdf"), F.col("r.page").alias("page"), F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra).alias("metadata"), F.lit(dataset).alias("dataset"))
    x = x.where("question <> '' and answer <> ''")
    return x.where(F.col("pdf") == pdf) if pdf else x


def _object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(at, key, value) of a JSON file with one object, in the file's order; its values read as ``value``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("at", "e")).select("at", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


_SECTION = "struct<text:string,tables:map<string,string>,images:map<string,string>>"


def _section_text(s: Column) -> Column:
    """Text, tables and image marks of a section, each tidied, on lines of their own."""
    parts = F.concat(F.array(normalized(F.coalesce(s["text"], F.lit("")))), F.transform(F.coalesce(F.map_values(s["tables"]), F.array().cast("array<string>")), normalized), F.array(F.coalesce(F.array_join(F.transform(F.map_keys(s["images"]), lambda k: F.concat(F.lit("[image:"), k, F.lit("]"))), " "), F.lit(""))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, title, abstract, section_id, text): the sections of every JSON document in ``root``/corpus."""
    docs = spark.read.text(f"{root}/corpus/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("doc_id"), F.from_json("value", f"title string, abstract string, sections array<{_SECTION}>").alias("d"))
    return docs.select(F.url_decode("doc_id").alias("doc_id"), F.col("d.title").alias("title"), F.col("d.abstract").alias("abstract"), F.posexplode("d.sections").alias("section_id", "s")).select("doc_id", "title", "abstract", "section_id", _section_text(F.col("s")).alias("text"))


def benchmark_questions(spark: SparkSession, root: str, limit: int | None = None, source_chars: int = 180, urls: bool = True) -> DataFrame:
    """(at, query_id, question, answer, source_text, pdf, doc_id, section_id) of a folder with queries, qrels, answers and
    optionally pdf_urls (JSON objects by id) and a corpus: inner joins, the first ``limit`` valid ones in file order."""
    q = _object(spark, f"{root}/queries.json", "struct<query:string,type:string,source:string>").select("at", F.col("key").alias("query_id"), F.trim("value.query").alias("question"))
    r = _object(spark, f"{root}/qrels.json", "struct<doc_id:string,section_id:string>").select(F.col("key").alias("query_id"), F.trim("value.doc_id").alias("doc_id"), F.coalesce(F.col("value.section_id").try_cast("int"), F.lit(0)).alias("section_id"))
    a = _object(spark, f"{root}/answers.json", "string").where("value is not null").select(F.col("key").alias("query_id"), F.trim("value").alias("answer"))
    x = q.join(r, "query_id").join(a, "query_id").where("question <> '' and doc_id <> ''")
    if limit is not None:
        x = x.orderBy("at").limit(limit)
    if urls:
        u = _object(spark, f"{root}/pdf_urls.json", "string").select(F.col("key").alias("doc_id"), F.col("value").alias("pdf"))
        x = x.join(u, "doc_id", "left").withColumn("pdf", F.coalesce("pdf", "doc_id"))
    else:
        x = x.withColumn("pdf", F.col("doc_id"))
    s = corpus(spark, root).select("doc_id", "section_id", first_words(normalized("text"), source_chars).alias("source_text"))
    return x.join(s, ["doc_id", "section_id"], "left").withColumn("source_text", F.coalesce("source_text", F.lit("")))


def corpus_pages(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """DocumentPage rows of the wanted documents (doc_id): a page for each section with text, numbered through."""
    x = sections.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").where("text <> ''")
    line = lambda label, c: F.when(F.coalesce(normalized(c), F.lit("")) != "", F.concat(F.lit(label), normalized(c)))
    body = F.concat_ws("\n", F.concat(F.lit("Document ID: "), "doc_id"), line("Title: ", "title"), line("Abstract: ", "abstract"), F.concat(F.lit("Section "), F.col("section_id").cast("string"), F.lit(": "), "text"))
    # numbers: the sections of earlier documents, and the place among the own ones
    # documents are ranked in ranges of their ids, and the few ranges' counts added up
    n = settle(x.groupBy("doc_id").agg(F.count("*").alias("n")).repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    ranges = n.groupBy("range").agg(F.sum("n").alias("m")).withColumn("start", F.sum("m").over(Window.orderBy("range")) - F.col("m")).select("range", "start")
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("doc_id")) - F.col("n")
    n = n.withColumn("inside", inside).join(ranges, "range").select("doc_id", (F.col("start") + F.col("inside")).alias("before"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_id"))
    return x.withColumn("place", place).join(n, "doc_id").select((F.col("before") + F.col("place")).cast("int").alias("page_number"), body.alias("text"), F.col("doc_id").alias("source_id"), F.create_map().cast("map<string,string>").alias("metadata"))


def saved_pages(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, page_number, text, source_id, metadata) of saved sessions' JSON; what cannot be read has no pages."""
    kind = "struct<pages:array<struct<page_number:int,text:string,source_id:string,metadata:map<string,string>>>>"
    blank, none = F.lit(""), F.create_map().cast("map<string,string>")
    x = payloads.select(key, F.explode(F.from_json(payload, kind)["pages"]).alias("p")).where("p is not null")
    return x.select(key, F.coalesce("p.page_number", F.lit(0)).alias("page_number"), F.coalesce("p.text", blank).alias("text"), F.coalesce("p.source_id", blank).alias("source_id"), F.coalesce("p.metadata", none).alias("metadata"))


def saved_sections(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, section_number, title, start_page, end_page, estimated_minutes, difficulty, summary, key_concepts, learning_objectives)."""
    kind = "struct<sections:array<struct<section_number:int,title:string,start_page:int,end_page:int,estimated_minutes:int,difficulty:string,summary:string,key_concepts:array<string>,learning_objectives:array<string>>>>"
    zero, blank, none = F.lit(0), F.lit(""), F.array().cast("array<string>")
    default = {"section_number": zero, "title": blank, "start_page": zero, "end_page": zero, "estimated_minutes": zero, "difficulty": F.lit("Easy"), "summary": blank, "key_concepts": none, "learning_objectives": none}
    x = payloads.select(key, F.explode(F.from_json(payload, kind)["sections"]).alias("s")).where("s is not null")
    return x.select(key, *[F.coalesce(F.col(f"s.{c}"), v).alias(c) for c, v in default.items()])


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, length, content) of a folder's files; content is only read where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


Parser = Callable[[bytes], list[str]]


def extract_pages(documents: DataFrame, parser: Parser, fallback: Parser | None = None, names: tuple[str, str] = ("primary", "fallback")) -> DataFrame:
    """DocumentPage rows from (name, content) by a parser of bytes to the texts of pages, numbered from 1.

    Where it fails or finds only blank text the fallback is asked; a file neither can read has no pages. metadata has
    the source and the loader. Parsers are the caller's: none is bundled.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"]):
                for loader, f in zip(names, (parser, fallback)):
                    try:
                        texts = f(bytes(content)) if f else []
                    except Exception:  # noqa: BLE001 - an unreadable file is the fallback's
                        texts = []
                    if any((t or "").strip() for t in texts):
                        rows += [(i, t or "", name, {"source": name, "loader": loader}) for i, t in enumerate(texts, 1)]
                        break
            yield pd.DataFrame(rows, columns=["page_number", "text", "source_id", "metadata"])

    return documents.select("name", "content").mapInPandas(read, PAGE)


def report_lines(summary: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(value): lines of a Markdown table, heading first; missing numbers as n/a."""
    shown = [F.coalesce(F.format_number(c, 3) if dict(summary.dtypes)[c] == "double" else F.col(c).cast("string"), F.lit("n/a")) for c in columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
    head = summary.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "at bigint, value string")
    body = summary.select((F.row_number().over(Window.orderBy(order)) + 1).cast("bigint").alias("at"), row.alias("value"))
    return head.unionByName(body).orderBy("at").select("value")


def quiz_lines(questions: DataFrame) -> DataFrame:
    """(question_no, value): a question (question_no, prompt, options, answer) as Markdown."""
    options = F.array_join(F.transform("options", lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")
    return questions.select("question_no", F.concat(F.lit("## Question "), F.col("question_no").cast("string"), F.lit("\n"), F.col("prompt"), F.lit("\n\n"), options, F.lit("\n\n**Correct answer:** "), F.col("answer")).alias("value"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages numbered from 0 as pages from 1, their markup taken out, blank ones left out; a missing source gets a name."""
    first = F.when(F.col("page_number") >= 0, F.col("page_number") + 1)
    name = F.element_at(F.split(F.coalesce(F.nullif("source_id", F.lit("")), F.try_element_at("metadata", F.lit("source")), F.lit("Uploaded PDF")), "/"), -1)
    return pages.withColumn("text", tx.clean_markup("text")).where("text <> ''").withColumn("page_number", first).withColumn("source_id", name)


def benchmark_root(spark: SparkSession, path: str) -> str:
    """The first folder at or below ``path`` that has queries, qrels and answers: itself, or what ends in pdf/arxiv."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pattern in ("", "/official/pdf/arxiv", "/pdf/arxiv", "/*/official/pdf/arxiv", "/*/pdf/arxiv", "/*/*/pdf/arxiv"):
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path + pattern)) or []:
            folder = found.getPath().toString()
            if all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.json")) for n in ("queries", "qrels", "answers")):
                return folder
    raise FileNotFoundError(f"no queries, qrels and answers below {path}")


def rows_as_pages(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """DocumentPage rows of flat rows with a text: a page for each, numbered by ``key`` (an int)."""
    return rows.where(F.trim(text) != "").select(F.col(key).cast("int").alias("page_number"), F.col(text).alias("text"), F.lit(source).alias("source_id"), F.create_map(F.lit("source"), F.lit(source)).alias("metadata"))


def saved_states(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload): each row's other columns as one JSON text, nulls kept."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"}).alias("payload"))
