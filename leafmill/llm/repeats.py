"""Lines repeated over the pages of one source, as blocks, and the pages without them.

Lines are compared by their letters in lower case. A graph has a source's lines as nodes, weighted by the pages that
hold them, and an edge for two such lines one after the other, weighted by the pages on which they follow. Nodes and
edges of high support stay; connected components are the boilerplate blocks; every occurrence of a block's line goes. The
edges also tell what belongs to an occurrence though it is not the same: where a block has a line between two of its lines,
and a page has some other line there, that line is the block's, misread or otherwise changed on this page (a gap).

A page is reduced to the hashes of its lines before anything is moved. Support is pre-aggregated; a source with a third
of all pages is spread over hashed parts. What is gathered by source is the kept nodes and edges only: a line kept at a
share s of the pages leaves at most (mean lines of a page) / s kept lines in a source, however many pages it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.tables import settle

MIN_PAGES, MIN_SHARE = 5, 0.15
#: A source's pages meet its kept lines in parts of about so many pages.
PART_PAGES = 2_000


def _page_lines(pages: DataFrame, page_id: str, source_id: str, text: str) -> DataFrame:
    """(page_id, source_id, lines): hash of each line's letters in lower case, 0 where it has none; one row a page."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(source_id).alias("source_id"), F.col(text).alias("text"))
    own = own.where(F.col("page_id").isNotNull() & (F.trim("source_id") != "") & F.col("text").rlike(r"[^\s\p{Z}]"))
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\n]+", "")
    lines = F.transform(F.split(letters, "\n", -1), lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x)))
    return own.select("page_id", "source_id", lines.alias("lines")).groupBy("page_id").agg(F.min_by(F.struct("source_id", "lines"), F.xxhash64("source_id", "lines")).alias("p")).select("page_id", "p.source_id", "p.lines")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Block of each kept line of one source: connected components over its kept edges (``b`` = 0: a node alone)."""
    nodes = np.unique(pdf["a"].to_numpy(dtype=np.int64))
    edges = pdf[pdf["b"] != 0]
    parent = np.arange(len(nodes))
    a, b = np.searchsorted(nodes, edges["a"].to_numpy(dtype=np.int64)), np.searchsorted(nodes, edges["b"].to_numpy(dtype=np.int64))
    while len(a):  # least label over the edges, with pointer jumping
        low = parent.copy()
        np.minimum.at(low, a, parent[b])
        np.minimum.at(low, b, parent[a])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "line": nodes, "block": nodes[parent]})


def repeated_lines(pages: DataFrame, page_id: str = "page_id", source_id: str = "source_id", text: str = "text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, blocks, gaps).

    occurrences: (page_id, source_id, line_no, line, block), a row for every line, numbered from 1, whose letters stand on at
    least ``min_pages`` pages and ``min_share`` of the pages of its source. blocks: (source_id, line, block, pages). gaps:
    (page_id, line_no), lines in the place of a block's line between two others of the block.

    Pages are distinct page_id with text that is not blank; null and blank source_id, null page_id and lines without
    letters are left out. Of several texts under one page_id one is taken, always the same. Other columns are ignored.
    """
    lined = settle(_page_lines(pages, page_id, source_id, text))
    share = settle(lined.groupBy("source_id").agg(F.count("*").alias("in_source")))
    # only sources of more than one part are looked up; there are at most pages / PART_PAGES of them
    parts = share.where(F.col("in_source") > PART_PAGES).select("source_id", F.ceil(F.col("in_source") / PART_PAGES).alias("parts"))
    lined = lined.join(parts, "source_id", "left").withColumn("part", F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    node = lined.select("source_id", F.explode(F.array_distinct(F.filter("lines", lambda x: x != 0))).alias("line")).groupBy("source_id", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    node = settle(node.join(share, "source_id").where(F.col("pages") >= F.col("in_source") * F.lit(min_share) - 1e-9).select("source_id", "line", "pages", "in_source"))

    def spread(by_source: DataFrame) -> DataFrame:
        """Every source's bounded list once for each part of its pages."""
        last = F.coalesce("parts", F.lit(1).cast("bigint")) - 1
        return by_source.join(parts, "source_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("parts")

    kept = spread(node.groupBy("source_id").agg(F.collect_set("line").alias("kept")))
    numbered = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("line"))), lambda x: x["line"] != 0)
    known = F.transform(numbered, lambda x: F.struct(x["no"].alias("no"), x["line"].alias("line"), F.array_contains("kept", x["line"]).alias("keep")))

    def marked_in(w):
        """Kept lines of a page's lines with letters, with the line before if it is kept, or else with the one before that."""
        one, two = (lambda i: F.when(i >= 1, F.get(w, i - 1))), (lambda i: F.when(i >= 2, F.get(w, i - 2)))
        mark = lambda x, i: F.struct(x["no"].alias("line_no"), x["line"].alias("line"), x["keep"].alias("keep"), F.when(one(i)["keep"], one(i)["line"]).alias("before"), F.when(~one(i)["keep"] & two(i)["keep"], F.struct(two(i)["line"].alias("line"), one(i)["no"].alias("no"))).alias("over"))
        return F.filter(F.transform(w, mark), lambda x: x["keep"])

    # as the only element of an array the lines are made once, and not anew for each look at a line before
    marks = F.get(F.transform(F.array(known), marked_in), F.lit(0))
    marked = settle(lined.join(kept, ["source_id", "part"]).select("page_id", "source_id", "part", marks.alias("marks")).where(F.size("marks") > 0))
    pairs = F.array_distinct(F.transform(F.filter("marks", lambda x: x["before"].isNotNull()), lambda x: F.struct(x["before"].alias("a"), x["line"].alias("b"))))
    edge = marked.select("source_id", F.explode(pairs).alias("e")).groupBy("source_id", "e.a", "e.b").agg(F.count("*").alias("n"))
    edge = edge.join(share, "source_id").where((F.col("n") >= min_pages) & (F.col("n") >= F.col("in_source") * F.lit(min_share) - 1e-9)).select("source_id", "a", "b")
    edge = settle(edge)
    graph = node.select("source_id", F.col("line").alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(edge)
    blocks = settle(graph.groupBy("source_id").applyInPandas(_components, "source_id string, line bigint, block bigint").join(node.select("source_id", "line", "pages"), ["source_id", "line"]))
    block_of = spread(blocks.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "block"))).alias("block_of")))
    occurrences = marked.join(block_of, ["source_id", "part"]).select("page_id", "source_id", "block_of", F.explode("marks").alias("m")).select("page_id", "source_id", "m.line_no", "m.line", F.try_element_at("block_of", F.col("m.line")).alias("block"))
    # a -> m -> b is in the block, and this page has another line between a and b
    way = edge.select("source_id", "a", F.col("b").alias("m")).join(edge.select("source_id", F.col("a").alias("m"), "b"), ["source_id", "m"]).select("source_id", "a", "b").distinct()
    over = marked.select("page_id", "source_id", F.explode(F.filter("marks", lambda x: x["over"].isNotNull())).alias("m")).select("page_id", "source_id", F.col("m.over.line").alias("a"), F.col("m.line").alias("b"), F.col("m.over.no").alias("line_no"))
    gaps = over.join(way, ["source_id", "a", "b"], "left_semi").select("page_id", "line_no").distinct()
    return occurrences, blocks, gaps


def without_repeats(pages: DataFrame, occurrences: DataFrame, page_id: str = "page_id", text: str = "text") -> DataFrame:
    """``pages`` with the occurrences' lines taken out of ``text``; rows without any stay as they are, repeated rows too."""
    gone = occurrences.groupBy(F.col("page_id").alias("_page")).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("int")))
    out = pages.join(gone, F.col(page_id) == F.col("_page"), "left")
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))).drop("_page", "_gone")
