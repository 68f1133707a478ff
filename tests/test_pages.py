import hashlib

import pytest

from leafmill.queries import load

QUERIES = load()[0]
TEXT = "CHAPTER ONE\nThis page has one sentence of its own."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One document whose pages 2 and 3 have their name in the metadata only, and a page without any name."""
    d = tmp_path_factory.mktemp("pages")
    rows = [(1, "a.pdf", 1, TEXT, {"source": "a.pdf"}), (2, "", 2, TEXT + " Two.", {"source": "a.pdf"}), (3, None, 3, TEXT + " Three.", {"source": "a.pdf"}), (4, " ", 4, TEXT, None), (5, "b.pdf", 1, TEXT, None), (2, "", 2, TEXT + " Two.", {"source": "a.pdf"})]
    spark.createDataFrame(rows, "page_id bigint, source_id string, page_number int, text string, metadata map<string,string>").write.parquet(str(d / "doc_pages.parquet"))
    spark.createDataFrame([(7, "a.pdf")], "id bigint, filename string").write.parquet(str(d / "study_sessions.parquet"))
    spark.createDataFrame([(1, 7, 1, "One", 1, 2)], "id bigint, session_id bigint, section_number int, title string, start_page int, end_page int").write.parquet(str(d / "study_sections.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["page_stats", "sentence_counts", "heading_pages"])
def test_pages_without_source_id_have_their_rows(spark, folder, name):
    assert sorted(r.page_id for r in QUERIES[name](spark, folder).collect()) == [1, 2, 3, 4, 5]


def test_documents_have_all_their_pages(spark, folder):
    assert sorted(map(tuple, QUERIES["readable_pages"](spark, folder).collect())) == [("a.pdf", 3, 3), ("b.pdf", 1, 1)]
    assert {r.scope for r in QUERIES["suggested_sessions"](spark, folder).collect()} == {"a.pdf", "b.pdf"}
    assert sorted(map(tuple, QUERIES["pages_by_section"](spark, folder).collect())) == [(7, 0, 1), (7, 1, 2)]
    (r,) = QUERIES["section_texts"](spark, folder).collect()
    assert (r.id, r.pages, r.digest) == (1, 2, hashlib.md5(f"{TEXT}\n\n{TEXT} Two.".encode()).hexdigest())
    for name in ("study_plan", "chapter_index", "study_roadmap"):
        assert {r.scope for r in QUERIES[name](spark, folder).collect()} == {"a.pdf", "b.pdf"}
    assert QUERIES["plan_faults"](spark, folder).where("scope is null").count() == 0
    assert max(r.end_page for r in QUERIES["study_plan"](spark, folder).where("scope = 'a.pdf'").collect()) == 3
