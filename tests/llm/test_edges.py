"""Nulls, empty texts and tables, repeated rows and foreign columns."""

from __future__ import annotations

import pytest

from keyfathom.llm import line_dedup, main_text, ngram_join, pivots, quality
from keyfathom.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n long, pos int"
LINE = "one two three four five six seven eight"
ROWS = [(1, None, None, None, 1, 1), (2, "", "en", "s", 1, 1), (3, LINE, "en", "s", 1, 1), (4, LINE, "en", None, 1, 1),
        (4, LINE, "en", None, 1, 1), (None, LINE, "en", "s", 1, 1), (5, "a", "en", "s", None, None),
        (6, "x " * 50_000, "en", "s", 1, 1)]


@pytest.fixture
def docs(spark, table):
    ship(spark)
    return table(DOCS, *ROWS)


def test_documents(docs):
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_documents(docs).collect()}
    assert near == {1: (0, 1), 2: (0, 2), 3: (4, 3), 4: (4, 3), None: (4, None), 5: (1, 5), 6: (1, 6)}
    lines = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_digests(docs).collect())
    assert lines == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 0), (6, 0)]
    assert not any(r.kept for r in quality.judged(docs).collect())


def test_empty_tables(spark, table):
    ship(spark)
    none = table(DOCS, *ROWS).where("false")
    assert ngram_join.near_documents(none).count() == 0
    assert line_dedup.line_digests(none).count() == 0
    assert quality.judged(none).count() == 0


def test_vectors_and_pages(spark, table):
    ship(spark)
    rows = pivots.near_vectors(table("vec_id long, embedding array<float>, root long", (1, None, 0), (2, [], 0),
                                     (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0),
                                     (6, [1.0, 2.0], 0), (7, [2.0, 4.0], 0), (8, [1.0, 2.0], 0)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows.collect()} == {
        1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (2, 6), 7: (2, 6), 8: (2, 6)}
    page = ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two<div class='comments'>no</div><p>three"
            "<!-- x --><script>var p='</p>'</script></article><footer>end")
    pages = main_text.main_texts(table("page_id long, url string, html string, host int", (1, None, page, 1),
                                       (2, "http://a.b/", None, 1), (3, "http://a.b/", "", 1)))
    assert {r.page_id: r.text for r in pages.collect()} == {1: "A & B\none two\nthree", 2: "", 3: ""}
