"""Queries over whole tables, against the registered SQL or plain loops."""

import re
from pathlib import Path

import duckdb
import pytest

from lectern.operators import evaluate
from lectern.plans.catalog import QUERIES
from lectern.plans.oracle import ORACLE
from lectern.sources.html import html_elements

from .test_catalog import rows


@pytest.mark.parametrize("name", ["page_range_scan", "prefix_expand", "eval_hit_rate"])
def test_larger_tables(spark, name):
    """Tables whose ids go beyond the smallest ones."""
    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, want = QUERIES[name](spark, "/root/testdata/sf0.01"), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_holders_are_those_that_contain(spark):
    """By runs of words or, for short passages, by comparing: the documents that hold a passage as it stands."""
    texts = ["a b c d e f g h i j k", "xa b c d e f g h i jx k", "a b c  d e f g h i j", "b c", "abc", "", None, "a\nb c d", "zz a b c d e f g h i j"]
    passages = ["a b c d e f g h i j", "a b c", "b", "b c", "c d", "d e f", "a\nb c", " b c ", "nothing like it", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "case_id long, query string")
    got = sorted((r.doc_id, r.case_id) for r in evaluate.holders(docs, items).collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, q in enumerate(passages) if t is not None and q in t)
    assert evaluate.holders(docs, items.limit(0)).collect() == []


def test_cases_are_whole_passages(spark, tmp_path):
    """Every item is a case, and a document with the start of a passage alone doesn't hold it."""
    passages = {i: f"passage{i} " + " ".join(f"word{i}x{j}" for j in range(20)) for i in (3, 11, 12, 500)}
    docs = [(1, passages[3][:70], "de", "start"), (2, "x " + passages[3] + " y", "de", "late"), (3, passages[500], "en", "far"), (4, "nothing here", "en", "far")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    top = {(r.case_id, r.id) for r in QUERIES["eval_topk"](spark, str(tmp_path)).collect()}
    assert {(3, 2), (500, 3)} <= top
    assert tuple(QUERIES["eval_hit_rate"](spark, str(tmp_path)).first()) == (0.5, 4)


BLOCKS = set("address article aside blockquote body div footer form h1 h2 h3 head header hr html li main nav ol p pre section table td title tr ul".split())
INLINE = [
    ("<p><b>whole paragraph<br>second</b> line <a href='x'>link</a>ed</p>tail<p>next", [("para", 0, "whole paragraph\nsecond line linked"), ("para", 0, "next")]),
    ("<ul><li><a>word</a></li><li>a<div>b</div>c</ul>after", [("para", 0, "word"), ("para", 0, "a\nb\nc")]),
    ("<h2>head <i>ing</i></h2><p>open<footer>foot</footer>", [("heading", 2, "head ing"), ("para", 0, "open")]),
    ("<p>a<script>var t='</p>' + '<b>x</b>'</script>z <!-- no -->1 < 2 <b></b></p>", [("para", 0, "az 1 < 2")]),
    ("<p></p><li><br></li>", []),
]


def test_elements_go_on_over_inline_tags(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(INLINE)], "page_id long, html string")
    got = html_elements(pages).orderBy("page_id", "pos").collect()
    for i, (_, want) in enumerate(INLINE):
        assert [(r.kind, r.level, r.text) for r in got if r.page_id == i] == want


def test_elements_of_pages_match_a_loop(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = []
    for page_id, html in pages.select("page_id", "html").collect():
        html = re.sub(r"(<(?:script|style)>)(.*?)(</)", lambda m: m[1] + m[2].replace("<", " ") + m[3], html, flags=re.S)
        plain, at = [], None
        for m in re.finditer(r"<(/?)([a-z0-9]*)[^>]*>([^<]*)", html):
            if m[2] in BLOCKS:
                at = None
                if not m[1] and m[2] in ("title", "h1", "h2", "h3", "p", "li"):
                    plain.append([m[2], ""])
                    at = plain[-1]
            if at:
                at[1] += m[3]
        want += [(page_id, "para" if tag in ("p", "li") else "heading", text.strip()) for tag, text in plain if text.strip()]
    got = html_elements(pages).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.kind, r.text) for r in got] == sorted(want, key=lambda x: x[0])
