"""Layout, chapters, sections and units against their definitions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators.layout import ELEMENTS, SPANS, TREE, Profile, elements_of, flatten_layout, page_range
from lectern.operators.segments import chapter_spans, in_sections, page_spans, section_texts, units_of

PROFILE = Profile(code_font="Mono", head_font="Head", chapter_size=20.0, figure_min_area=100, section_re=r"(\d+\.\d+)", chapter_re=r"Chapter\s+(\d+)")


def elements(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, *r) for i, r in enumerate(rows)], ELEMENTS)


def one_chapter(df, chapter):
    return df.withColumn("chapter", F.lit(chapter)).withColumn("span_ord", F.lit(1).cast("long"))


def segment(df, chapter="6"):
    sectioned = in_sections(one_chapter(df, chapter), PROFILE)
    units = [(r.text, r.section, r.page, r.is_code) for r in units_of(sectioned).orderBy("doc_id", "unit_ord").collect()]
    return units, {r.section: r.section_text for r in section_texts(sectioned).collect()}


def test_prose_and_code(spark):
    df = elements(
        spark,
        [
            ("heading", "Chapter 6", 1, 1), ("heading", "A title", 1, 1), ("para", "p1", 1, 0), ("para", "p2", 2, 0), ("heading", "6.1 One", 2, 2), ("para", "p3", 2, 0),
            ("figure", "[FIGURE 9x9]", 2, 0), ("para", "p4", 3, 0), ("code", "x = 1", 3, 0), ("para", "p5", 3, 0), ("heading", "Not numbered", 3, 2), ("heading", "6.2 Empty", 4, 2),
            ("heading", "Chapter 7", 5, 1), ("para", "never", 5, 0),
        ],
    )
    units, texts = segment(df)
    assert units == [("p1\np2", "6", 1, False), ("p3\np4", "6.1", 2, False), ("x = 1", "6.1", 3, True), ("p5", "6.1", 3, False)]
    assert texts == {"6": "p1\np2", "6.1": "p3\np4\nx = 1\np5", "6.2": ""}


def expected(rows, chapter):
    """Units and section texts, each from its definition: the end of the chapter, the section of each row, runs of equal kinds."""
    told = [r for r in rows if r[0] != "figure"]
    bodies = [i for i, (kind, _, _, level) in enumerate(told) if kind != "heading" or level == 2]
    ends = [i for i, (kind, _, _, level) in enumerate(told) if bodies and i > bodies[0] and kind == "heading" and level == 1]
    told = told[: min(ends, default=len(told))]

    def section_of(i):
        heads = [re.match(PROFILE.section_re, text.strip()) for kind, text, _, level in told[: i + 1] if kind == "heading" and level == 2]
        return ([m[1] for m in heads if m] or [chapter])[-1]

    rows = [(kind, text, page, section_of(i)) for i, (kind, text, page, _) in enumerate(told)]
    units = []
    for kind, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        if kind == "para":
            units.append(("\n".join(r[1] for r in group), group[0][3], group[0][2], False))
        elif kind == "code":
            units += [(text, section, page, True) for _, text, page, section in group]
    texts = {s: "\n".join(r[1] for r in rows if r[3] == s and r[0] != "heading") for s in {r[3] for r in rows}}
    return units, texts


def test_segments_match_their_definition(spark):
    rng = random.Random(6)
    docs = {}
    for d in range(40):
        docs[d] = []
        for i in range(rng.randint(0, 25)):
            kind = rng.choices(["para", "code", "figure", "heading"], [6, 2, 1, 3])[0]
            level = rng.choices([1, 2], [1, 6])[0] if kind == "heading" else 0
            docs[d].append((kind, f"{rng.randint(1, 3)}.{rng.randint(1, 3)} t{i}" if rng.random() < 0.7 else f"t{i}", i // 3, level))
    rows = [(d, i, *r) for d, rs in docs.items() for i, r in enumerate(rs)]
    sectioned = in_sections(one_chapter(spark.createDataFrame(rows, ELEMENTS), "6"), PROFILE)
    units, texts = {}, {}
    for r in units_of(sectioned).orderBy("doc_id", "unit_ord").collect():
        units.setdefault(r.doc_id, []).append((r.text, r.section, r.page, r.is_code))
    for r in section_texts(sectioned).collect():
        texts.setdefault(r.doc_id, {})[r.section] = r.section_text
    for d, rs in docs.items():
        want = expected(rs, "6")
        assert units.get(d, []) == want[0]
        assert texts.get(d, {}) == want[1]


def test_chapters(spark):
    rows = [("para", "front", 1, 0), ("heading", " Chapter 1 Intro", 2, 1), ("para", "a", 2, 0), ("heading", "see Chapter 9", 2, 1), ("heading", "Chapter 2", 3, 1), ("heading", "Chapter 3", 3, 2), ("para", "back", 9, 0)]
    got = [(r.ord, r.chapter, r.span_ord, r.span_start, r.span_end) for r in chapter_spans(elements(spark, rows), PROFILE.chapter_re).orderBy("ord").collect()]
    assert got == [(1, "1", 1, 1, 4), (2, "1", 1, 1, 4), (3, "1", 1, 1, 4), (4, "2", 2, 4, 7), (5, "2", 2, 4, 7), (6, "2", 2, 4, 7)]
    assert chapter_spans(elements(spark, rows), "").collect() == []
    ranged = page_spans(elements(spark, rows), {"x": (1, 2), "y": (2, 3)})
    assert sorted((r.chapter, r.ord) for r in ranged.collect()) == [("x", i) for i in range(4)] + [("y", i) for i in range(1, 6)]


@pytest.fixture
def tree(spark):
    head = lambda t, s: (t, "Head-Bold", s)
    body, mono = (lambda t: (t, "Serif", 14.0)), (lambda t: (t, "MonoHead", 10.0))
    line = lambda *spans: (list(spans),)
    text = lambda *lines: (0, [0.0, 0.0, 1.0, 1.0], list(lines))
    image = lambda w, h: (1, [0.0, 0.0, w, h], None)
    pages = [
        (1, [text(line(head("Chapter 1", 20.5)), line(head("Bold", 16.0), body(" "), body("x"))), text(line(head("1.1", 16.0), head("Sec", 16.0), body("t"))), text(line(mono("  a = 1  ")), line(body("   ")))]),
        (2, [image(5.0, 5.0), text(line(mono("  b = 2"), body(" "))), image(20.7, 10.2), text(line(mono("c")), line(mono("d"), body("e")))]),
    ]
    return spark.createDataFrame([(7, pages)], TREE)


def test_layout(spark, tree):
    spans = flatten_layout(tree)
    assert set(spans.columns) == {c.split()[0] for c in SPANS.split(", ")}
    got = [(r.kind, r.text, r.page, r.level) for r in elements_of(spans, PROFILE).orderBy("ord").collect()]
    assert got == [
        ("heading", "Chapter 1", 1, 1), ("para", "Bold x", 1, 0), ("heading", "1.1Sect", 1, 2), ("code", "  a = 1\n  b = 2", 1, 0),
        ("figure", "[FIGURE 20x10]", 2, 0), ("code", "c", 2, 0), ("para", "de", 2, 0),
    ]
    assert page_range(spans, 0, None).count() == spans.count() == page_range(spans, None, 99).count()
    assert {r.page for r in page_range(spans, 2, 2).collect()} == {2}
    assert page_range(spans, 5, 9).collect() == []
