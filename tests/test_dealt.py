"""Words are counted and put together where their document is: only whole rows are shuffled, by their id."""

import re

from lectern.operators import index as ix
from lectern.operators import layout
from lectern.plans.fixtures import LINE_PROFILE, line_spans


def keys_of(df):
    """The keys of each hash exchange of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


def test_lines_are_put_together_where_their_document_is(spark):
    docs = spark.createDataFrame([(1, "A b\n1 2"), (2, ""), (3, None)], "doc_id long, text string")
    lines = layout.class_lines(line_spans(docs), LINE_PROFILE)
    assert keys_of(lines) == [["doc_id"]]
    assert sorted((r.doc_id, r.line, r.kind, r.text) for r in lines.collect()) == [(1, 0, "para", "A b"), (1, 1, "code", "1 2")]


def test_tokens_are_counted_where_their_row_is(spark, monkeypatch):
    keys, written = {}, ix.scratch

    def noted(df, name, *by):
        keys[name] = keys_of(df)
        return written(df, name, *by)

    monkeypatch.setattr(ix, "scratch", noted)
    units = spark.createDataFrame([(1, "a b a", "b"), (2, "", None), (3, "c", "C")], "id long, title string, text string")
    index = ix.build_index(units, ["title", "text"], False)
    assert keys["counts"] == [["id"]]
    assert sorted(tuple(r) for r in index.postings.collect()) == [("a", 1, 4, [2, 0]), ("b", 1, 4, [1, 1]), ("c", 3, 2, [1, 1])]
    assert sorted(tuple(r) for r in index.lengths.collect()) == [(1, 4), (2, 0), (3, 2)]
