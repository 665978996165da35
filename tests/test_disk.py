"""What searching by whole passages writes and shuffles: rows of units and pairs that hold, no grams, no posting by term, no pair of query and unit."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluate, passages, search, trigram
from lectern.operators.index import build_index
from lectern.plans import catalog

from .test_dealt import keys_of
from .test_index import PASSAGES, TEXTS, corpus


def noted(monkeypatch, *modules):
    """Names and numbers of rows of what is written."""
    written = {}

    def note(df, name, *by, real=search.scratch):
        out = real(df, name, *by)
        written[name] = out.count()
        return out

    for m in modules:
        monkeypatch.setattr(m, "scratch", note)
    return written


# ---- passages


@pytest.mark.parametrize(("chunk", "most"), [(1 << 20, 100_000), (7, 100_000), (1, 100_000), (64, 3)])
def test_passages_are_found_in_one_reading(spark, monkeypatch, chunk, most):
    """In chunks that end anywhere, and by trigrams if there are too many passages; random ones over few characters among them."""
    monkeypatch.setattr(passages, "CHUNK", chunk)
    monkeypatch.setattr(passages, "MAX_PASSAGES", most)
    rng = random.Random(chunk)
    some = lambda n: "".join(rng.choice("abé\U0001f600") for _ in range(n))
    texts = TEXTS + [some(rng.randint(0, 90)) for _ in range(40)]
    asked = PASSAGES + [t[i : i + rng.randint(1, 70)] for t in texts[-20:] for i in (0, 5)] + ["the cat sat on the mat " * 9, "mat " + "the cat sat on the mat " * 40, "abcx", "abc"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    cases = spark.createDataFrame([*enumerate(asked), (None, "a")], "case_id long, query string")
    want = sorted((i, j) for i, t in enumerate(texts) for j, q in enumerate(asked) if t is not None and q is not None and q in t)
    assert sorted(map(tuple, passages.holding(units, cases).collect())) == want
    assert passages.holding(units, cases.limit(0)).collect() == [] and passages.holding(units.limit(0), cases).collect() == []


def test_equal_hashes_lose_and_add_nothing(spark, monkeypatch):
    """Windows that all hash alike are told apart by their bytes."""
    real = passages.windows
    monkeypatch.setattr(passages, "windows", lambda data, widest: ((w, h * passages.np.uint64(0)) for w, h in real(data, widest)))
    units = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    cases = spark.createDataFrame(list(enumerate(PASSAGES)), "case_id long, query string")
    want = sorted((i, j) for i, t in enumerate(TEXTS) for j, q in enumerate(PASSAGES) if t is not None and q is not None and q in t)
    assert sorted(map(tuple, passages.holding(units, cases).collect())) == want


def test_only_pairs_that_hold_are_written(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * 50 + "the passage", "s") for i in range(40)] + [(99, None, "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "word7 word7"), (2, "nowhere"), (3, "7 the passage")], "case_id long, query string")
    written = noted(monkeypatch, passages, trigram)
    assert sorted((r.case_id, r.doc_id) for r in evaluate.holders(docs, items).collect()) == [(1, 7), (3, 7), (3, 17), (3, 27), (3, 37)]
    assert written == {"holds": 5}


def test_top_k_of_passages_looks_for_no_holders(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "holders", lambda *a: pytest.fail("not asked for"))
    assert {r.case_id for r in catalog.QUERIES["eval_topk"](spark, "/root/testdata/sf0.001").select("case_id").distinct().collect()} == {r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}


# ---- batches


@pytest.mark.parametrize(("lead_prefixes", "broadcast", "bound"), [(256, 500_000, 10**10), (1, 500_000, 10**10), (256, 0, 10**10), (256, 500_000, 0)])
def test_batches_shuffle_rows_of_units(spark, monkeypatch, lead_prefixes, broadcast, bound):
    """Every plan gives the scores of a loop; those in use write a row for each unit, and sum where it is."""
    monkeypatch.setattr(search, "LEAD_PREFIXES", lead_prefixes)
    monkeypatch.setattr(search, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(search, "BOUND_FROM", bound)
    units, queries = corpus(spark, 4)
    index = build_index(units.select("id", "title", "text"), ["title", "text"], True)
    written = noted(monkeypatch, search)
    scored = search.scores(index, queries, (10.0, 4.0))
    if broadcast:
        assert keys_of(scored) == [["id"]] and written["found"] == scored.select("id").distinct().count() and "terms" not in written
    for case, query in queries.collect():
        want = {r.id: r.score for r in search.search(index, units, query, -1, (10.0, 4.0)).collect()}
        got = {r.id: r.score for r in scored.filter(F.col("case_id") == case).collect()}
        assert got == pytest.approx(want)
    best = search.search_batch(index, units, queries, 3, (10.0, 4.0))
    want = search.top_k(scored, 3)
    assert sorted((r.case_id, r.id, round(r.score, 9)) for r in best.collect()) == sorted((r.case_id, r.id, round(r.score, 9)) for r in want.collect())
