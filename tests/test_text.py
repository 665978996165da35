"""Tokens, stems and ranking against the full-text engine of the standard library."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions.stem import stem_word
from lectern.functions.text import index_tokens, match_query, match_start, trim_ws
from lectern.operators.index import Index, build_index
from lectern.operators.search import UNIT_WEIGHTS, search, search_batch

SUFFIXES = "ational tional enci izer logi bli alli entli eli ousli ization ation ator alism iveness aliti biliti icate ful ness al ance er able ement ment ent sion tion ion ou ism ous ive ize e ll ed ing eed y s ies sses at bl iz".split()


def fts(texts, tokenize):
    con = sqlite3.connect(":memory:")
    con.execute(f'create virtual table t using fts5(x, tokenize="{tokenize}")')
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    return con


def some_words(n, seed=1):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzaeiouyéßñ_"
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) + rng.choice(SUFFIXES) + rng.choice(["", *SUFFIXES]) for _ in range(n)})


def test_stems_are_those_of_the_index():
    words = [w for w in some_words(8000)] + ["eed", "ies", "sses", "doyying", "as", "x" * 70]
    plain = [r[0] for r in fts(words, "unicode61 tokenchars '_'").execute("select term from v order by doc")]
    con = fts(plain, "porter unicode61 tokenchars '_'")
    assert [stem_word(w) for w in plain] == [r[0] for r in con.execute("select term from v order by doc")]


def test_index_tokens(spark):
    texts = ["num_bytes Café STRASSE Straße x", "a-b c’d 3.14 ½ ǅ", "日本語 русский Ελλάς", "étude", "", "Ÿÿ ÅÄÖ ø æ"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id long, x string")
    got = {r.id: r.t for r in df.select("id", index_tokens(F.col("x")).alias("t")).collect()}
    con = fts(texts, "unicode61 tokenchars '_'")
    want = {i: [] for i in got}
    for term, doc in con.execute("select term, doc from v order by doc, offset"):
        want[doc].append(term)
    assert got == want


def test_query_text(spark):
    df = spark.createDataFrame([("deep café x to Deep NOT",), ("a I",), (None,), ("日本",)], "q string")
    assert [r[0] for r in df.select(match_query(F.col("q"))).collect()] == ["deep* OR caf* OR Deep* OR NOT*", "", "", ""]


def test_trim_and_match(spark):
    row = spark.range(1).select(
        trim_ws(F.lit(" \t a b  \n")).alias("t"), match_start(F.lit("Chapter 6"), r"Chapter\s+(\d+)").alias("m"), match_start(F.lit("x 1.2"), r"(\d+\.\d+)").alias("n")
    )
    assert tuple(row.first()) == ("a b", "6", None)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocab = some_words(120, 5)[:60] + ["deep", "module", "modules", "configuring", "configuration", "the"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, n)))
    rows = [(i, say(30) + " the", say(6), say(5), say(4), say(8), rng.choice("ab"), rng.choice("xy")) for i in range(1, 61)]
    rows.append((61, *rows[4][1:]))
    df = spark.createDataFrame(rows, "id long, text string, context_line string, applies_when string, key_terms string, questions string, principle string, type string").cache()
    return rows, df, build_index(df, list(UNIT_WEIGHTS))


def fts_scores(rows, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, b, c, d, e, tokenize=\"porter unicode61 tokenchars '_'\")")
    con.executemany("insert into t(rowid, a, b, c, d, e) values (?, ?, ?, ?, ?, ?)", [r[:6] for r in rows])
    match = " OR ".join(f"{w}*" for w in query.split() if len(w) > 2)
    weights = ", ".join(str(w) for w in UNIT_WEIGHTS.values())
    return con.execute(f"select rowid, bm25(t, {weights}) s from t where t match ? order by round(s, 9), rowid", [match]).fetchall()


@pytest.mark.parametrize("query", ["deep module", "configuration the the", "mod conf abl", "was"])
def test_ranking_is_that_of_the_index(corpus, query):
    rows, df, index = corpus
    want = fts_scores(rows, query)
    got = [(r.id, r.score) for r in search(index, df, query, -1, list(UNIT_WEIGHTS.values())).collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))


def test_limits_facets_and_batches(spark, corpus, tmp_path):
    rows, df, index = corpus
    weights = list(UNIT_WEIGHTS.values())
    full = search(index, df, "deep module", -1, weights).collect()
    assert search(index, df, "deep module", 0, weights).count() == 0
    assert search(index, df, "a I", 5, weights).collect() == []
    kept = [r for r in full if r.principle == "a" and r.type in ("x", "y")]
    assert search(index, df, "deep module", 3, weights, {"principle": ["a"], "type": ["x", "y"]}).collect() == kept[:3]
    queries = spark.createDataFrame([(1, "deep module"), (2, ""), (3, "configuring")], "case_id long, query string")
    batch = search_batch(index, df, queries, 4, weights).collect()
    assert [r.id for r in sorted((r for r in batch if r.case_id == 1), key=lambda r: (round(r.score, 9), r.id))] == [r.id for r in full[:4]]
    assert {r.case_id for r in batch} == {1, 3}
    index.save(str(tmp_path / "index"))
    again = Index.load(spark, str(tmp_path / "index"), index.columns, True)
    assert search(again, df, "deep module", -1, weights).collect() == full
