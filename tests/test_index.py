"""The vocabulary in blocks, bounded top-k, the trigram index and the index that changes, against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index as ix
from lectern.operators import living_index, search, trigram
from lectern.operators.index import Index, build_index, vocabulary_blocks
from lectern.operators.living_index import LivingIndex
from lectern.operators.search import bounded, contributions, expand, search_batch, top_k
from lectern.operators.trigram import TrigramIndex, build_trigrams, containing, grams_of
from lectern.sources.manifest import Manifest

UNITS = "id long, title string, text string, kind string"


def corpus(spark, seed, n=120):
    """Texts over words of very different frequency, copies among them."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcst") for _ in range(rng.randint(3, 6))) for _ in range(150)]
    text = lambda m: " ".join(words[min(int(rng.expovariate(0.05)), 149)] for _ in range(m))
    rows = [(i, text(rng.randint(0, 3)), text(rng.randint(0, 60)), f"k{i % 3}") for i in range(n)]
    rows += [(n + i, *rows[i * 3][1:]) for i in range(20)]
    queries = [(i, text(rng.randint(0, 25))) for i in range(15)] + [(90, "abc abc ab"), (91, "zzz"), (92, ""), (93, " ".join(words[:60]))]
    return spark.createDataFrame(rows, UNITS), spark.createDataFrame(queries, "case_id long, query string")


# ---- vocabulary


@pytest.mark.parametrize(("block_terms", "broadcast"), [(256, 500_000), (2, 500_000), (3, 0)])
def test_prefixes_are_ranges_of_the_vocabulary(spark, monkeypatch, block_terms, broadcast):
    monkeypatch.setattr(ix, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(search, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    terms = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)} | {"a", "ab", "abc", "z", "\U0001f600x", "￿", "zz\U0010ffff"}
    blocks = vocabulary_blocks(spark.createDataFrame([(t, len(t)) for t in terms], "term string, df long"))
    for b in blocks.collect():
        held = [t.term for t in b.terms]
        assert held == sorted(held) and (b.first, b.last) == (held[0], held[-1]) and len(held) <= block_terms and {t[:3] for t in held} == {b.lead}
    prefixes = [*{t[:n] for t in terms for n in (1, 2, 3, 4, 6)}, "q", "aq", "abq", "abbbbbbbbbb", "\U0001f600", "￿"]
    got = sorted(tuple(r) for r in expand(spark.createDataFrame([(p,) for p in prefixes + prefixes[:5]], "prefix string"), blocks).collect())
    assert got == sorted((p, t, len(t)) for p in set(prefixes) for t in terms if t.startswith(p))
    assert expand(spark.createDataFrame([], "prefix string"), blocks).collect() == []


def test_saved_index_keeps_vocabulary_and_size(spark, tmp_path):
    units, _ = corpus(spark, 1)
    built = build_index(units.select("id", "title", "text"), ["title", "text"])
    built.save(str(tmp_path / "ix"))
    saved = Index.load(spark, str(tmp_path / "ix"), ["title", "text"], True)
    assert saved.known_size == built.size and saved.known_blocks is not None
    pairs = lambda i: sorted((t.term, t.df) for b in i.blocks.collect() for t in b.terms)
    assert pairs(saved) == pairs(built) == sorted(map(tuple, built.vocabulary().collect()))


# ---- bounded top-k


@pytest.mark.parametrize(("seed", "first_rows", "broadcast"), [(1, 100, 500_000), (2, 1, 500_000), (3, 1, 0)])
def test_bounded_gives_the_rows_of_all_scores(spark, monkeypatch, seed, first_rows, broadcast):
    """Whatever rows the first threshold comes from, and by broadcast or shuffle; two weighted columns, ties, facets, k over the number of rows."""
    monkeypatch.setattr(search, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(search, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(search, "BOUND_FROM", 0)
    units, queries = corpus(spark, seed)
    index = build_index(units.select("id", "title", "text"), ["title", "text"], False)
    full = search.scores(index, queries, (10.0, 4.0)).join(units.select("id", "kind"), "id").collect()
    for k, facets in ((1, None), (5, None), (5, {"kind": ["k1", "k2"], "title": []}), (1000, None), (-1, None), (0, None)):
        want = []
        for case in {r.case_id for r in full}:
            rows = sorted((round(r.score, 9), r.id) for r in full if r.case_id == case and (not facets or r.kind in facets["kind"]))
            want += [(case, *r) for r in (rows if k < 0 else rows[:k])]
        got = search_batch(index, units, queries, k, (10.0, 4.0), facets).collect()
        assert sorted((r.case_id, round(r.score, 9), r.id) for r in got) == sorted(want)


def test_bounded_looks_at_few_postings(spark):
    """Whole benchmark passages as queries: most postings of their prefixes bring no candidate."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    cases = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))
    found = contributions(build_index(docs, ["text"], False), cases, (10.0,))
    score, figures = bounded(found, 5)
    figures = figures.first()
    print("postings of the queries' prefixes, looked at:", tuple(figures))
    assert figures.looked_at * 5 < figures.postings
    assert top_k(score, 5).count() == 5 * cases.count()


# ---- trigrams

TEXTS = ["abcdef", "xabcx", "ab", "a", "", None, "aaa", "aaaa bbbb", "Straße é\U0001f600x", "line\nbreak", "the cat sat on the mat " * 50, "b" * 3000 + "needle" + "c" * 3000, "\x00a\x00"]
PASSAGES = ["abc", "ab", "a", "", "cdefg", "aaa", "aaaaa", "é\U0001f600", "\U0001f600x", "e\nb", "needle", "sat on the mat the cat", "bneedlec", "mat the dog", None, "zzz", "ß", "\x00a"]


def test_grams():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 8))) for _ in range(2))
        held, asked = set(grams_of(a).tolist()), set(grams_of(b, True).tolist())
        # a text that holds another has all grams it is asked for; a gram is one only for its own characters
        assert asked <= held or b not in a
        parts = {a[i : i + n] for n in (0, 1, 2, 3) for i in range(len(a) - n + 1)}
        assert len(held) == len(parts) and asked <= set(grams_of(b).tolist())


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_containing(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(trigram, "BROADCAST_ROWS", broadcast)
    units = spark.createDataFrame([(i, t, f"o{i}") for i, t in enumerate(TEXTS)], "id long, text string, other string")
    passages = spark.createDataFrame(list(enumerate(PASSAGES)), "case_id long, query string")
    want = sorted((i, j) for i, t in enumerate(TEXTS) for j, q in enumerate(PASSAGES) if t is not None and q is not None and q in t)
    index = build_trigrams(units)
    got = containing(index, units, passages)
    assert got.columns == ["id", "text", "other", "case_id", "query"]
    assert sorted((r.id, r.case_id) for r in got.collect()) == want
    index.save(str(tmp_path / "grams"))
    again = containing(TrigramIndex.load(spark, str(tmp_path / "grams")), units, passages)
    assert sorted((r.id, r.case_id) for r in again.collect()) == want
    # candidates of longer passages are few: texts without them are hardly read
    long = passages.filter(F.length("query") > 5)
    assert trigram.candidates(index, long).count() <= 1.5 * sum(len(PASSAGES[j]) > 5 for _, j in want) + 2
    assert containing(index, units, passages.limit(0)).collect() == [] and containing(build_trigrams(units.limit(0)), units, passages).collect() == []


# ---- an index that changes


def same(a, b):
    rows = lambda i: (sorted((r.term, r.id, r.dl, tuple(r.tf)) for r in i.postings.collect()), sorted(map(tuple, i.lengths.collect())))
    assert rows(a) == rows(b) and a.size == pytest.approx(b.size)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_changes_equal_an_index_built_anew(spark, tmp_path, monkeypatch, broadcast):
    """Random adds, replacements and deletions; after each, postings, lengths and size are those of the units that are left."""
    monkeypatch.setattr(living_index, "BROADCAST_DEAD", broadcast)
    rng = random.Random(7)
    living = LivingIndex(spark, str(tmp_path), ["title", "text"], False, fan=3)
    assert living.index().size == (0, 0.0) and living.index().postings.count() == 0
    now, word = {}, lambda: rng.choice(["deep", "module", "shallow", "depth", "é"])
    for step in range(9):
        if step % 3 == 2:
            gone = rng.sample(sorted(now), len(now) // 3) + [10**6]
            living.delete(spark.createDataFrame([(i,) for i in gone + gone[:1]], "id long"))
            for i in gone:
                now.pop(i, None)
        else:
            new = {i: (i, word(), " ".join(word() for _ in range(rng.randint(0, 9)))) for i in rng.sample(range(60), rng.randint(1, 25))}
            living.write(spark.createDataFrame(list(new.values()), "id long, title string, text string"))
            now |= new
        if step % 2 == 0:
            same(living.index(), build_index(spark.createDataFrame(list(now.values()), "id long, title string, text string"), ["title", "text"], False))
        sizes = [s["rows"] - s["dead"] for s in living._state()[1]["segments"].values()]
        assert all(sum(3**t <= max(1, n) < 3 ** (t + 1) for n in sizes) < 3 for t in range(6))
    units = spark.createDataFrame(list(now.values()), "id long, title string, text string")
    anew = build_index(units, ["title", "text"], False)
    queries = spark.createDataFrame([(1, "deep modu"), (2, "shallow dep dep")], "case_id long, query string")
    hits = lambda i: sorted((r.case_id, r.id, round(r.score, 9)) for r in search_batch(i, units, queries, 7, (10.0, 4.0)).collect())
    assert hits(living.index()) == hits(anew)
    living.merge()
    state = living._state()[1]
    assert len(state["segments"]) == 1 and not state["tombstones"] and living._read("lengths", ix.LENGTHS, list(state["segments"])).count() == len(now)
    same(living.index(), anew)
    living.vacuum()
    assert len(list((tmp_path / "postings").iterdir())) == 1
    same(living.index(), anew)
    living.delete(units.select("id"))
    assert living.index().size == (0, 0.0) and living._state()[1]["segments"] == {}


def test_writes_are_whole_or_nothing(spark, tmp_path, monkeypatch):
    """A write that breaks off leaves nothing to readers, one that is run again does nothing, and of two at once one fails."""
    living = LivingIndex(spark, str(tmp_path), ["text"], False)
    unit = lambda i, t: spark.createDataFrame([(i, t)], "id long, text string")
    living.write(unit(1, "one"), token=4)
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            living.write(unit(1, "other"), token=5)
    assert [r.term for r in living.index().postings.collect()] == ["one"] and living.index().size == (1, 1.0)
    living.write(unit(2, "two"), token=5)
    living.write(unit(3, "again"), token=5)
    assert sorted(r.term for r in living.index().postings.collect()) == ["one", "two"]
    version, state = living._state()
    living.delete(unit(2, "").select("id"))
    with pytest.raises(RuntimeError, match="another writer"):
        living.manifest.commit(version, state)
    with pytest.raises(ValueError, match="repeat"):
        living.write(unit(1, "x").union(unit(1, "y")))
    assert [r.term for r in living.index().postings.collect()] == ["one"]
    living.vacuum()
    assert len(list((tmp_path / "lengths").iterdir())) == 1
