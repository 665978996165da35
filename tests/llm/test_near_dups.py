"""Near-duplicate classes against all pairs; signatures against similarities."""

from collections import defaultdict
from itertools import combinations

import numpy as np

from lectern.llm import near_dups
from lectern.llm.components import components
from lectern.llm.near_dups import dart_minhash, near_duplicates
from lectern.llm.textbytes import U64, seeded

from .conftest import words_of


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    least = defaultdict(lambda: 10**9)
    for x in nodes:
        least[union.find(x)] = min(least[union.find(x)], x)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components(df).collect()} == {x: least[union.find(x)] for x in nodes}
    assert components(df.limit(0)).collect() == []


def test_signatures_estimate_weighted_jaccard():
    e = seeded(9, 300)
    x, y = np.ones(300), np.ones(300)
    x[:40], y[260:], y[:20], x[100:130], y[90:110] = 0, 0, 7, 3, 2.5
    row = np.repeat([0, 1], [260, 260])
    element, weight = np.concatenate([e[x > 0], e[y > 0]]), np.concatenate([x[x > 0], y[y > 0]])
    k = 4000
    sig = dart_minhash(row, element, weight, 2, k)
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
    one = dart_minhash(np.zeros(1, int), e[:1], np.ones(1), 1, 80)
    assert (one != U64(2**64 - 1)).all()


def test_classes(docs, no_docs):
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    union = Union()
    distinct = list({s for s in sets if s})
    for a, b in combinations(distinct, 2):
        if len(a & b) >= 0.8 * len(a | b):
            union.join(a, b)
    least, count = {}, defaultdict(int)
    for r, s in zip(rows, sets, strict=True):
        if s:
            c = union.find(s)
            least[c] = min(x for x in (least.get(c), r.doc_id) if x is not None) if (least.get(c), r.doc_id) != (None, None) else None
            count[c] += 1
    want = [(r.doc_id, least[union.find(s)], count[union.find(s)], len(s)) if s else (r.doc_id, r.doc_id, 1, 0) for r, s in zip(rows, sets, strict=True)]
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert max(count.values()) > 40
    assert near_duplicates(no_docs).collect() == []


def test_blocks_and_new_centres_find_what_stars_miss(spark, monkeypatch):
    """A chain of texts, each alike to the next alone, in blocks of a few members: one class, whatever the centres."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    texts = [" ".join(words[i * 4 : i * 4 + 200]) for i in range(48)]  # 188 of 204 shingles shared with the next text
    other = [" ".join(f"x{j}" if j % 9 else f"x{j}y{i}" for j in range(200)) for i in range(40)]  # alike, but under the threshold
    df = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string").repartition(4)
    want = {i: 0 if i < 48 else i for i in range(88)}
    for block in (4, 256):
        monkeypatch.setattr(near_dups, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == want


def test_what_was_compared_with_the_centre_is_in_no_block(spark):
    """Buckets of two, and the centres of others, have had all their comparisons; the rest goes out once for each pair of blocks."""
    rows = [(1, "a", "a"), (1, "b", "a"), (2, "c", "d"), (2, "d", "d"), (2, "e", "d"), (2, "f", "d")]
    members = spark.createDataFrame([(band, x.encode(), c.encode()) for band, x, c in rows], "band long, digest binary, centre binary")
    links = spark.createDataFrame([(b"d", b"e")], "a binary, b binary")
    got = near_dups._Buckets(members, links).blocks(4).collect()
    assert sorted((r.band, r.i, r.j, r.place, r.digest) for r in got) == [
        (2, 0, 0, 0, b"c"), (2, 0, 0, 0, b"f"), (2, 0, 1, 0, b"c"), (2, 0, 1, 0, b"f"), (2, 0, 1, 1, b"e"),
    ]


def test_blocks_name_pairs_or_are_searched_with_their_sets(spark, monkeypatch):
    """The same classes whether blocks name their pairs by signatures or all fetch their sets."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 900)]
    texts = [" ".join(words[i * 9 : i * 9 + 200]) for i in range(60)]  # 187 of 205 shingles shared with the next text
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    monkeypatch.setattr(near_dups, "SIG_BLOCK", 8)
    for few in (0, 1000):
        monkeypatch.setattr(near_dups, "FEW", few)
        assert {r.class_id for r in near_duplicates(df).collect()} == {0}


def test_recall(spark):
    """Of all pairs of similarity 0.8 or more, by an inverted index, those in one class: all but the few that share no band."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for ids in holders.values():
        for pair in combinations(sorted(ids), 2):
            both[pair] += 1
    alike = [p for p, n in both.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    assert len(alike) > 30
    assert sum(got[a] == got[b] for a, b in alike) >= 0.99 * len(alike)


def test_weighted_jaccard_of_pairs():
    pack = lambda d: np.array(sorted(d.items()), np.uint64).tobytes()
    a, b, c = {1: 3, 5: 1, 9: 2}, {1: 1, 9: 4, 11: 1}, {7: 1}
    assert np.allclose(near_dups.jaccard([pack(a), pack(a), pack(a)], [pack(b), pack(a), pack(c)], True), [3 / 9, 1, 0])


def test_long_text(spark):
    """A text far longer than a slice, and a near copy of it."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 700_000)]  # 5.5 MB
    near = words.copy()
    near[::1000] = ["edit"] * len(near[::1000])
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "short and other")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_weighted_classes(spark):
    a = "a b c d e f " * 10 + "tail of this text is here"
    b = "a b c d e f " * 3 + "tail of this text is here"
    df = spark.createDataFrame([(1, a), (2, a + " x"), (3, b)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, weighted=True).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_unrelated_sets_share_nothing():
    """Millions of different shingles are told apart."""
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**64, 2_000_000, dtype=np.uint64)).tobytes() for _ in range(2))
    assert near_dups.jaccard([a, a, a[:800]], [b, a, a[:1600]], False).tolist() == [0.0, 1.0, 0.5]
