"""Blocks of the mix: one length at every size, draws that decide, totals near the targets."""

from collections import Counter, defaultdict

import numpy as np

from lectern.llm import mixing
from lectern.llm.mixing import BLOCK, PART, SHARDS, draw_counts, mix_documents, mix_taken, shard_slots, targets


def test_draws_follow_the_quotas():
    """Each shard has its slots; counts of a shard are multinomial, totals end near the quotas and never beyond the most."""
    quota = (np.array([0.0, 1.5, 40, 300, 1000, 2.0]) * PART).astype(np.int64)
    most = np.array([0, 2, 40, 2000, 2000, 2])
    slots = shard_slots(int(quota.sum()), 64)
    assert slots.sum() == round(quota.sum() / PART) and slots.max() - slots.min() <= 1
    every = np.array([draw_counts(slots, quota, most, np.random.default_rng(i)) for i in range(200)])
    assert (every.sum(axis=2) == slots).all()
    totals = every.sum(axis=1)
    assert (totals <= most).all() and len({tuple(t) for t in totals}) > 20
    assert (np.abs(totals.mean(axis=0) - quota / PART) < 1).all() and np.abs(totals[:, 3] - 300).max() < 20
    # one shard by itself: variance of a multinomial, not of an even split
    share = quota / quota.sum()
    first = every[:, 0]
    assert np.allclose(first.mean(axis=0), slots[0] * share, atol=0.5)
    assert np.allclose(first.var(axis=0), slots[0] * share * (1 - share), rtol=0.5, atol=0.2)


def near(taken, target):
    """Within two blocks and a fiftieth."""
    return abs(taken - target) <= 2 * BLOCK + 0.02 * target


def test_the_draw_decides(spark):
    """Other shards or another seed take other words; reruns agree; the shards that words go to are returned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    take = lambda **o: {r.doc_id: (r.taken, tuple(r.shards)) for r in mix_taken(docs, **o).collect()}
    one, two, other = take(), take(shards=7), take(seed=8)
    assert take() == one
    assert sum(one[i][0] != two[i][0] for i in one) > 10 and sum(one[i][0] != other[i][0] for i in one) > 100
    assert {s for _, shards in one.values() for s in shards} == set(range(SHARDS)) and {s for _, shards in two.values() for s in shards} == set(range(7))
    assert all(bool(n) == bool(shards) for n, shards in one.values())
    taken, goal = Counter(), {}
    for r, source in ((r, r.source) for r in mix_taken(docs).join(docs.select("doc_id", "source"), "doc_id").collect()):
        taken[source] += r.taken
        goal[source] = r.target
    assert all(near(taken[s], goal[s]) for s in goal)


def test_small_sources_are_mixed_in_blocks(spark):
    """A source of a few thousand words is taken in runs of words, not word by word."""
    texts = [(i, " ".join(f"d{i}w{j}" for j in range(300)), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    size, taken = Counter(), Counter()
    for r in mix_taken(docs).collect():
        size[f"s{r.doc_id % 3}"] += r["size"]
        taken[f"s{r.doc_id % 3}"] += r.taken
    for s, t in zip(sorted(size), targets([size[s] for s in sorted(size)]), strict=True):
        assert near(taken[s], t)
    runs = defaultdict(int)
    for r in mix_documents(docs).collect():
        at = [int(w.split("w")[1]) for w in r.text.split()]
        assert at == sorted(set(at))
        runs[r.doc_id] = max(runs[r.doc_id], 1 + sum(b != a + 1 for a, b in zip(at, at[1:])))
    assert max(runs.values()) <= 4


def test_many_sources_give_the_same_mix(spark, docs, monkeypatch):
    """More sources than the driver ranks: the same targets and words, with nulls, empty and capped sources."""
    want = sorted(mix_taken(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    got = sorted(mix_taken(docs).collect(), key=str)
    plain = lambda rows: Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows)
    assert plain(got) == plain(want)
    sizes = [(i, "w " * (i * 37 % 901), f"s{i:03}" if i else None) for i in range(200)]
    many = spark.createDataFrame(sizes, "doc_id long, text string, source string")
    goal = targets([len(t.split()) for _, t, _ in sizes[1:]] + [0])
    got = {r.doc_id: r for r in mix_taken(many).collect()}
    assert all(abs(got[i].target - goal[i - 1]) < 1e-6 for i in range(1, 200)) and got[0].target == 0
    assert all(r.taken <= 2 * r["size"] and near(r.taken, min(r.target, 2 * r["size"])) for r in got.values())


def test_only_sources_are_broadcast(spark, docs):
    """Tables with a row for each document or block are not broadcast, however small their files are."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = docs.limit(80).selectExpr("key as rid", "doc_id as id", "source", "cast(n_chars as long) as size")
    placed, parts = mixing.mix_plan(rows)
    assert plan(placed).count("BroadcastExchange") == 0 and plan(parts).count("BroadcastExchange") == 1
    assert "BroadcastExchange" not in plan(mix_documents(docs))
