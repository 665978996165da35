"""The pipeline's stages against brute force, each on what the one before kept."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm.mixing import targets

from .conftest import words_of
from .test_mixing import near
from .test_native import contaminated
from .test_near_dups import Union, shingles
from .test_texts import rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", docs.doc_id + 100000)
    real.unionByName(own).write.parquet(f"{base}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    out = [spark.read.parquet(f"{base}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, out[-1], str(base))
        if name != "shard":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return str(base), [x.collect() for x in out]


def test_empty_tables(spark, tmp_path):
    """Every stage on a table without rows."""
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_go_through(spark, docs, tmp_path):
    """Columns beyond the five, with names that the operators use themselves, come out of every stage but the last as they went in. The mix cuts texts."""
    others = lambda df: {tuple(r) for r in df.drop("text", "n_chars").collect()}
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    more = docs.select("*", *(docs.doc_id.alias(c) for c in ("id", "row", "kept", "band", "h", "size", "shard", "taken")))
    rows = more.filter("length(text) > 200").dropDuplicates(["doc_id"])
    known = others(rows)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        if name != "shard":
            assert rows.columns == more.columns and others(rows) <= known, name
        assert rows.count(), name


def test_quality_stage(spark, steps):
    base, (docs, kept, *_) = steps
    left = Counter(map(tuple, docs)) - Counter(map(tuple, kept))
    assert sum(left.values()) == len(docs) - len(kept)
    assert not any(rules(r.text)[-1] for r in kept)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    assert all(r.doc_id in ids for r in docs if quality.get(r.doc_id) == 1 and not rules(r.text)[-1])
    assert sum(i in ids for i, q in quality.items() if q == 0) <= 0.2 * sum(q == 0 for q in quality.values())


def test_near_dedup_stage(steps):
    _, (_, docs, kept, *_) = steps
    union, by = Union(), {}
    distinct = list({shingles(r.text) for r in docs})
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(a & b) >= 0.8 * len(a | b):
                union.join(a, b)
    for r in docs:
        by.setdefault(union.find(shingles(r.text)), []).append(r)
    want = Counter()
    for rows in by.values():
        least = min((r.doc_id is not None, r.doc_id or 0) for r in rows)
        want[least[1] if least[0] else None] += 1
    assert Counter(r.doc_id for r in kept) == want
    assert len(kept) < len(docs)


def test_decontamination_stage(spark, steps):
    base, (_, _, docs, kept, *_) = steps
    items = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    clean = [r for r in docs if not next(iter(contaminated([r], items))).endswith("True)")]
    assert sorted(map(str, kept)) == sorted(map(str, clean))


def test_mix_stage(steps):
    _, (_, _, _, docs, mixed, _) = steps
    size, taken = Counter(), Counter()
    source = {}
    for r in docs:
        size[r.source] += len(words_of(r.text))
        source[r.doc_id] = r.source
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for r in mixed:
        taken[r.source] += len(words_of(r.text))
    for s, t in zip(order, targets([size[s] for s in order]), strict=True):
        assert near(taken[s], t)


def test_shard_stage(spark, steps):
    base, (*_, mixed, sharded) = steps
    want = Counter((r.doc_id, len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in mixed)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in sharded) == want
    assert sorted(map(str, corpus_pipeline.run(spark, base).collect())) == sorted(map(str, sharded))
