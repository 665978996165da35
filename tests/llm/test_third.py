"""Packing, the Merkle manifest and the filter audit against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import merkle, packing
from lectern.llm.filter_audit import audit_filters
from lectern.llm.merkle import folded, leaf_digest, manifest, proof_digest
from lectern.llm.packing import Encoder, pack_documents, sequences, sum_of_squares

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


# ---- packing


def test_encoder(plain, monkeypatch):
    """Ids of parts are those of the whole, for all kinds of white space, marks, special tokens, small slices and a small memory."""
    rng = random.Random(2)
    bits = ["a", "Zeit", "l'été", "12", "!?", "'s", " ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "\x85", "　", "漢字", "<|endoftext|>", "|>", "😀", "é"]
    texts = ["", " ", "<|endoftext|>", *("".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(600))]
    encode, small = Encoder(PATH), Encoder(PATH)
    for t in texts:
        want = np.array(plain(t), "<u4").tobytes()
        assert encode(t) == want
        monkeypatch.setattr(packing, "CHUNK_BYTES", 7)
        monkeypatch.setattr(packing, "REMEMBERED", 20)
        assert small(t) == want
        monkeypatch.undo()


def test_sum_of_squares():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(3, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 80))]
        bins, places = sum_of_squares(np.array(lengths), capacity)
        # the same, a bin at a time
        gaps, want = [], 0
        for s in sorted(lengths, reverse=True):
            options = []
            for g in sorted({g for g in gaps if g >= s}):
                after = gaps.copy()
                after.remove(g)
                after.append(g - s)
                options.append((sum(n * n for gap, n in Counter(after).items() if gap), g, after))
            gaps = min(options)[2] if options else [*gaps, capacity - s]
            want = len(gaps)
        assert bins.max() + 1 == want
        filled = defaultdict(list)
        for b, p, s in zip(bins, places, lengths, strict=True):
            filled[b].append((p, s))
        for held in filled.values():
            at = 0
            for p, s in sorted(held):
                assert p == at
                at += s
            assert at <= capacity


def check_packing(rows, packed, plain, capacity):
    pieces = defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
    want = defaultdict(list)
    for r in rows:
        ids = [*plain(r.text), 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want[r.doc_id] += [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in packed) // capacity)


def test_pack(docs, no_docs, plain):
    rows = docs.collect()
    packed = pack_documents(docs, PATH, capacity=64, group_rows=50)
    got = packed.drop("ids").collect()
    bins, least = check_packing(rows, got, plain, 64)
    assert bins <= 1.03 * least + 3
    assert sorted(map(str, pack_documents(docs, PATH, capacity=64, group_rows=50).drop("ids").collect())) == sorted(map(str, got))
    assert pack_documents(no_docs, PATH).collect() == []
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    assert sum(r.length for r in whole.values()) == sum(r.length for r in got) and max(r.length for r in whole.values()) == 64
    for r in packed.collect():
        held = whole[r.sequence_id]
        assert len(held.ids) == 4 * held.length and r.offset in held.starts
        assert bytes(held.ids[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)


def test_pack_long_text(spark, plain):
    text = "some words, été " * 40_000 + "x" * 3000 + "   " * 9
    df = spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")
    bins, least = check_packing(df.collect(), pack_documents(df, PATH).drop("ids").collect(), plain, 1024)
    assert bins <= least + 1


# ---- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    """Levels of nodes over some leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at - at % 8
        out.append((at - lo, nodes[lo:at] + nodes[at + 1 : lo + 8]))
        at //= 8
    return out


def fold(leaf, proof):
    for at, others in proof:
        leaf = h(*others[:at], leaf, *others[at:])
    return leaf


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, docs, height, monkeypatch):
    """Blocks of 8, of 64 and of 4096 leaves give the manifest of the definition; trees of one leaf, a null one, repeated rows and ids."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    more = spark.createDataFrame([(500, "lone", "x"), (501, "Z", ""), (502, "Z", None), (None, "Z", "x")], "doc_id long, text string, lang string")
    many = spark.range(700).select((F.col("id") % 650 + 1000).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 650).alias("text"), F.lit("große").alias("lang"))
    table = docs.select("doc_id", "text", "lang").unionByName(more).unionByName(many)
    leaves = table.select("doc_id", "lang", leaf_digest([F.col("doc_id"), F.col("text")]).alias("digest"), F.lit("own").alias("__block"))
    got = manifest(leaves.drop("__block"), "lang", "doc_id").collect()
    trees = defaultdict(list)
    for r in table.collect():
        trees[(r.lang is not None, (r.lang or "").encode())].append((r.doc_id is not None, r.doc_id or 0, told([r.doc_id, r.text])))
    levels = {k: tree_of([x[2] for x in sorted(v)]) for k, v in trees.items()}
    order = sorted(levels)
    upper = tree_of([levels[k][-1][0] for k in order])
    want = Counter()
    for k, rows in trees.items():
        for i, (known, doc_id, leaf) in enumerate(sorted(rows)):
            proof = siblings_of(levels[k], i) + siblings_of(upper, order.index(k))
            assert fold(leaf, proof) == upper[-1][0]
            want[(doc_id if known else None, leaf, levels[k][-1][0], upper[-1][0], str(proof))] += 1
    assert Counter((r.doc_id, r.digest, r.subroot, r.root, str([(x.at, x.siblings) for x in r.proof])) for r in got) == want
    assert len({tuple(r.tree) for r in got}) == len(trees)


def test_tampering_shows(docs, no_docs):
    leaves = docs.select("doc_id", "lang", leaf_digest([F.col("text")]).alias("digest"), leaf_digest([F.translate("text", "a", "A")]).alias("other"))
    out = manifest(leaves, "lang", "doc_id").select("digest", "other", "root", folded(F.col("other"), F.col("proof")).alias("got"), proof_digest(F.col("proof")).alias("p"), "proof")
    for r in out.collect():
        assert (r.got == r.root) == (r.digest == r.other)
        assert r.got == fold(r.other, [(x.at, x.siblings) for x in r.proof]) and r.p == h(*(s for x in r.proof for s in x.siblings))
    assert manifest(no_docs.select("doc_id", "lang", leaf_digest([F.col("text")]).alias("digest")), "lang", "doc_id").collect() == []


# ---- filter audit


def plain_audit(rows, labels):
    good, toxic = ({r.doc_id for r in labels if getattr(r, c) == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    out = Counter()
    for r in rows:
        t, words = r.text or "", (r.text or "").encode().split()
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > first[t],
        }
        for p in permutations("ABCDE"):
            gone = False
            for i, f in enumerate(p):
                key = (r.source or "", "".join(p), i + 1)
                out[(*key, "kept")] += not gone and not fails[f]
                out[(*key, "removed")] += not gone and fails[f]
                out[(*key, "redundant")] += gone and fails[f]
                out[(*key, "unique_fails")] += fails[f] and sum(fails.values()) == 1
                out[(*key, "good_lost")] += not gone and fails[f] and r.doc_id in good
                out[(*key, "toxic_lost")] += not gone and fails[f] and r.doc_id in toxic
                gone |= fails[f]
    shapley = Counter()
    for (part, order, step, what), n in out.items():
        if what == "removed":
            shapley[part, order[step - 1]] += n
    return {(part, order, step): {w: out[part, order, step, w] for w in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")} | {"shapley": shapley[part, order[step - 1]]} for part, order, step, _ in out}


def test_audit(spark, docs, no_docs):
    noisy = [(600 + i, t, f"s{i % 3}") for i, t in enumerate(["LOUD TEXT", "50 % off", "a | b", "x y " * 40, " ".join(f"w{i}" for i in range(60)), "ÄÖÜ", "a b c d\n" * 20 + "#"])]
    table = docs.select("doc_id", "text", "source", "lang", "key").unionByName(spark.createDataFrame(noisy, "doc_id long, text string, source string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 120)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9, None, None), (606, 1, 1)], "doc_id long, quality int, toxic int")
    want = plain_audit(table.collect(), labels.collect())
    got = audit_filters(table, labels).collect()
    assert len(got) == len(want) == 600 * len({k[0] for k in want})
    for r in got:
        assert {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == want[r.part, r.filter_order, r.step]
        assert r["filter"] == r.filter_order[r.step - 1]
    assert audit_filters(no_docs, labels.limit(0)).collect() == []
    assert audit_filters(table, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
