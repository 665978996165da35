"""Sharding, decontamination, line dedup and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.llm import decontaminate
from lectern.llm.chat import format_chats, read_chats
from lectern.llm.line_dedup import drop_spread_lines
from lectern.llm.sharding import even_cuts, least_capacity, minimax_shards


def test_least_capacity_is_least():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 12))]
        k = rng.randint(1, 5)

        def fits(c, sizes=sizes, k=k):
            shards, room = 0, -1
            for s in sizes:
                if s > c:
                    return False
                if s > room:
                    shards, room = shards + 1, c
                room -= s
            return shards <= k

        best = next(c for c in range(1, sum(sizes) + 1) if fits(c))
        assert least_capacity(sizes, k) == best
        cuts = [0, *even_cuts(sizes, k), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) == k + 1
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) <= best


def test_shards(docs, no_docs):
    got = minimax_shards(docs, shards=6).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    crc = defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        crc[r.text_crc32, r["size"]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in crc.values())
    assert sorted(map(str, minimax_shards(docs, shards=6).collect())) == sorted(map(str, got))
    assert minimax_shards(no_docs).collect() == []


def test_shards_match_plain_partition(docs):
    groups = Counter()
    for r in docs.collect():
        t = (r.text or "").encode()
        groups[hashlib.md5(t).hexdigest()] += len(t) + 8
    order = sorted(groups)
    best = least_capacity([groups[k] for k in order], 6)
    got = Counter()
    for r in minimax_shards(docs, shards=6).collect():
        got[r.shard] += r["size"]
    assert max(got.values()) == best


def contaminated(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        if w and i is not None:
            n = min(13, len(w))
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(str(i))
    out = []
    for r in rows:
        w, hit, found = low(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if x := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= x
        out.append((r.doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(map(str, out))


@pytest.mark.parametrize("in_plan", [True, False])
def test_contamination(spark, docs, no_docs, in_plan, monkeypatch):
    if not in_plan:
        monkeypatch.setattr(decontaminate, "PRINT_ROWS", -1)
        monkeypatch.setattr(decontaminate, "WINDOW_ROWS", -1)
    rows = docs.collect()
    passage = next(r.text for r in rows if r.doc_id == 11)
    words = passage.split()
    items = [(1, passage), (1, passage), (2, "x " + " ".join(words[5:18]) + " y"), (3, "Two, WORDS!"), (4, ""), (5, None), (6, " ".join(words[40:60]).title()), (10, "one"), (None, passage), (12, "never seen " * 20)]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, extra string")
    got = decontaminate.contamination(docs, bench).collect()
    assert Counter(str((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated)) for r in got) == contaminated(rows, items)
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit or r.contaminated for r in none)
    assert decontaminate.contamination(no_docs, bench).collect() == []


def test_lines(docs, no_docs):
    rows = docs.collect()
    sites = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if r.source is not None:
                sites[x].add(r.source)
    want = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not (len(sites[x]) >= 5 and re.search(r"[^\x20\x09-\x0D]", x))]
        want[r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = drop_spread_lines(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got) == want
    assert sum(r.n_removed for r in got) > 50
    assert drop_spread_lines(no_docs).collect() == []


def test_chats(spark):
    rng = random.Random(2)
    bits = ["<|", "|>", "<|turn|>", "<\\|end|>\n", "\\", "<", "|", "<<\\\\|x", "hi", "\n", "é", "<|part|>", "&"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "<|x|>", None]), text, 0))
    rows += [rows[0], (None, 1, "assistant", "lost", 0), (99, None, None, None, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(3)
    out = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    groups = defaultdict(list)
    for c, t, role, text, _ in rows:
        groups[c].append((t is not None, t, role or "", text or ""))
    assert set(out) == set(groups)
    for c, g in groups.items():
        g.sort()
        assert [(t.role, t.text) for t in out[c].turns] == [x[2:] for x in g]
        assert out[c].loss_text == "".join(x[3] for x in g if x[2] == "assistant")
        runs = 1 + sum(a[2] != b[2] for a, b in zip(g, g[1:]))
        assert out[c].formatted.count("<|turn|>") == runs == out[c].formatted.count("<|end|>\n")
    assert format_chats(df.limit(0)).collect() == []
