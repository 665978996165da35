"""Exact repeated passages across documents by fixed-block anchors.

1. Index: the non-overlapping 25-word blocks of every document. Any run of 50 words holds a whole block
   of each document it stands in.
2. Probe: every rolling 25-word window, by hash, in buckets of the hash. Hits are windows whose hash is
   an indexed block and stands in more than one document.
3. Extend: around every hit, the 50-word windows that hold it. The least document of each of them,
   found by 128 bits of hash in buckets again, decides; overlapping ones add up to the maximal repeats.

Rows whose whole text stands in a smaller document are settled first and take no part, so a group of
exact copies is one document here. Windows that very many documents share are known by a sample and never meet
in a bucket: as anchors all of them are hits (step 3 judges them anyway), and of the runs a task sends its least
document only. The sample decides where windows are compared, not what is found. Windows travel packed: a binary run of hashes for each document, bucket and batch, not a row each.
Results come back as bits, and are applied where the text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, free_shuffles, n_words, salted, text_of, without
from lectern.llm.textbytes import U64, Hasher, Words, mix, ngrams

#: Bytes of text for a bucket, and buckets at least.
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 64
#: of an anchor's hash, six bytes travel: 47 bits and one that marks an index block
ANCHOR_BYTES = 6
#: Hot windows are those in so many documents or more of a sample of so many bytes of text. At most so many, the most frequent,
#: are treated as hot: their hashes and least documents (2 MB) go to every task.
HOT_DOCS, SAMPLE_BYTES, MAX_HOT = 20, 32 << 20, 1 << 17
SAMPLE_TASKS = 8
#: Words of a text that are cut and joined in one go.
SLICE_WORDS = 1 << 16


def _windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of every n-word window."""
    at, h = ngrams(words, n)
    row = np.searchsorted(words.row_off, at, "right") - 1
    return row, at - words.row_off[row], h


def _runs(words: Words, n: int) -> np.ndarray:
    """128 bits of every n-word window, in two columns; the first is the hash of ``_windows``."""
    return np.stack([ngrams(words, n)[1], ngrams(words, n, 1031)[1]], 1)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % U64(n)).astype(np.int64)


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ``hot`` ones."""
    if not len(hot):
        return np.zeros(len(h), bool)
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h


def _is_hot_run(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which runs (of two columns) are among the hot ones, sorted by the first column. One of two that share it goes by its bucket."""
    if not len(hot):
        return np.zeros(len(h), bool)
    return (hot[np.minimum(np.searchsorted(hot[:, 0], h[:, 0]), len(hot) - 1)] == h).all(axis=1)


def _shared_windows(block: int, window: int):
    """(width, hash, second hash, documents) of the windows that stand in two or more documents of the task; blocks have no second hash."""

    def run(batches):
        hasher, seen = Hasher(), {block: [], window: []}
        for batch in batches:
            for _, _, words in hasher.chunks(batch.column(0)):
                for width, found in seen.items():
                    row, _, h = _windows(words, width)
                    both = _runs(words, width) if width == window else np.stack([h, np.zeros_like(h)], 1)
                    order = np.lexsort((h, row))
                    row, both = row[order], both[order]
                    first = np.ones(len(both), bool)
                    first[1:] = (row[1:] != row[:-1]) | (both[1:, 0] != both[:-1, 0])
                    found.append(both[first])
        for width, found in seen.items():
            both = np.concatenate([np.zeros((0, 2), U64), *found])
            _, at, n = np.unique(both[:, 0], return_index=True, return_counts=True)
            both, n = both[at[n > 1]], n[n > 1]
            widths = pa.array(np.full(len(n), width, np.int32))
            yield pa.RecordBatch.from_arrays([widths, *(pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)), pa.array(n.astype(np.int64))], ["width", "h", "h2", "n"])

    return run


def _hot_windows(known: DataFrame, n_bytes: int, block: int, window: int) -> dict[int, np.ndarray]:
    """The sorted hashes of the hot windows of either width; those of runs in two columns."""
    share = max(1, n_bytes // SAMPLE_BYTES)
    sample = known.filter(F.pmod(F.xxhash64("key", "id"), F.lit(share)) == 0).select("text").repartition(SAMPLE_TASKS)
    counts = sample.mapInArrow(_shared_windows(block, window), "width int, h long, h2 long, n long").groupBy("width", "h", "h2").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "h", "h2").limit(MAX_HOT).collect()
    both = {w: np.array([(r["h"], r["h2"]) for r in top if r["width"] == w], np.int64).reshape(-1, 2).view(U64) for w in (block, window)}
    runs = both[window][np.lexsort((both[window][:, 1], both[window][:, 0]))]
    return {block: np.sort(both[block][:, 0]), window: runs}


def _pack(bucket: np.ndarray, row: np.ndarray, values: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """(bucket, keys, ids and counts of the rows, values as bytes); values keep their order within a row."""
    order = np.lexsort((row, bucket))
    bucket, row, values = bucket[order], row[order], values[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        rows, counts = np.unique(row[lo:hi], return_counts=True)
        yield int(bucket[lo]), keys[rows].tobytes(), ids[rows].tobytes(), counts.astype(np.uint32).tobytes(), values[lo:hi].tobytes()


PACKED = "bucket int, keys binary, ids binary, counts binary, vals binary"
BITS = "key int, id long, bucket int, bits binary"


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _anchors(block: int, window: int, n_buckets: int, hot: np.ndarray):
    """Packed rolling block-length windows of texts that are long enough to hold a repeat. Rows with hot ones are named in buckets beyond."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, words in hasher.chunks(batch.column(2)):
                row, at, h = _windows(words, block)
                long = words.counts[row] >= window
                row, at, h = row[long], at[long], h[long]
                is_hot = _is_hot(h, hot)
                if is_hot.any():
                    some = np.unique(row[is_hot])
                    where = n_buckets + _buckets(ids[lo:hi][some].view(U64), n_buckets)
                    yield _packed_batch(list(_pack(where, some, np.zeros((len(some), 1), np.uint8), keys[lo:hi], ids[lo:hi])))
                    row, at, h = row[~is_hot], at[~is_hot], h[~is_hot]
                value = (h >> U64(17) << U64(1)) | (at % block == 0)
                six = value.reshape(-1, 1).view(np.uint8)[:, :ANCHOR_BYTES]
                yield _packed_batch(list(_pack(_buckets(h, n_buckets), row, six, keys[lo:hi], ids[lo:hi])))

    return run


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, keys, ids, counts) of a bucket's packed rows; values of 16 bytes have two columns."""
    raw = {c: b"".join(table[c].to_pylist()) for c in ("keys", "ids", "counts", "vals")}
    keys, ids = np.frombuffer(raw["keys"], np.int32), np.frombuffer(raw["ids"], np.int64)
    counts = np.frombuffer(raw["counts"], np.uint32).astype(np.int64)
    if width == 16:
        return np.frombuffer(raw["vals"], U64).reshape(-1, 2), keys, ids, counts
    wide = np.zeros((len(raw["vals"]) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw["vals"], np.uint8).reshape(-1, width)
    return wide.view(U64).reshape(-1), keys, ids, counts


def _bits(bucket: int, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, hit: np.ndarray) -> pa.Table:
    """The hits of each row's values as packed bits; rows without one are left out."""
    ends = np.cumsum(counts)
    sums = np.concatenate([[0], np.cumsum(hit)])
    some = np.flatnonzero(sums[ends] > sums[ends - counts])
    bits = [np.packbits(hit[ends[i] - counts[i] : ends[i]]).tobytes() for i in some]
    return pa.table({"key": pa.array(keys[some], pa.int32()), "id": pa.array(ids[some], pa.int64()), "bucket": pa.array([bucket] * len(some), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of the runs of equal values in that order)."""
    order = np.argsort(values, kind="stable")
    return order, np.flatnonzero(np.diff(values[order], prepend=values[order[:1]] ^ U64(1)))


def _hot_table(keys: np.ndarray, ids: np.ndarray, bits: list[bytes]) -> pa.Table:
    """Rows of what is known of hot windows: bucket -1."""
    return pa.table({"key": pa.array(keys, pa.int32()), "id": pa.array(ids, pa.int64()), "bucket": pa.array([-1] * len(ids), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _probe(n_buckets: int):
    """Bits of the anchors that are hits, and, from the buckets beyond, the rows with hot ones."""

    def run(key, table):
        if key[0].as_py() >= n_buckets:
            _, keys, ids, _ = _unpack(table, 1)
            return _hot_table(keys, ids, [b""] * len(ids))
        values, keys, row_ids, counts = _unpack(table, ANCHOR_BYTES)
        ids = np.repeat(row_ids, counts)
        order, starts = _groups(values >> U64(1))
        sizes = np.diff(np.append(starts, len(order)))
        ids, flag = ids[order], (values[order] & U64(1)).astype(bool)
        shared = np.logical_or.reduceat(flag, starts) & (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(shared, sizes)
        return _bits(key[0].as_py(), keys, row_ids, counts, hit)

    return run


def _least(n_buckets: int):
    """Bits of the runs with a smaller document, and, from the buckets beyond, (least document, hash) of each hot run."""

    def run(key, table):
        values, keys, row_ids, counts = _unpack(table, 16)
        ids = np.repeat(row_ids, counts)
        order = np.lexsort((values[:, 1], values[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (values[order[1:]] != values[order[:-1]]).any(axis=1)
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[order], starts)
        if key[0].as_py() >= n_buckets:
            return _hot_table(np.zeros(len(starts), np.int32), least, [v.tobytes() for v in values[order][starts]])
        sizes = np.diff(np.append(starts, len(order)))
        hit = np.zeros(len(order), bool)
        hit[order] = ids[order] > np.repeat(least, sizes)
        return _bits(key[0].as_py(), keys, row_ids, counts, hit)

    return run


def _marked(row: np.ndarray, bucket: np.ndarray, found: list) -> np.ndarray:
    """The values whose bit is set. found: for each row a list of (bucket, bits), or None."""
    hit = np.zeros(len(row), bool)
    cut = np.searchsorted(row, np.arange(len(found) + 1))
    for i, parts in enumerate(found):
        if parts:
            lo, hi = cut[i], cut[i + 1]
            order = np.argsort(bucket[lo:hi], kind="stable")
            there = bucket[lo:hi][order]
            for part in parts:
                s, t = np.searchsorted(there, [part["bucket"], part["bucket"] + 1])
                hit[lo + order[s:t]] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=t - s).astype(bool)
    return hit


def _covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie within ``length`` from one of ``at``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _candidates(words: Words, found: list, block: int, window: int, n_buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, 128 bits) of the windows that hold a hit anchor, in order of place."""
    row, at, h = _windows(words, block)
    long = words.counts[row] >= window
    row, at, h = row[long], at[long], h[long]
    hit = _is_hot(h, hot)
    rest = np.flatnonzero(~hit)
    hit[rest] = _marked(row[rest], _buckets(h[rest], n_buckets), found)
    places = words.row_off[row[hit]] + at[hit]
    wrow, wat, _ = _windows(words, window)
    # a window from p holds the anchors from p to p + window - block
    near = np.zeros(len(words.starts) + 1, np.int64)
    near[places] = 1
    sums = np.concatenate([[0], np.cumsum(near)])
    start = words.row_off[wrow] + wat
    use = sums[start + window - block + 1] > sums[start]
    return wrow[use], start[use], _runs(words, window)[use]


def _kept(words: Words, i: int, kept: np.ndarray | None, texts: bool) -> tuple[int, str, str | None]:
    """(words of row i that are not kept, digest of the kept ones, and their text if ``texts``), by slices."""
    sha, parts, first, n = hashlib.sha256(), [], words.row_off[i], words.row_off[i + 1]
    removed, some = 0, False
    for lo in range(first, n, SLICE_WORDS):
        hi = min(n, lo + SLICE_WORDS)
        text = bytes(words.data[words.starts[lo] : words.ends[hi - 1]]).split()
        if kept is not None:
            text = [w for w, k in zip(text, kept[lo:hi], strict=True) if k]
            removed += hi - lo - len(text)
        part = b" ".join(text)
        if text and some:
            part = b" " + part
        some = some or bool(text)
        sha.update(part)
        if texts:
            parts.append(part)
    return removed, sha.hexdigest(), b"".join(parts).decode() if texts else None


def _split(block: int, window: int, n_buckets: int, texts: bool):
    """Texts without a hit are done: (key, id, n_words, nothing removed). The others keep their text and hits."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            key, id_, text, found = batch.columns
            for lo, hi, words in hasher.chunks(text):
                some = found.slice(lo, hi - lo)
                done = some.is_null().to_numpy(zero_copy_only=False)
                out = [_kept(words, i, None, texts) if d else (0, None, None) for i, d in enumerate(done)]
                yield pa.RecordBatch.from_arrays(
                    [
                        key.slice(lo, hi - lo), id_.slice(lo, hi - lo), pa.array(words.counts, pa.int64()), some,
                        pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string()),
                        pa.array([None if d else t for d, t in zip(done, text.slice(lo, hi - lo).to_pylist(), strict=True)], pa.string()),
                    ],
                    ["key", "id", "n_words", "found", "sha", "kept", "text"],
                )

    return run


def _wide(block: int, window: int, n_buckets: int, hot: dict[int, np.ndarray]):
    """Packed candidate windows; of the hot ones the least id in the task, in buckets beyond."""

    def run(batches):
        hasher, runs = Hasher(), hot[window]
        least, seen = np.full(len(runs), np.iinfo(np.int64).max), np.zeros(len(runs), bool)
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = batch.column(3).to_pylist()
            for lo, hi, words in hasher.chunks(batch.column(2)):
                row, _, h = _candidates(words, found[lo:hi], block, window, n_buckets, hot[block])
                is_hot = _is_hot_run(h, runs)
                if is_hot.any():
                    at = np.searchsorted(runs[:, 0], h[is_hot, 0])
                    np.minimum.at(least, at, ids[lo:hi][row[is_hot]])
                    seen[at] = True
                    row, h = row[~is_hot], h[~is_hot]
                yield _packed_batch(list(_pack(_buckets(h[:, 0], n_buckets), row, h, keys[lo:hi], ids[lo:hi])))
        at = np.flatnonzero(seen)
        if len(at):
            yield _packed_batch(list(_pack(n_buckets + _buckets(runs[at, 0], n_buckets), at, runs[at], np.zeros(len(runs), np.int32), least)))

    return run


def _apply(block: int, window: int, n_buckets: int, texts: bool, hot: dict[int, np.ndarray], least: np.ndarray):
    """Results of the rows with hits. least: the least document of each hot run."""

    def run(batches):
        hasher, runs = Hasher(), hot[window]
        for batch in batches:
            id_, text = batch.column(0), batch.column(1)
            ids = id_.to_numpy()
            found, later = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, words in hasher.chunks(text):
                row, start, h = _candidates(words, found[lo:hi], block, window, n_buckets, hot[block])
                is_hot = _is_hot_run(h, runs)
                gone, some, rest = np.zeros(len(h), bool), np.flatnonzero(is_hot), np.flatnonzero(~is_hot)
                gone[some] = ids[lo:hi][row[some]] > least[np.searchsorted(runs[:, 0], h[some, 0])]
                gone[rest] = _marked(row[rest], _buckets(h[rest, 0], n_buckets), later[lo:hi])
                kept = ~_covered(len(words.starts), start[gone], window)
                out = [_kept(words, i, kept, texts) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        id_.slice(lo, hi - lo), pa.array(words.counts, pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string()),
                    ],
                    ["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, kept_text (null if not ``texts``).

    Removes each word covered by a run of ``window`` (even) words that also starts in a document with a
    smaller id; runs are judged on the input. Kept words are joined by one space. Null and empty texts have no
    words. Documents without an id neither lose words nor count as earlier ones; rows with one id are
    one document for that, and repeated rows get the same result. Ids are integers. Texts of any length are
    taken whole; a text takes some 15 times its size of memory. An empty table gives an empty result; other
    columns, whatever their names, are ignored.
    """
    block = window // 2
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("key", F.hash("text"))  # tells texts of one id apart
    # a copy of a smaller document's text loses all its words, if they make a run
    rows = docs.select("key", "id", F.md5("text").alias("same"), n_words(F.col("text")).alias("n_words")).filter("id is not null")
    rows = Stash(rows.filter(F.col("n_words") >= window), "rows")
    least = rows.df.groupBy("same").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    copies = Stash(salted(rows.df, least, ["same"]).filter("id > least").select("key", "id", "n_words"), "copies").df
    rows.drop()
    whole = copies.select("id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("" if texts else None).cast("string").alias("kept_text"))
    docs = without(docs, copies.select(F.struct("key", "id").alias("key")), F.struct("key", "id"))

    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(MIN_BUCKETS, -(-n_bytes // BUCKET_BYTES))
    # tasks grow in number with the buckets, not in size
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_buckets)
    known = docs.filter("id is not null").select("key", "id", "text")
    hot = _hot_windows(known, n_bytes, block, window)
    anchors = known.mapInArrow(_anchors(block, window, n_buckets, hot[block]), PACKED).repartition(tasks, "bucket")
    hits = Stash(anchors.groupBy("bucket").applyInArrow(_probe(n_buckets), BITS), "anchors")
    del anchors
    free_shuffles(docs.sparkSession)

    found = hits.df.dropDuplicates(["key", "id", "bucket"]).groupBy("key", "id").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))
    kind = "array<struct<bucket:int,bits:binary>>"
    both = docs.join(found, ["key", "id"], "left").select("key", "id", "text", "found")
    split = Stash(both.mapInArrow(_split(block, window, n_buckets, texts), f"key int, id long, n_words long, found {kind}, sha string, kept string, text string"), "split").df
    del both, found
    free_shuffles(docs.sparkSession)
    hits.drop()

    open_rows = split.filter("text is not null")
    wide = open_rows.select("key", "id", "text", "found").mapInArrow(_wide(block, window, n_buckets, hot), PACKED).repartition(tasks, "bucket")
    later = Stash(wide.groupBy("bucket").applyInArrow(_least(n_buckets), BITS), "repeats").df
    least = np.full(len(hot[window]), np.iinfo(np.int64).max)
    for r in later.filter("bucket < 0").collect():  # a row for each hot run
        least[np.searchsorted(hot[window][:, 0], np.frombuffer(r["bits"], U64)[0])] = r["id"]
    later = later.filter("bucket >= 0").dropDuplicates(["key", "id", "bucket"]).groupBy("key", "id").agg(F.collect_list(F.struct("bucket", "bits")).alias("later"))
    done = open_rows.join(later, ["key", "id"], "left").select("id", "text", "found", "later")
    done = done.mapInArrow(_apply(block, window, n_buckets, texts, hot, least), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    clean = split.filter("text is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.col("kept").alias("kept_text"))
    return done.unionByName(clean).unionByName(whole).withColumnRenamed("id", id_col)
