"""Near-duplicate classes from DartMinHash signatures of word shingles.

1. Each text becomes the set of its distinct five-word shingles. Texts with the same set share a digest
   and go on as one node.
2. DartMinHash: darts fall on every element's plane of (weight, rank) as a Poisson process that depends
   on the element alone. Those below the element's weight and below a rank chosen for about
   k ln k + 2k darts are hashed to k coordinates; each coordinate keeps the dart of least rank. Two sets
   agree in a coordinate with the probability of their weighted Jaccard similarity.
3. Bands of coordinates are buckets. Every member is compared to its bucket's centre, so a group of n
   copies gives n pairs a band, not n squared.
4. Exact Jaccard similarities of these pairs decide; components of the links are formed. Large buckets
   that then still hold more than one component are given new centres, round by round, as long as that
   joins much of what is apart.
5. In the buckets that still hold more than one component, the members outside the largest one are
   compared with all others but the centre, in blocks of signatures alone. Pairs that these leave over are
   compared exactly; buckets that leave very many fetch their sets and are searched until what is alike is joined.
   Pairs inside a component are never needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.shared import Stash, rows_fit, salted
from lectern.llm.textbytes import U64, Hasher, Words, give_back, mix, ngrams, seeded

#: Members of a block of a bucket; buckets of more are given new centres before they are searched in blocks.
BLOCK = 128
#: Members of a block of signatures alone, which are 320 bytes each.
SIG_BLOCK = 1024
#: Pairs for a row of a block up to which a block names them; a bucket with more is searched with its sets at hand.
FEW = 4
#: Pairs that are compared together.
PAIRS = 256
#: Elements that are compared or thrown darts at in one go.
SLICE = 1 << 20
#: Up to this number, hashes of the sets to compare are broadcast (16 MB or so) to leave out all others before the shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct n-word shingles, sorted; a shorter text with a word is one shingle."""
    at, sh = ngrams(words, n)
    rows = words.rows()
    row, counts = rows[at], words.counts
    for m in range(1, n):
        first = words.row_off[:-1][counts == m]
        if len(first):
            at, h = ngrams(words, m)
            keep = np.isin(at, first)
            row, sh = np.concatenate([row, rows[at[keep]]]), np.concatenate([sh, h[keep]])
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return row[start], sh[start], np.diff(np.append(start, len(sh)))


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts from uniform values below 1."""
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
    return np.searchsorted(steps, u, "right")


def _throw(r: np.ndarray, element: np.ndarray, w: np.ndarray, limit: np.ndarray, salt: np.ndarray, sig: np.ndarray) -> None:
    """Lowers ``sig`` to the earliest darts that hit the regions of some elements, up to the ranks of ``limit``."""
    e, k = mix(element ^ salt[0]), sig.shape[1]
    # unit cells of (weight, rank) that the element's region touches
    tall, wide = np.ceil(w).astype(np.int64), np.ceil(limit).astype(np.int64)
    cells = tall * wide
    for lo, hi in _slices(cells, SLICE):
        c = cells[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        a, b = j // wide[i], j % wide[i]
        cell = mix(e[i] + a.astype(U64) * salt[1] + b.astype(U64) * salt[2])
        n = _poisson((cell >> U64(11)) * 2.0**-53)
        i, cell, a, b = (np.repeat(x, n) for x in (i, cell, a, b))
        nth = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(cell + (nth + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
        high, rank = a + (dart >> U64(40)) * 2.0**-24, b + (mix(dart) >> U64(24)) * 2.0**-40
        hit = (high < w[i]) & (rank < limit[i])
        i, dart, rank = i[hit], dart[hit], rank[hit]
        where = r[i] * k + ((dart >> U64(16)) % U64(k)).astype(np.int64)
        # the rank leads, so the least value is the earliest dart; its low bits tell darts apart
        value = ((rank * 2.0**24).astype(U64) << U64(24)) | (dart & U64(0xFFFFFF))
        np.minimum.at(sig.reshape(-1), where, value)


def dart_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures (n_rows, k) of weighted sets; 2**64-1 throughout for an empty set.

    row, element (64-bit), weight (> 0): the members of the sets, ordered by row.
    """
    empty = U64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n_rows, k), empty)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    todo, darts = total > 0, k * math.log(k) + 2 * k
    salt = seeded(seed, 3)
    while todo.any():
        use = np.flatnonzero(todo[row])
        for at in range(0, len(use), SLICE):
            some = use[at : at + SLICE]
            _throw(row[some], element[some], weight[some], darts / total[row[some]], salt, sig)
        open_rows = todo & (sig == empty).any(axis=1)
        sig[open_rows] = empty
        todo, darts = open_rows, darts * 2
    return sig


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    mult = seeded(23, rows) | U64(1)
    parts = mix(sig.copy()).reshape(len(sig), bands, rows) * mult
    return mix(parts.sum(axis=2, dtype=U64) + seeded(29, bands))


def _digest(part: np.ndarray) -> bytes:
    return hashlib.md5(part.tobytes()).digest()


def _sign(shingle: int, k: int, bands: int, weighted: bool):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(batch.column(1)):
                row, sh, n = shingle_sets(words, shingle)
                sig = dart_minhash(row, sh, n.astype(float) if weighted else np.ones(len(n)), hi - lo, k)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                body = np.stack([sh, n.astype(U64)], 1) if weighted else sh
                digest = [_digest(body[s:t]) if t > s else None for s, t in zip(cut[:-1], cut[1:], strict=True)]
                keys = band_keys(sig, bands).view(np.int64)
                short = sig.astype(np.uint32)
                bare = np.diff(cut) == 0
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(digest, pa.binary()),
                        pa.array(np.diff(cut)),
                        flat,
                        pa.array([None if b else s.tobytes() for b, s in zip(bare, short, strict=True)], pa.binary()),
                    ],
                    ["id", "digest", "n_shingles", "bands", "sig"],
                )
        give_back()

    return run


def _sets(shingle: int, weighted: bool):
    """The sets by their digests: the shingles' hashes in order, each followed by its count if weighted."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(batch.column(0)):
                row, sh, n = shingle_sets(words, shingle)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                body = np.stack([sh, n.astype(U64)], 1) if weighted else sh
                members = [body[s:t].tobytes() for s, t in zip(cut[:-1], cut[1:], strict=True) if t > s]
                digest = [hashlib.md5(m).digest() for m in members]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(members, pa.binary())], ["digest", "members"])
        give_back()

    return run


def jaccard(a: list[bytes], b: list[bytes], weighted: bool) -> np.ndarray:
    """Jaccard similarities of pairs of sets, as ``_sets`` packs them."""
    out, width = np.zeros(len(a)), 2 if weighted else 1
    sizes = np.array([(len(x) + len(y)) // (8 * width) for x, y in zip(a, b, strict=True)], np.int64)
    for lo, hi in _slices(sizes, SLICE):
        sides = [x for pair in zip(a[lo:hi], b[lo:hi], strict=True) for x in pair]
        values = np.frombuffer(b"".join(sides), U64).reshape(-1, width)
        pair = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        order = np.lexsort((values[:, 0], pair))  # pairs stay in place; of each, two runs in order are merged
        key, count = values[order, 0], values[order, 1].astype(float) if weighted else np.ones(len(order))
        same = np.flatnonzero((key[1:] == key[:-1]) & (pair[1:] == pair[:-1]))
        both = np.bincount(pair[same], weights=np.minimum(count[same], count[same + 1]), minlength=hi - lo)
        out[lo:hi] = both / (np.bincount(pair, weights=count, minlength=hi - lo) - both)
    return out


def _compare(threshold: float, weighted: bool):
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PAIRS):
                a, b, x, y = whole.slice(lo, PAIRS).columns
                mask = pa.array(jaccard(x.to_pylist(), y.to_pylist(), weighted) >= threshold)
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])
        give_back()

    return run


def _near(table: pa.Table, k: int, least: int, most: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Of two blocks of a bucket, or of one: the pairs of different components that agree in at least ``least`` coordinates,
    the most alike first, as row numbers (2, pairs), not all of them once they are over ``most``; and a number for the component of each row."""
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, k)
    _, label = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
    place = table["place"].to_numpy()
    one = place.min() == place.max()
    left, right = (np.arange(len(place)),) * 2 if one else (np.flatnonzero(place == 0), np.flatnonzero(place == 1))
    found, n = [np.zeros((3, 0), np.int64)], 0
    for p in left:
        if n > most:
            break
        q = right[right > p] if one else right
        q = q[label[q] != label[p]]
        alike = (sig[q] == sig[p]).sum(axis=1)
        use = alike >= least
        found.append(np.stack([np.full(use.sum(), p), q[use], alike[use]]))
        n += found[-1].shape[1]
    pairs = np.concatenate(found, axis=1)
    return pairs[:2, np.argsort(-pairs[2], kind="stable")], label


def _named(k: int, least: int):
    """The pairs (a, b) of digests of two blocks that ``_near`` finds; one row without any if they are more than FEW for a row."""

    def run(key, table):
        pairs, _ = _near(table, k, least, FEW * table.num_rows)
        if pairs.shape[1] > FEW * table.num_rows:
            a = b = [None]
        else:
            digest = table["digest"].to_pylist()
            a, b = ([digest[p] for p in side] for side in pairs)
        place = [pa.array([x.as_py()] * len(a), pa.int64()) for x in key]
        return pa.table([*place, pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["band", "i", "j", "a", "b"])

    return run


def _blocks(k: int, least: int, threshold: float, weighted: bool):
    """Links between the components of two blocks of a bucket, or within one, enough of them to join what the exact comparison joins.

    Pairs that agree in at least ``least`` coordinates are compared, the most alike first; those whose ends
    have met by then need no comparison. So no more links leave a block than it has rows.
    """

    def run(table):
        digest, members = table["digest"].to_pylist(), table["members"]
        pairs, label = _near(table, k, least)
        a, b = [], []
        while pairs.shape[1]:
            some, pairs = pairs[:, :PAIRS], pairs[:, PAIRS:]
            alike = jaccard([members[int(p)].as_py() for p in some[0]], [members[int(q)].as_py() for q in some[1]], weighted)
            for p, q in some[:, alike >= threshold].T:
                if label[p] != label[q]:
                    label[label == label[q]] = label[p]
                    a.append(digest[p])
                    b.append(digest[q])
            pairs = pairs[:, label[pairs[0]] != label[pairs[1]]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _sets_of(ends: DataFrame, docs: DataFrame, shingle: int, weighted: bool) -> Stash:
    """(digest, members) of the digests in ``ends``."""
    sets = docs.select("text").mapInArrow(_sets(shingle, weighted), "digest binary, members binary")
    few = Stash(ends.select("digest").distinct(), "ends")
    if rows_fit(few.df, BROADCAST_ROWS):
        hashes = F.broadcast(few.df.select(F.xxhash64("digest").alias("h")))
        sets = sets.join(hashes, F.xxhash64(sets["digest"]) == hashes["h"], "left_semi")
    # copies become one before the shuffle
    out = Stash(sets.groupBy("digest").agg(F.first("members").alias("members")).join(few.df, "digest", "left_semi"), "sets")
    few.drop()
    return out


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """The pairs (a, b) of digests whose sets reach the threshold, compared member by member."""
    with_a = pairs.join(sets.select(F.col("digest").alias("a"), F.col("members").alias("x")), "a")
    both = with_a.join(sets.select(F.col("digest").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_compare(threshold, weighted), "a binary, b binary")


class _Buckets:
    """Members of shared buckets under the labels of their components."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.spark, self.links = members.sparkSession, [Stash(links, "links")]
        label = components(self.links[0].df).select(F.col("node").alias("digest"), "label")
        self.named = Stash(members.join(label, "digest", "left").select("band", "digest", "centre", F.coalesce("label", "digest").alias("label")), "named")
        self.measure()

    def measure(self) -> None:
        """mixed: the buckets of more than one component, with the largest one and the numbers of members in it and outside.

        Buckets of two are none: their members have been compared, one being the centre.
        """
        per = self.named.df.groupBy("band", "label").agg(F.count("*").alias("n"))
        per = per.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_other"))
        self.mixed = Stash(per.filter("n_other > 0 and n_main + n_other > 2"), "mixed")

    def add(self, links: DataFrame) -> bool:
        """Joins what new links (between digests) join; whether there are any."""
        more = Stash(links, "links")
        self.links.append(more)
        if not more.df.limit(1).count():
            return False
        of = self.named.df.select("digest", "label").distinct()
        ends = more.df.join(of.select(F.col("digest").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("digest").alias("b"), F.col("label").alias("lb")), "b")
        moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
        old, self.named = self.named, Stash(self.named.df.join(moved, "label", "left").select("band", "digest", "centre", F.coalesce("to", "label").alias("label")), "named")
        old.drop()
        return True

    def outside(self) -> int:
        """Members of large mixed buckets that are not in their bucket's largest component."""
        return self.mixed.df.filter(F.col("n_main") + F.col("n_other") > BLOCK).agg(F.coalesce(F.sum("n_other"), F.lit(0))).first()[0]

    def to_new_centres(self, nth: int) -> DataFrame:
        """Pairs of the members of large mixed buckets and a centre of theirs, another one for each ``nth``."""
        rows = self.named.df.join(self.mixed.df.filter(F.col("n_main") + F.col("n_other") > BLOCK).select("band"), "band", "left_semi")
        order = F.struct(F.xxhash64("digest", F.lit(nth)).alias("h"), F.col("digest").alias("d"), "label")
        centre = rows.groupBy("band").agg(F.min(order).alias("c"))
        apart = rows.join(centre, "band").filter(F.col("label") != F.col("c.label"))
        return apart.select(F.greatest("digest", F.col("c.d")).alias("a"), F.least("digest", F.col("c.d")).alias("b")).distinct()

    def blocks(self, size: int) -> DataFrame:
        """(band, i, j, place, digest, label): every pair of blocks of a mixed bucket, less those inside the largest component.

        Blocks of members outside the largest component have even numbers, the others odd ones; place tells the two of a pair apart.
        The centre is in no block, as all members have been compared with it.
        """
        rows = self.named.df.filter("digest <> centre").join(self.mixed.df, "band")
        other = F.col("label") != F.col("main")
        count = lambda c: F.ceil(F.col(c) / size).cast("int")
        mine = F.pmod(F.xxhash64("digest"), F.when(other, count("n_other")).otherwise(count("n_main"))).cast("int")
        rows = rows.withColumn("blk", 2 * mine + F.when(other, 0).otherwise(1))
        evens = F.transform(F.sequence(F.lit(0), count("n_other") - 1), lambda x: 2 * x)
        odds = F.transform(F.sequence(F.lit(0), count("n_main") - 1), lambda x: 2 * x + 1)
        rows = rows.withColumn("with", F.explode(F.when(other, F.concat(evens, odds)).otherwise(evens)))
        return rows.select("band", F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"), (F.col("blk") > F.col("with")).cast("int").alias("place"), "digest", "label")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8,
    bands: int = 20, rows: int = 4, weighted: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_rows, n_shingles.

    Two texts are linked if the Jaccard similarity of their word shingles is at least ``threshold``
    (``weighted``: of the multisets, counts as weights); classes are the components of the links, and
    class_id is the least id in the class. At similarity s a pair shares no band with probability
    (1 - s**rows)**bands, 3e-5 at 0.8.

    Null, empty and white-space texts have no shingles: each such row is a class of its own, with
    its own id as class_id. A text of one to four words is one shingle. Repeated rows are one class.
    Null ids never are class_id, unless the whole class has none. Texts of any length are taken whole:
    a set takes 8 bytes a distinct shingle and some 32 while it is made. A task holds the sets of two texts to compare
    them, and those of 2 * BLOCK texts of a bucket that is searched in blocks. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    k = bands * rows
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    signed = Stash(docs.mapInArrow(_sign(shingle, k, bands, weighted), f"id {id_type}, digest binary, n_shingles long, bands array<long>, sig binary"), "signed").df

    nodes = signed.filter("digest is not null").select("digest", "bands").dropDuplicates(["digest"])
    buckets = Stash(nodes.select("digest", F.explode("bands").alias("band")), "buckets")
    nth = F.struct(F.xxhash64("digest").alias("h"), F.col("digest").alias("d"))
    shared = buckets.df.groupBy("band").agg(F.min(nth)["d"].alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = Stash(buckets.df.join(shared, "band"), "members")
    buckets.drop()
    pairs = members.df.filter("digest <> centre").select(F.greatest("digest", "centre").alias("a"), F.least("digest", "centre").alias("b")).distinct()
    sets = _sets_of(members.df, docs, shingle, weighted)
    state = _Buckets(members.df, _linked(pairs, sets.df, threshold, weighted))
    members.drop()

    # new centres for large buckets, while a round joins a tenth of what is apart; the blocks are exact on what is left
    left, turn = state.outside(), 0
    while left:
        turn += 1
        if not state.add(_linked(state.to_new_centres(turn), sets.df, threshold, weighted)):
            break
        state.mixed.drop()
        state.measure()
        before, left = left, state.outside()
        if left > 0.9 * before:
            break

    rest = Stash(state.blocks(SIG_BLOCK), "blocks")
    sigs = signed.filter("digest is not null").select("digest", "sig").dropDuplicates(["digest"])
    sigs = Stash(sigs.join(rest.df.select("digest").distinct(), "digest", "left_semi"), "sigs")
    # at similarity 0.8 under 0.6 of 80 coordinates agree with probability 1e-5 and less above it
    least = int(k * threshold * 0.75)
    near = rest.df.join(sigs.df, "digest").groupBy("band", "i", "j").applyInArrow(_named(k, least), "band long, i long, j long, a binary, b binary")
    near = Stash(near, "near")
    state.add(_linked(near.df.filter("a is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets.df, threshold, weighted))
    full = near.df.filter("a is null").select("band").distinct()
    if full.limit(1).count():
        state.mixed.drop()
        state.measure()
        theirs = sigs.df.join(sets.df, "digest")
        more = state.blocks(BLOCK).join(full, "band", "left_semi").join(theirs, "digest")
        more = more.groupBy("band", "i", "j").applyInArrow(_blocks(k, least, threshold, weighted), "a binary, b binary")
        state.add(more.distinct())
    label = state.named.df.select("digest", "label").distinct()
    for stash in (sets, state.mixed, rest, sigs, near, *state.links):
        stash.drop()

    rows_ = signed.select("id", "digest", "n_shingles")
    per_digest = rows_.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    per_digest = Stash(per_digest.join(label, "digest", "left"), "digests").df
    state.named.drop()
    # digests that share no bucket are classes of their own; those of a class look it up, dealt over several places
    alone = per_digest.filter("label is null").withColumn("class_id", F.col("least")).withColumn("class_rows", F.col("n")).drop("label")
    known = per_digest.filter("label is not null")
    of_class = known.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows"))
    classes = alone.unionByName(salted(known, of_class, ["label"]).drop("label"))
    # a digest of one row is that row; the rows of the others look theirs up, dealt over several places
    single = classes.filter("n = 1").select(F.col("least").alias("id"), "class_id", "class_rows", "n_shingles")
    several = salted(rows_.filter("digest is not null"), classes.filter("n > 1").select("digest", "class_id", "class_rows"), ["digest"])
    out = single.unionByName(several.select("id", "class_id", "class_rows", "n_shingles"))
    bare = rows_.filter("digest is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"), "n_shingles")
    return out.unionByName(bare).withColumnRenamed("id", id_col)
