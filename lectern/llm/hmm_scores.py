"""Language-model scores of a hidden Markov model over word classes.

A text is its words and one end token. A token's class is the word itself for the most frequent words,
else a hash of its ending, so that words never seen have a class too. Hidden states move by a transition
matrix and emit classes; a class emits its words by their smoothed share of it:

    P(text) = sum over state paths of  start * move * ... * prod P(class | state) * P(word | class)

Baum-Welch: every partition sums its expected counts, Spark adds them up, the driver (which holds states
x classes numbers, whatever the corpus) normalises. The scaled forward recursion gives the likelihood of
whole texts, exactly; long texts go through it in pieces whose transfer matrices are multiplied.

Word counts stay distributed. Those of the most frequent words (a fixed number) go to every task, which
also keeps hot keys out of the join by which the others are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, free_shuffles, text_of
from lectern.llm.textbytes import U64, Hasher, Words, mix, seeded

STATES, ROUNDS = 8, 8
HEAD, TAIL = 4096, 2048  # classes of single words, and of endings
KNOWN = 1 << 17  # most frequent words whose counts every task gets
PIECE_FIT, PIECE_SCORE = 256, 1024  # tokens
BATCH_TOKENS = 1 << 20
END = np.uint64(0x5EED5EED5EED5EED)
PRIOR = 20.0  # counts of prior for each state's classes, shared by the classes' own frequencies


def tail_class(words: Words) -> np.ndarray:
    """The class of each word by its last three bytes and whether it is shorter."""
    data, out = words.data, np.zeros(len(words.starts), U64)
    salt = seeded(41, 4)
    for back in range(1, 4):
        at = words.ends - back
        there = at >= words.starts
        out += mix(np.where(there, data[np.maximum(at, 0)], 0).astype(U64) + salt[back - 1] * (1 + there.astype(U64)))
    return (mix(out) % U64(TAIL)).astype(np.int64)


def _lower(column: pa.Array) -> pa.Array:
    """A-Z (and nothing else) in lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    bufs = column.buffers()
    if bufs[2] is None:
        return column
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    low = table[np.frombuffer(bufs[2], np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, bufs[1], pa.py_buffer(low)], offset=column.offset)


def _count_words():
    """(word hash, class, count) of the words of a batch, and of the ends."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(_lower(batch.column(0))):
                h, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                cls = tail_class(words)[first]
                h, cls, n = np.append(h, END), np.append(cls, -1), np.append(n, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls.astype(np.int32)), pa.array(n)], ["h", "tail", "n"])

    return run


class Vocabulary:
    """What every task gets of the counts. The end comes first; it and the most frequent words have classes of their own."""

    def __init__(self, hashes: np.ndarray, tails: np.ndarray, counts: np.ndarray, tail_n: np.ndarray, tail_v: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.classes = np.where(order < HEAD, order, HEAD + tails[order])
        self.tail_log = np.log10(tail_n + 0.5 * (tail_v + 1))  # of what the smoothed shares in a class are parts

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _encode(vocabulary: Vocabulary):
    """Each text as classes; sums over its known words; its other words, to be looked up."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(_lower(batch.column(2))):
                n, rows = hi - lo, words.rows()
                at = vocabulary.find(words.hashes)
                known = at >= 0
                cls = HEAD + tail_class(words)
                cls[known] = vocabulary.classes[at[known]]
                log = np.zeros(len(at))
                log[known] = np.log10(vocabulary.counts[at[known]] + 0.5)
                of_tail = cls >= HEAD
                share = np.zeros(len(at))
                share[of_tail] = log[of_tail] - vocabulary.tail_log[cls[of_tail] - HEAD]
                rest = np.flatnonzero(~known)
                key = np.lexsort((words.hashes[rest], rows[rest]))
                r, h = rows[rest][key], words.hashes[rest][key]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(h))).astype(np.int32)
                offs = pa.array(np.searchsorted(r[start], np.arange(n + 1)).astype(np.int32))
                # one end token, of class 0, stands after the words
                seq = np.insert(cls, words.row_off[1:], 0).astype(np.int16)
                cut = words.row_off + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(words.counts + 1, pa.int64()),
                        pa.array(np.bincount(rows[known], minlength=n), pa.int64()), pa.array(np.bincount(rows, weights=log, minlength=n)), pa.array(np.bincount(rows, weights=share, minlength=n)),
                        pa.ListArray.from_arrays(offs, pa.array(h[start].view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(times)),
                        pa.array([seq[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "log_sum", "share_sum", "rest", "times", "classes"],
                )

    return run


ENCODED = "held_out boolean, n_tokens long, n_known long, log_sum double, share_sum double, rest array<long>, times array<int>, classes binary"


class Hmm:
    """start: (S), move: (S, S), emit: (S, C); all rows sum to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, frequency: np.ndarray, states: int, seed: int = 3) -> "Hmm":
        """States that stay, with the classes' frequencies disturbed at random."""
        rng = np.random.default_rng(seed)
        emit = frequency * np.exp(rng.normal(0, 0.7, (states, len(frequency))))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def expected(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected (start, move, emit) counts of pieces of sequences, and their log-likelihood.

        opening: pieces at the start of a text, which alone count for the start.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, opening = starts[order], lengths[order], opening[order]
        s, n_classes = self.emit.shape
        move, emit = self.move.astype(np.float32), np.ascontiguousarray(self.emit.T, np.float32)
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
        base = np.cumsum(np.append(0, active))  # items in order of step: neighbours in memory
        alpha, scale = np.empty((base[-1], s), np.float32), np.empty(base[-1], np.float32)
        seen = np.empty(base[-1], np.int64)
        a = np.where(opening[:, None], self.start, np.full(s, 1 / s)).astype(np.float32)
        for t in range(longest):
            n, here = active[t], slice(base[t], base[t + 1])
            o = classes[starts[:n] + t]
            a = (a if t == 0 else a[:n] @ move) * emit[o]
            c = a.sum(axis=1)
            a = a / c[:, None]
            alpha[here], scale[here], seen[here] = a, c, o
        log = float(np.log(scale, dtype=np.float64).sum())
        move_sum = np.zeros((s, s))
        b = np.ones((0, s), np.float32)
        for t in range(longest - 1, -1, -1):
            n, here = active[t], slice(base[t], base[t + 1])
            if len(b) < n:
                b = np.concatenate([b, np.ones((n - len(b), s), np.float32)])
            a = alpha[here]
            eb = emit[seen[here]] * b / scale[here][:, None]
            alpha[here] = a * b  # the posteriors of the states
            if t:
                before = alpha[base[t - 1] : base[t - 1] + n]
                move_sum += before.T @ eb
                b = eb @ move.T
        counts = np.stack([np.bincount(seen, weights=alpha[:, i], minlength=n_classes) for i in range(s)])
        first = (alpha[: active[0] if longest else 0] * opening[:, None]).sum(axis=0, dtype=np.float64) if longest else np.zeros(s)
        return first, move_sum * self.move, counts, log

    def updated(self, first: np.ndarray, moves: np.ndarray, counts: np.ndarray, frequency: np.ndarray) -> "Hmm":
        emit = counts + PRIOR * frequency
        start, move = first + 1.0, moves + 1.0
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))

    def log10(self, classes: np.ndarray, lengths: np.ndarray, piece: int) -> np.ndarray:
        """Exact log10 likelihood of each of the sequences laid end to end."""
        s, n = len(self.start), len(lengths)
        emit, first = np.ascontiguousarray(self.emit.T), np.cumsum(lengths) - lengths
        out = np.zeros(n)
        pieces = -(-lengths // piece)
        prior = np.tile(self.start, (n, 1))
        # whole pieces before the last of a long text: transfer matrices, one row for each state to start in
        inner = pieces - 1
        text = np.repeat(np.arange(n), inner)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(inner) - inner, inner)
        at = first[text] + nth * piece
        if len(text):
            rows, log = np.tile(np.eye(s), (len(text), 1, 1)), np.zeros((len(text), s))
            for t in range(piece):
                rows = (rows * emit[classes[at + t]][:, None, :]) @ self.move
                if t % 8 == 7 or t == piece - 1:
                    c = rows.sum(axis=2)
                    rows /= c[:, :, None]
                    log += np.log10(c)
            for k in range(int(inner.max())):
                use = np.flatnonzero(nth == k)
                top = log[use].max(axis=1)
                v = np.einsum("ns,nst->nt", prior[text[use]] * 10 ** (log[use] - top[:, None]), rows[use])
                c = v.sum(axis=1)
                prior[text[use]] = v / c[:, None]
                out[text[use]] += top + np.log10(c)
        start, left = first + inner * piece, lengths - inner * piece
        order = np.argsort(-left, kind="stable")
        start, left, a = start[order], left[order], prior[order]
        for t in range(int(left[0]) if n else 0):
            m = int(np.searchsorted(-left, -(t + 1), "right"))
            a = (a[:m] if t == 0 else a[:m] @ self.move) * emit[classes[start[:m] + t]]
            c = a.sum(axis=1)
            a = a / c[:, None]
            out[order[:m]] += np.log10(c)
        return out


def _sequences(column: pa.Array):
    """Runs of sequences of BATCH_TOKENS: (first, end, classes laid end to end, lengths)."""
    values = [np.frombuffer(x.as_buffer(), np.int16) for x in column]
    lengths = np.array([len(v) for v in values], np.int64)
    ends, lo = np.cumsum(lengths), 0
    while lo < len(values):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + BATCH_TOKENS, "right")))
        yield lo, hi, np.concatenate(values[lo:hi]).astype(np.int64), lengths[lo:hi]
        lo = hi


def _baum_welch(hmm: Hmm, piece: int):
    """Expected counts of a partition. item: -2 log-likelihood, -1 start, then moves by state, then classes."""

    def run(batches):
        s, n_classes = hmm.emit.shape
        first, moves, counts, log = np.zeros(s), np.zeros((s, s)), np.zeros((s, n_classes)), 0.0
        for batch in batches:
            for _, _, classes, lengths in _sequences(batch.column(0)):
                pieces = -(-lengths // piece)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * piece
                size = np.minimum(np.repeat(lengths, pieces) - nth * piece, piece)
                got = hmm.expected(classes, start, size, nth == 0)
                first, moves, counts, log = first + got[0], moves + got[1], counts + got[2], log + got[3]
        table = np.concatenate([[[log] * s], [first], moves, counts.T])
        item = np.arange(-2, len(table) - 2)
        use = table.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(item[use].astype(np.int32)), *(pa.array(table[use, i]) for i in range(s))], ["item", *(f"s{i}" for i in range(s))])

    return run


def _forward(hmm: Hmm, piece: int):
    def run(batches):
        for batch in batches:
            out = [hmm.log10(classes, lengths, piece) for _, _, classes, lengths in _sequences(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names[:-1], "hmm"])

    return run


def fit(encoded: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Baum-Welch over the ``classes`` of all rows; texts are cut into pieces of PIECE_FIT tokens, none left out."""
    hmm, logs, s = Hmm.initial(frequency, states), [], states
    schema = "item int, " + ", ".join(f"s{i} double" for i in range(s))
    for _ in range(rounds):
        part = encoded.select("classes").mapInArrow(_baum_welch(hmm, PIECE_FIT), schema)
        # states x (classes + states + 2) numbers
        rows = part.groupBy("item").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(s))).collect()
        table = np.zeros((2 + s + len(frequency), s))
        for r in rows:
            table[r[0] + 2] = r[1:]
        logs.append(float(table[0, 0]))
        hmm = hmm.updated(table[1], table[2 : 2 + s], table[2 + s :].T, frequency)
    return hmm, logs


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) modulo 5 is not 1 (null ids learn). base_score: log10
    likelihood of a unigram model with one half added to every count; score: of the hidden Markov model.
    Null texts are empty: one end token. Words are lower-cased A-Z. With nothing to learn from, all words
    are unknown. Repeated rows get the same result; an empty table gives an empty one. Texts of any length are
    scored whole; a text takes some 15 times its size of memory. Other columns, whatever their names, are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), text_of(text_col).alias("text"))
    words = rows.filter("not held_out").select("text").mapInArrow(_count_words(), "h long, tail int, n long")
    words = Stash(words.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "words").df
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # known are the words of the highest counts, in whole steps of a 64th of a doubling, as many as fit
    step = F.floor(F.log2("n") * 64).cast("int")
    sizes = words.filter("tail >= 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some thousands of rows
    fits = [r.step for r, upto in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if upto <= KNOWN]
    top = words.filter("tail >= 0").filter(step >= (fits[-1] if fits else 1 << 30)).toPandas().sort_values(["n", "h"], ascending=[False, True])
    # the tail classes hold all words but the head's; at most TAIL rows, and the end's at -1
    per_tail = {t: (n, v) for t, n, v in words.groupBy("tail").agg(F.sum("n"), F.count("*")).collect()}
    end_n = per_tail.pop(-1, (0, 0))[0]
    hashes, tails, counts = (np.append(x, top[c].to_numpy(np.int64)) for x, c in ((END.view(np.int64), "h"), (0, "tail"), (end_n, "n")))
    tail_n, tail_v = np.zeros(TAIL), np.zeros(TAIL)
    for t, (n, v) in per_tail.items():
        tail_n[t], tail_v[t] = n, v
    np.subtract.at(tail_n, tails[1:HEAD], counts[1:HEAD])
    np.subtract.at(tail_v, tails[1:HEAD], 1)
    vocabulary = Vocabulary(hashes.view(U64), tails, counts, tail_n, tail_v)
    free_shuffles(docs.sparkSession)

    kind = rows.schema["id"].dataType.simpleString()
    encoded = Stash(rows.mapInArrow(_encode(vocabulary), f"id {kind}, {ENCODED}").withColumn("rid", F.monotonically_increasing_id()), "encoded").df
    free_shuffles(docs.sparkSession)
    frequency = np.concatenate([np.zeros(HEAD), tail_n]) + 0.5
    frequency[: len(counts[:HEAD])] += counts[:HEAD]
    frequency /= frequency.sum()
    hmm, _ = fit(encoded.filter("not held_out"), frequency, states, rounds)

    rest = encoded.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("h"), "x.times")
    rest = rest.join(words.select("h", "n"), "h", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    rest = rest.groupBy("rid").agg(F.sum(log).alias("rest_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"))
    scored = encoded.select("rid", "id", "held_out", "n_tokens", "n_known", "log_sum", "share_sum", "classes")
    scored = scored.mapInArrow(_forward(hmm, PIECE_SCORE), f"rid long, id {kind}, held_out boolean, n_tokens long, n_known long, log_sum double, share_sum double, hmm double")
    out = scored.join(rest, "rid", "left")
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    whole = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0)) + int(end_n > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + rest_log + float(np.log10(end_n + 0.5)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("hmm") + F.col("share_sum") + rest_log).alias("score"),
    )
