"""Document quality: fixed rules, and line labels of a linear-chain conditional random field.

Every line with a word gets features; Viterbi decoding marks it content or boilerplate. A document is
kept if it passes the rules and enough of its words stand in content lines.

Labels are of documents, those of lines are latent: fitting alternates between the best labels of the
lines under the field, of which most words of a good document are content and most of a bad one are not,
and the field that fits these labels best. So a bad document may hold content, and a good one boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import text_of
from lectern.llm.textbytes import U64, Hasher, Words, give_back, mix, ngrams

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 0.2, 5
MIN_SHARE = 0.5
#: Labelled documents to fit on, at most; lines of a piece of theirs; pieces, at most.
SAMPLE_ROWS, PIECE_LINES, SAMPLE_PIECES = 2000, 256, 4000
#: Times that the lines are labelled anew, and gradient steps after each.
TURNS, STEPS = 4, 60
#: Lines of long texts that are decoded side by side.
STRIDE = 512
#: Edges of the bins of each ratio; every bin is one feature.
BINS = {"symbols": (0.001, 0.03, 0.1, 0.3), "upper": (0.25, 0.6), "marks": (0.05, 0.2, 0.5), "digits": (0.1, 0.4), "again": (0.1, 0.5), "repeat": (0.001, 0.2, 0.6), "words": (2.5, 4.5, 12.5)}
N_FEATURES = sum(len(e) + 1 for e in BINS.values()) + 2


class Lines:
    """Counts of the rows and features of their lines (those with a word)."""

    def __init__(self, hasher: Hasher, words: Words):
        data, offs, n = words.data, words.offs, len(words.offs) - 1
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.unique(np.concatenate([offs[:-1], breaks]))
        # a row's start is a line's start; an empty row has no line with a word
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        row = np.searchsorted(offs, starts, "right") - 1

        def per_line(members) -> np.ndarray:
            table = np.zeros(256, np.uint8)
            table[list(members)] = 1
            return np.add.reduceat(table[data], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

        solid_chars = per_line([b for b in range(256) if b not in (0x20, *range(9, 14)) and not 0x80 <= b < 0xC0])
        symbols, marks, digits = per_line(SYMBOLS), per_line(b"!"), per_line(range(48, 58))
        upper, lower = per_line(range(65, 91)), per_line(range(97, 123))
        self.counts = words.counts
        self.word_chars = np.bincount(row, weights=solid_chars, minlength=n).astype(np.int64)
        self.symbols = np.bincount(row, weights=symbols, minlength=n).astype(np.int64)

        line_of = np.searchsorted(starts, words.starts, "right") - 1
        line_words = np.bincount(line_of, minlength=len(starts))
        use = line_words > 0
        ends = ends - (data[ends - 1] == 10)
        starts, ends, row, line_words = starts[use], ends[use], row[use], line_words[use]
        solid_chars, symbols, marks, digits, upper, lower = (x[use] for x in (solid_chars, symbols, marks, digits, upper, lower))
        line_of = (np.cumsum(use) - 1)[line_of]
        self.row, self.words = row, line_words

        key = mix(hasher.long_spans(data, starts, ends) ^ mix(row.astype(U64) + U64(3)))
        order = np.argsort(key, kind="stable")
        dup = np.zeros(len(key), bool)
        dup[order[1:]] = key[order[1:]] == key[order[:-1]]
        self.dup_lines = np.bincount(row[dup], minlength=n)

        at, h = ngrams(words, WINDOW)
        wrow = words.rows()
        key = mix(h ^ mix(wrow[at].astype(U64) + U64(5)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        m = len(words.starts)
        edge = np.bincount(at[twice], minlength=m + 1) - np.bincount(at[twice] + WINDOW, minlength=m + 1)
        again5 = np.cumsum(edge[:m]) > 0
        self.repeat_words = np.bincount(wrow[again5], minlength=n)

        again = np.zeros(m, bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (line_of[1:] == line_of[:-1])
        chars, letters = np.maximum(solid_chars, 1), np.maximum(upper + lower, 1)
        ratios = {
            "symbols": symbols / chars, "upper": upper / letters, "marks": marks / line_words, "digits": digits / chars,
            "again": np.bincount(line_of[again], minlength=len(starts)) / line_words,
            "repeat": np.bincount(line_of[again5], minlength=len(starts)) / line_words, "words": line_words,
        }
        columns = [np.ones(len(starts), bool), dup]
        for name, edges in BINS.items():
            bin_ = np.searchsorted(edges, ratios[name], "right")
            columns += [bin_ == i for i in range(len(edges) + 1)]
        self.features = np.stack(columns, 1).astype(np.uint8)

    def base_failed(self) -> np.ndarray:
        return (self.counts < MIN_WORDS) | (100 * self.repeat_words > int(100 * MAX_REPEAT) * self.counts)


def _steps(lengths: np.ndarray):
    """For sequences laid end to end: (step, sequences that reach it, their items), longest first."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), "right")
    for t, n in enumerate(active):
        yield t, n, first[:n] + t


class Crf:
    """Labels 0 (content) and 1 (boilerplate): emission weights and transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def untrained(cls) -> "Crf":
        return cls(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels; content on ties.

        Long sequences are decoded in pieces side by side: what each piece makes of either state before it,
        chained, gives the state that it really starts from; then both states at its end are traced back.
        """
        score, lengths = features @ self.emit, lengths[lengths > 0]
        if not len(lengths):
            return np.zeros(0, np.int64)
        n_pieces = -(-lengths // STRIDE)
        seq = np.repeat(np.arange(len(lengths)), n_pieces)
        top = np.cumsum(n_pieces) - n_pieces  # the first piece of each sequence
        nth = np.arange(len(seq)) - top[seq]
        size = np.minimum(lengths[seq] - nth * STRIDE, STRIDE)
        first = np.cumsum(size) - size
        enter = np.zeros((len(seq), 2))
        inner = np.flatnonzero(nth < n_pieces[seq] - 1)
        if len(inner):
            at = first[inner]
            through = np.where((nth[inner] > 0)[:, None, None], self.move, 0.0) + score[at][:, None, :]
            for t in range(1, STRIDE):
                through = (through[:, :, :, None] + self.move).max(axis=2) + score[at + t][:, None, :]
            for k in range(int(nth[inner].max()) + 1):
                use = nth[inner] == k
                enter[inner[use] + 1] = (enter[inner[use]][:, :, None] + through[use]).max(axis=1)

        back, paths = np.zeros((len(score), 2), np.int8), np.zeros((len(score), 2), np.int8)
        order = np.argsort(-size, kind="stable")
        later = (nth[order] > 0)[:, None]
        steps = list(_steps(size))
        best, last = None, np.zeros((len(seq), 2))
        for t, n, at in steps:
            if t:
                last[order[n : len(best)]] = best[n:]
                best = best[:n]
            options = (enter[order] if t == 0 else best)[:, :, None] + self.move
            back[at] = options.argmax(axis=1)
            best = np.where(later, options.max(axis=1), 0.0) + score[at] if t == 0 else options.max(axis=1) + score[at]
        last[order[: len(best)]] = best
        state = np.tile(np.arange(2, dtype=np.int8), (len(seq), 1))
        for _, n, at in reversed(steps):
            paths[at] = state[:n]
            state[:n] = np.take_along_axis(back[at], state[:n].astype(np.int64), 1)
        before = np.zeros((len(seq), 2), np.int64)
        before[order] = state
        chosen = last.argmax(axis=1)
        for k in range(int(n_pieces.max()) - 1, 0, -1):
            use = top[n_pieces > k] + k
            chosen[use - 1] = before[use, chosen[use]]
        return paths[np.arange(len(score)), np.repeat(chosen, size)].astype(np.int64)

    @classmethod
    def fit(cls, features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 150, l2: float = 1e-3, start: "Crf | None" = None) -> "Crf":
        """Maximum likelihood with L2, by Adam on the exact gradient of forward-backward."""
        crf = start or cls.untrained()
        lengths = lengths[lengths > 0]
        if not len(lengths):
            return crf
        x, n_items = features.astype(float), len(features)
        gold = np.eye(2)[labels]
        first = np.zeros(n_items, bool)
        first[np.cumsum(lengths) - lengths] = True
        pairs = np.flatnonzero(~first)
        gold_move = np.zeros((2, 2))
        np.add.at(gold_move, (labels[pairs - 1], labels[pairs]), 1)
        steps = list(_steps(lengths))
        theta, m, v = np.concatenate([crf.emit.ravel(), crf.move.ravel()]), 0.0, 0.0
        for i in range(1, rounds + 1):
            crf = cls(theta[:-4].reshape(N_FEATURES, 2), theta[-4:].reshape(2, 2))
            score, move = np.exp(np.clip(x @ crf.emit, -30, 30)), np.exp(np.clip(crf.move, -30, 30))
            fwd, bwd = np.zeros((n_items, 2)), np.ones((n_items, 2))
            for t, _, at in steps:
                a = score[at] if t == 0 else (fwd[at - 1] @ move) * score[at]
                fwd[at] = a / a.sum(axis=1, keepdims=True)
            for t, _, at in reversed(steps):
                if t:
                    b = (score[at] * bwd[at]) @ move.T
                    bwd[at - 1] = b / b.sum(axis=1, keepdims=True)
            post = fwd * bwd
            post /= post.sum(axis=1, keepdims=True)
            joint = fwd[pairs - 1][:, :, None] * move * (score[pairs] * bwd[pairs])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            grad = np.concatenate([(x.T @ (gold - post)).ravel(), (gold_move - joint.sum(axis=0)).ravel()]) / n_items - l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return cls(theta[:-4].reshape(N_FEATURES, 2), theta[-4:].reshape(2, 2))


    @classmethod
    def fit_latent(cls, features: np.ndarray, words: np.ndarray, lengths: np.ndarray, bad: np.ndarray, share: float = MIN_SHARE, pieces: np.ndarray | None = None) -> "Crf":
        """Fits on sequences of lines of documents of which only a label as a whole is known: ``bad`` or not.

        A document is ``pieces`` sequences that follow each other (one without it): its lines' labels have to agree
        with its own label over all of them.
        """
        lengths, bad = np.asarray(lengths), np.asarray(bad, bool)
        first = np.arange(len(lengths)) if pieces is None else np.cumsum(pieces) - pieces
        of_doc = np.add.reduceat(lengths, first) if len(lengths) else lengths
        # at first lines are as their documents are; then each by itself, since no document has changed its label yet
        crf = cls.fit(features, lengths, np.repeat(bad, of_doc).astype(np.int64), STEPS)
        crf = cls(crf.emit, np.zeros((2, 2)))
        for _ in range(TURNS):
            label = _agreed(crf.viterbi(features, lengths), features @ crf.emit, words, of_doc, bad, share)
            crf = cls.fit(features, lengths, label, STEPS, start=crf)
        return crf


def _agreed(label: np.ndarray, score: np.ndarray, words: np.ndarray, lengths: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
    """The labels, with as many lines changed, the likeliest first, as it takes that each document's share of content agrees with ``bad``."""
    ends = np.cumsum(lengths)
    for lo, hi, wrong in zip(ends - lengths, ends, bad, strict=True):
        here, n = label[lo:hi], words[lo:hi]
        content = n[here == 0].sum()
        if (content < share * n.sum()) != wrong:
            order = np.argsort((score[lo:hi, 0] - score[lo:hi, 1]) * (1 if wrong else -1), kind="stable")
            order = order[here[order] != wrong]
            upto = content - np.cumsum(n[order]) if wrong else content + np.cumsum(n[order])
            done = upto < share * n.sum() if wrong else upto >= share * n.sum()
            here[order[: int(np.argmax(done)) + 1]] = int(wrong)
    return label


def _features():
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(batch.column(0)):
                lines = Lines(hasher, words)
                # a row's pieces of PIECE_LINES lines
                first = np.searchsorted(lines.row, np.arange(hi - lo))
                at = np.arange(len(lines.row)) - first[lines.row]
                cut = np.flatnonzero(at % PIECE_LINES == 0)
                spans = list(zip(cut, np.append(cut[1:], len(at)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(pa.array(lo + lines.row[cut])) for c in batch.columns[1:]), pa.array(at[cut] // PIECE_LINES), pa.array([lines.features[s:t].tobytes() for s, t in spans], pa.binary()),
                        pa.array([lines.words[s:t].astype(np.int64).tobytes() for s, t in spans], pa.binary()),
                    ],
                    ["quality", "doc", "nth", "features", "words"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Crf:
    """Fits on the lines of the ``sample_rows`` labelled documents of least hash, in pieces of PIECE_LINES.

    If there are more than SAMPLE_PIECES pieces, those of least hash are used. A document is good if its
    quality is 1, bad if 0 (the least of several); that is asked of all its pieces together, so one of them may
    be boilerplate throughout. Without labelled documents all lines are content.
    """
    sample = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # so it may be broadcast
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc")).join(F.broadcast(sample), "doc_id")
    pieces = rows.select("text", "quality", "doc").mapInArrow(_features(), "quality long, doc long, nth long, features binary, words binary")
    order = (F.xxhash64("doc", "nth"), "doc", "nth", "features", "words", "quality")
    found = pieces.orderBy(*order).limit(SAMPLE_PIECES).collect()  # a piece takes some 10 KB at most
    if not found:
        return Crf.untrained()
    found.sort(key=lambda r: (r.doc, r.nth))
    words = [np.frombuffer(r.words, np.int64) for r in found]
    features = np.frombuffer(b"".join(r.features for r in found), np.uint8).reshape(-1, N_FEATURES)
    _, first, pieces_of = np.unique([r.doc for r in found], return_index=True, return_counts=True)
    return Crf.fit_latent(features, np.concatenate(words), np.array([len(w) for w in words]), np.array([found[i].quality == 0 for i in first]), pieces=pieces_of)


def _judge(crf: Crf, min_share: float):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(batch.column(1)):
                lines, n = Lines(hasher, words), hi - lo
                label = crf.viterbi(lines.features, np.bincount(lines.row, minlength=n))
                content = np.bincount(lines.row, weights=lines.words * (label == 0), minlength=n)
                share = content / np.maximum(lines.counts, 1)
                failed = lines.base_failed()
                columns = [lines.counts, lines.word_chars, lines.symbols, lines.dup_lines, lines.repeat_words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), *(pa.array(c, pa.int64()) for c in columns), pa.array(share), pa.array(failed), pa.array(~failed & (share >= min_share))],
                    ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"],
                )

    return run


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows get the same result; an empty table gives an
    empty one. Other columns, whatever their names, are ignored. Texts of any length are judged whole; a text
    takes some 15 times its size of memory.
    """
    crf = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_judge(crf, min_share), f"id {kind}, {COUNTS}").withColumnRenamed("id", id_col)


def _sieve(crf: Crf, min_share: float, text_at: int):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, words in hasher.chunks(batch.column(text_at)):
                lines, n = Lines(hasher, words), hi - lo
                label = crf.viterbi(lines.features, np.bincount(lines.row, minlength=n))
                content = np.bincount(lines.row, weights=lines.words * (label == 0), minlength=n)
                keep = ~lines.base_failed() & (content >= min_share * lines.counts)
                yield batch.slice(lo, n).filter(pa.array(keep))
        give_back()

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, in one pass and without a join."""
    crf = train(docs, labels, id_col, text_col)
    return docs.mapInArrow(_sieve(crf, min_share, docs.columns.index(text_col)), docs.schema)
