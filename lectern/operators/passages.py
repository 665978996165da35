"""Which texts hold which passages as they stand, in one reading of the texts, by windows of bytes.

Every passage has an anchor: a window of 32 bytes of it, or of the largest power of two that it has. All windows of
a text are hashed side by side; where one has an anchor's hash, the passage is compared byte by byte. Equal
texts are equal UTF-8, so nothing is lost, and only pairs that hold are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.trigram import build_trigrams, containing
from lectern.sources.scratch import scratch, spread

#: Bytes of an anchor at most; windows of a passage, evenly spaced, of which the one that fewest passages have is its anchor.
WIDEST, PLACES = 32, 4
#: Passages and their bytes that are sent to every task at most; beyond either, trigrams find them.
MAX_PASSAGES, MAX_BYTES = 100_000, 32_000_000
#: Bytes of texts that are hashed at once.
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, widest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the window at each place), for widths of 1, 2, 4 and so on."""
    width, h = 1, (data.astype(np.uint64) + np.uint64(1)) * MIX
    while len(h) and width <= widest:
        yield width, h
        left, right = h[:-width], h[width:]
        h, width = (left ^ (left >> np.uint64(29))) * MIX + right, 2 * width


class Anchors:
    """Passages (case, bytes), none empty, by the hashes of their anchors."""

    def __init__(self, cases: np.ndarray, texts: list[bytes]) -> None:
        self.cases, self.texts = cases, texts
        self.width = np.array([min(WIDEST, 1 << (len(t).bit_length() - 1)) for t in texts], np.int64)
        found: list[tuple[int, int, int, int]] = []  # width, hash, passage, place
        for i, t in enumerate(texts):
            w = int(self.width[i])
            h = next(h for width, h in windows(np.frombuffer(t, np.uint8), w) if width == w)
            found += [(w, int(h[at]), i, at) for at in sorted({(len(t) - w) * n // max(1, PLACES - 1) for n in range(PLACES)})]
        held: dict[tuple[int, int], set[int]] = {}
        for w, h, i, _ in found:
            held.setdefault((w, h), set()).add(i)
        best: dict[int, tuple[int, int, int, int]] = {}
        for w, h, i, at in found:
            best[i] = min(best.get(i, (len(texts) + 1, 0, 0, 0)), (len(held[w, h]), w, h, at))
        self.of: dict[tuple[int, int], list[tuple[int, int]]] = {}  # width, hash -> passage, place
        for i, (_, w, h, at) in best.items():
            self.of.setdefault((w, h), []).append((i, at))
        self.bits = max(16, len(self.of).bit_length() + 4)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # width -> hashes in order, which of their first bits there are
        for w in sorted({w for w, _ in self.of}):
            hashes = np.sort(np.array([h for width, h in self.of if width == w], np.uint64))
            some = np.zeros(1 << self.bits, bool)
            some[hashes >> np.uint64(64 - self.bits)] = True
            self.known[w] = hashes, some

    def held(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, case) of each passage that a row of ``data`` holds, once. ends: where the first row begins and where each ends."""
        done: set[tuple[int, int]] = set()
        first, last, shift = int(ends[0]), int(ends[-1]), np.uint64(64 - self.bits)
        for start in range(first, last, CHUNK):
            for width, h in windows(data[start : min(last, start + CHUNK + WIDEST - 1)], max(self.known, default=0)):
                if width not in self.known:
                    continue
                hashes, some = self.known[width]
                at = np.flatnonzero(some[h[:CHUNK] >> shift])
                at = at[hashes[np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)] == h[at]]
                rows = np.searchsorted(ends, at + start, "right") - 1
                for row, place, value in zip(rows.tolist(), (at + start).tolist(), h[at].tolist(), strict=True):
                    for i, offset in self.of[width, value]:
                        begin, text = place - offset, self.texts[i]
                        inside = ends[row] <= begin and begin + len(text) <= ends[row + 1]
                        if inside and (row, i) not in done and data[begin : begin + len(text)].tobytes() == text:
                            done.add((row, i))
                            yield row, int(self.cases[i])


def holding(units: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, case_id) of every unit (id, text) that holds a passage (case_id, query) as it stands.

    Ids and case_ids are distinct integers. An empty passage is held by every text; a null one by none. Up to MAX_PASSAGES
    and MAX_BYTES the passages go to the texts, which are read once and of which nothing is written; more are found by trigrams.
    """
    asked = passages.filter("case_id is not null and query is not null").select(F.col("case_id").cast("long"), F.col("query").cast("binary"))
    n, size = asked.limit(MAX_PASSAGES + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("query")), F.lit(0))).first()
    if n > MAX_PASSAGES or size > MAX_BYTES:
        return scratch(containing(build_trigrams(units), units, passages).select(F.col("id").cast("long"), F.col("case_id").cast("long")), "holds")
    rows = [(r.case_id, bytes(r.query)) for r in asked.collect()]
    to_all = np.array([case for case, text in rows if not text], np.int64)
    rows = [(case, text) for case, text in rows if text]
    anchors = Anchors(np.array([case for case, _ in rows], np.int64), [text for _, text in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary())
            if not len(texts):
                continue
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            pairs = np.array([*anchors.held(data, ends)], np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(ids[pairs[:, 0]], pa.int64()), pa.array(pairs[:, 1])], ["id", "case_id"])
            for case in to_all:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.zeros(len(ids), np.int64) + case)], ["id", "case_id"])

    read = units.filter("id is not null and text is not null").select(F.col("id").cast("long"), "text")
    return scratch(spread(read).select("id", F.col("text").cast("binary")).mapInArrow(run, "id long, case_id long"), "holds")
