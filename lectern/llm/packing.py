"""Packing documents into sequences of bounded length, by sums of squares.

Texts become token ids once. Only documents longer than a sequence are cut, so all their pieces but the
first fill a sequence; what is shorter is dealt into groups of bounded size, and each group is packed in
one task: longest pieces first, each into the open sequence whose choice leaves the sum over all gaps of
the squared number of open sequences with that gap smallest.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Stash, text_of
from lectern.llm.textbytes import CHUNK_BYTES, give_back, utf8

#: Pieces in a group on average. A group ends with a few sequences that aren't full: 2 in 1,000 at this size, by measurement.
GROUP_ROWS = 8192
#: Parts of text whose ids a worker remembers at most before the older half of what it knows goes (some 250 MB in all); they are encoded again then.
REMEMBERED = 1 << 19

# Where every byte-level splitter cuts, whatever stands around: before white space that follows something else, and between a
# Latin letter or digit and a mark. The first pattern finds parts by both, for texts whose white space is all in its class.
PARTS = re.compile(r"[ \n\r\t]*+[0-9A-Za-zÀ-ÖØ-öø-ɏ]++(?=[!-/:-@\[-`{-~])|[ \n\r\t]*+[^ \n\r\t]+|[ \n\r\t]+")
OTHER_SPACE = re.compile(r"[^\S \n\r\t]")
CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])")


class Encoder:
    """Token ids of texts as bytes (32 bits each, little-endian), by a byte-level tokenizer of the tokenizers library.

    A text is cut where the tokenizer itself always cuts, and parts that were seen before are not encoded
    again. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a byte-level token is a byte
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, parts: set[str]) -> None:
        """Encodes parts: those that begin with white space and don't end with it as one text, which is cut between them, the others alone."""
        together = [p for p in parts if p[0] in " \n\r\t" and not p[-1].isspace()]
        if together:
            ids = self._ids("".join(together))
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, together)), np.int64, len(together)))
            cuts = (4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            self.known.update(zip(together, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        for part in parts.difference(together):
            self.known[part] = self._ids(part).tobytes()

    def _encode(self, text: str) -> bytes:
        parts = CUT.split(text) if OTHER_SPACE.search(text) else PARTS.findall(text)
        found = list(map(self.known.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            fresh = {parts[i] for i in missing}
            self.known.update({p: self.older[p] for p in fresh if p in self.older})
            self._learn(fresh.difference(self.older))
            for i in missing:
                found[i] = self.known[parts[i]]
        return b"".join(found)

    def __call__(self, text: str) -> bytes:
        """The ids of a whole text, taken by slices that end at a cut."""
        if len(text) <= CHUNK_BYTES:
            return self._encode(text)
        out, lo = [], 0
        while lo < len(text):
            cut = CUT.search(text, lo + CHUNK_BYTES)
            hi = cut.start() if cut else len(text)
            out.append(self._encode(text[lo:hi]))
            lo = hi
        return b"".join(out)


def _encoder(path: str) -> Encoder:
    """This process's encoder: workers live on between tasks, and so does what they know."""
    kept = sys.modules.setdefault("lectern_encoders", types.ModuleType("lectern_encoders"))
    if path not in vars(kept):
        setattr(kept, path, Encoder(path))
    return getattr(kept, path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, ids (binary, 32 bits each) of every piece; a document's ids end with ``end_id``.

    The first piece has what is over when the document is cut into pieces of ``capacity``. Null and empty
    texts have the end alone; every row of ``docs`` is a document, repeated rows and null ids too.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, ids binary"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            offs, lo = utf8(text)[1], 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
                rows, pieces, starts, parts = [], [], [], []
                for row, x in enumerate(text.slice(lo, hi - lo).to_pylist(), lo):
                    data = encode(x or "") + end
                    n = len(data) // 4
                    at = [0, *range(n % capacity or capacity, n, capacity), n]
                    rows += [row] * (len(at) - 1)
                    pieces += range(len(at) - 1)
                    starts += at[:-1]
                    parts += [data[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch([ids.take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "piece", "start", "ids"])
                lo = hi
        give_back()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its place there. Lengths are placed from the longest down.

    Placing s into a bin of gap g takes the bin from N(g) to N(g - s), so the sum of squares changes by
    2 (N(g - s) - N(g)) + 2, or by 1 - 2 N(g) if it fills the bin. Of equal changes the smallest gap is taken; a
    new bin is opened if none has room.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, np.int64)  # N
    bins, places, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        gap = s + int(change.argmin())
        if count[gap]:
            bins[i] = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, bins[i], used = capacity, used, used + 1
        places[i] = capacity - gap
        if gap > s:
            open_bins[gap - s].append(int(bins[i]))
            count[gap - s] += 1
    return bins, places


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All documents (doc_id, text) in sequences of at most ``capacity`` tokens, in as few as it can; a row for each piece.

    doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset. A sequence is named by the number of its
    first piece. ``tokenizer``: the file of a byte-level tokenizer, readable on every executor. Pieces that are shorter than a sequence are
    dealt by their number into groups of ``group_rows`` on average, so no key can make a group large, and a
    task holds numbers only. See ``token_pieces`` for nulls and repeated rows; an empty table gives an empty
    result; other columns are ignored. A text's ids have to fit a task's memory.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("length", (F.octet_length("ids") / 4).cast("long"))
    pieces = Stash(pieces.withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()}), "pieces").df
    short = pieces.filter(F.col("length") < capacity).select("row", "length")
    groups = max(1, -(-short.count() // group_rows))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")  # the same packing whatever order the rows come in
        row, length = table.column("row").to_numpy(), table.column("length").to_numpy()
        bins, places = sum_of_squares(length, capacity)
        first = np.zeros(len(row), np.int64)
        first[bins[places == 0]] = row[places == 0]
        return pa.table([pa.array(row), pa.array(first[bins]), pa.array(places)], ["row", "sequence_id", "offset"])

    dealt = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    placed = dealt.groupBy("group").applyInArrow(pack, "row long, sequence_id long, offset long")
    whole = pieces.withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")}).filter(F.col("length") == capacity)
    both = pieces.filter(F.col("length") < capacity).join(placed, "row").unionByName(whole)
    return both.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids, starts (where its pieces begin) of every sequence of ``pack_documents``."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held")
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), held)
    ids = F.aggregate("held", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return whole.select("sequence_id", "length", ids.alias("ids"), F.col("held.offset").alias("starts"))
