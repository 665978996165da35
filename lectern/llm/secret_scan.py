"""Secrets in texts: fixed rules, and two character Markov models for what the rules don't name.

A first-order chain over characters is trained on random strings, another on ordinary identifiers.
Tokens of the texts whose log-likelihood ratio is high are secrets too; the rules' matches are cut out
of a token, and what is left is judged piece by piece.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import text_of

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: What the chains look at, and their alphabet.
TOKEN = r"[A-Za-z0-9+/_=-]+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1  # and the border of the token

MIN_TOKEN = 20
#: nats: in total, and for each character
MIN_RATIO, MIN_RATE = 15.0, 1.0
SAMPLE_ROWS = 3000
MADE_STRINGS = 3000
BACK_OFF = 5.0


class Rules:
    """The fixed rules: leftmost non-overlapping matches of each kind, those that fail its length dropped."""

    def __init__(self):
        # ASCII: letters in either case, but no other character that folds to one
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX[:-1] + "{32,}")

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points, sorted."""
        out = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= 16]
        out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(out)

    def values(self, text: str) -> list[str]:
        """The secrets themselves, without the names they are assigned to."""
        found = [m[2] for m in self.assign.finditer(text) if len(m[2]) >= 8]
        return found + [text[s:e] for s, kind, e in self.spans(text) if kind]


def _codes() -> np.ndarray:
    table = np.zeros(128, np.int64)
    table[[ord(c) for c in ALPHABET]] = np.arange(1, N)
    return table


def transitions(tokens: list[str]) -> np.ndarray:
    """Counts (from, to) of neighbouring characters, with the border at both ends."""
    if not tokens:
        return np.zeros((N, N), np.int64)
    raw = np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode("ascii"), np.uint8)
    x = _codes()[raw]
    return np.bincount(x[:-1] * N + x[1:], minlength=N * N).reshape(N, N)


def made_strings(n: int, seed: int = 5) -> list[str]:
    """Labelled random samples: hexadecimal, base-64 and alphanumeric strings."""
    rng = np.random.default_rng(seed)
    kinds = ["0123456789abcdef", ALPHABET[:62] + "+/", ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62]]
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), size=int(rng.integers(20, 64)))) for i in range(n)]


def _sample_counts():
    def run(batches):
        rules, token = Rules(), re.compile(TOKEN)
        counts = np.zeros((2, N, N), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for value in rules.values(text):
                    counts[0] += transitions(token.findall(value))
                spans, ordinary, at = rules.spans(text), [], 0
                for s, _, e in [*spans, (len(text), 0, len(text))]:
                    if s > at:
                        ordinary += [t for t in token.findall(text[at:s]) if len(t) < MIN_TOKEN]
                    at = max(at, e)
                counts[1] += transitions(ordinary)
        kind, i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(i), pa.array(j), pa.array(counts[kind, i, j])], ["kind", "i", "j", "n"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-likelihood ratios (from, to): random over ordinary.

    Labelled by the rules on ``sample_rows`` documents of least hash: their matches are random, other
    tokens too short to be judged are ordinary; ``MADE_STRINGS`` generated strings are random too. Transitions back off to
    the characters' own frequencies, with the weight of ``BACK_OFF`` counts; those get one half added.
    """
    hashed = docs.select(F.xxhash64(id_col, text_col).alias("h"), text_of(text_col).alias("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    sample = hashed.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h"]) if last is not None else hashed
    found = sample.select("text").mapInArrow(_sample_counts(), "kind long, i long, j long, n long").groupBy("kind", "i", "j").agg(F.sum("n")).collect()
    counts = np.zeros((2, N, N))
    for kind, i, j, n in found:  # at most 2 x N x N rows
        counts[kind, i, j] = n
    counts[0] += transitions(made_strings(MADE_STRINGS))
    alone = counts.sum(axis=1, keepdims=True) + 0.5
    alone /= alone.sum(axis=2, keepdims=True)
    p = (counts + BACK_OFF * alone) / (counts.sum(axis=2, keepdims=True) + BACK_OFF)
    return np.log(p[0]) - np.log(p[1])


class Scanner:
    def __init__(self, ratios: np.ndarray):
        self.rules, self.token = Rules(), re.compile(TOKEN[:-1] + f"{{{MIN_TOKEN},}}")
        self.ratios, self.codes = ratios, _codes()

    def ratio(self, token: str) -> float:
        x = self.codes[np.frombuffer(f"\0{token}\0".encode("ascii"), np.uint8)]
        return float(self.ratios[x[:-1], x[1:]].sum())

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """All spans (start, kind, end); those of the chains overlap no rule's match."""
        base = self.rules.spans(text)
        out, i, covered = list(base), 0, 0
        for m in self.token.finditer(text):
            s, end = m.span()
            # spans and tokens both go by their start, so each span is passed once
            while i < len(base) and base[i][0] < end:
                self._judge(text, max(s, covered), min(base[i][0], end), out)
                covered, i = max(covered, base[i][2]), i + 1
            self._judge(text, max(s, covered), end, out)
        return sorted(out)

    def _judge(self, text: str, s: int, e: int, out: list[tuple[int, int, int]]) -> None:
        if e - s >= MIN_TOKEN:
            ratio = self.ratio(text[s:e])
            if ratio >= MIN_RATIO and ratio >= MIN_RATE * (e - s):
                out.append((s, 3, e))


def _scan(ratios: np.ndarray):
    def run(batches):
        scanner = Scanner(ratios)
        for batch in batches:
            counts, digests, all_spans = [], [], []
            for text in batch.column(1).to_pylist():
                spans = scanner.scan(text)
                told = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
                counts.append([sum(k == i for _, k, _ in spans) for i in range(3)])
                digests.append(hashlib.sha256(",".join(t for t, x in zip(told, spans, strict=True) if x[1] < 3).encode()).hexdigest())
                all_spans.append(",".join(told))
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    spans: kind:start:end in code points, end exclusive, by start and kind (assign, access, hex, then markov
    for what the chains add). Null texts are empty; repeated rows get the same result; an empty table gives an
    empty one. Texts of any length are scanned whole, in time in proportion to their length. Other columns,
    whatever their names, are ignored.
    """
    ratios = train(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scan(ratios), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
