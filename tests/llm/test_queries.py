"""The registered queries as they are: against their SQL, or for their columns and contracts."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from lectern.llm.queries import QUERIES
from lectern.llm.sql import ORACLE

from .conftest import words_of
from .test_texts import SECRETS, rules

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_hmm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_quality_lines": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_minimax_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_mix_sources": "doc_id size source_size target taken",
    "op11_pack_sequences": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    assert set(df.columns) == set(want.columns)
    order = sorted(df.columns)
    got = Counter(tuple(r[c] for c in order) for r in df.collect())
    assert got == Counter(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def test_columns(spark, texts):
    assert set(QUERIES) == set(ORACLE) | set(COLUMNS)
    for name, columns in COLUMNS.items():
        df = QUERIES[name](spark, SF)
        assert set(columns.split()) <= set(df.columns)
        assert sorted(r.doc_id for r in (df.filter("piece = 0") if "piece" in df.columns else df).select("doc_id").collect()) == sorted(texts)


def test_quality_query(spark, texts):
    for r in QUERIES["op3_quality_lines"](spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_shard_query(spark, texts):
    slots = defaultdict(list)
    for r in QUERIES["op4_minimax_shards"](spark, SF).collect():
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes") and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix_query(spark, texts):
    for r in QUERIES["op6_mix_sources"](spark, SF).collect():
        assert r["size"] == len(words_of(texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]


def test_secret_query(spark, tmp_path):
    rows = list(enumerate([*SECRETS, None, ""]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op10_secret_scan"](spark, str(tmp_path)).collect():
        base = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert Counter(s.split(":")[0] for s in base) == Counter(assign=r.n_assign, access=r.n_access, hex=r.n_hex) - Counter()
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    """Every query on tables without rows: no rows, but for the conversation that op9 adds."""
    for table in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (name == "op9_format_chats")
