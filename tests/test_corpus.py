"""Enrichment, corpus life cycle, command line, streaming."""

import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.operators import enrich as en
from lectern.operators.corpus import UNIT_COLUMNS, Corpus, build
from lectern.operators.evaluate import CASES, score_cases
from lectern.operators.index import Index, compact_index
from lectern.operators.layout import ELEMENTS, SPANS, Profile
from lectern.operators.search import UNIT_WEIGHTS
from lectern.sources import checkpoints
from lectern.sources.chat import ChatExtractor
from lectern.sources.checkpoints import COLUMNS, _write, read_checkpoint, start_anew, write_checkpoint
from lectern.sources.config import load_cases, load_profile, load_prompt, load_taxonomy
from lectern.operators.living_index import LivingIndex
from lectern.streaming.incremental import PENDING, enrich_stream, index_stream, upsert_stream

PAYLOAD = {"principle": "made up", "type": "definition", "context_line": "about depth", "applies_when": "shallow classes", "key_terms": ["deep", "module"], "questions": ["why?"]}
PROFILE_YAML = 'section_re: (\\d+\\.\\d+)\nchapter_re: Chapter\\s+(\\d+)\nappendices: {sum: [9, 9]}\n'
TAXONOMY = """
principles:
  - {slug: deep-modules, name: Deep, vocabulary: [interface, depth], diagnostics: [], red_flags: [shallow]}
topics:
  - {chapter: 1, title: One, principle: deep-modules}
  - {chapter: 1, title: Again, principle: other}
  - {chapter: 2, title: Two, principle: null}
"""
ROWS = [("heading", "Chapter 1", 1, 1), ("para", "deep modules {section} hide", 1, 0), ("code", "x = {}", 1, 0), ("heading", "1.1 More", 2, 2), ("para", "same", 2, 0), ("code", "y", 2, 0), ("para", "same", 3, 0), ("heading", "Chapter 2", 4, 1), ("para", "second", 4, 0), ("heading", "Back", 8, 1), ("para", "gone", 8, 0), ("para", "summary of depth", 9, 0)]


class Flaky:
    """Fails on passages with a word."""

    model = "flaky"

    def __init__(self, word):
        self.word = word

    def extract(self, prompt, schema, *, system=None):
        if self.word in prompt.split("PASSAGE:")[1]:
            raise RuntimeError("no answer")
        return dict(PAYLOAD)


@pytest.fixture(scope="module")
def instance(tmp_path_factory):
    d = tmp_path_factory.mktemp("instance")
    (d / "profile.yaml").write_text(PROFILE_YAML)
    (d / "taxonomy.yaml").write_text(TAXONOMY)
    (d / "prompt.md").write_text("<!-- SYSTEM -->\nBe brief.\n\n<!-- TEMPLATE -->\nCARD {card}\nIN {section}\nPASSAGE: {passage}\n")
    (d / "cases.yaml").write_text("cases:\n  - {query: what hides, expect_principle: deep-modules}\n  - {query: summary, expect_section: '1.1'}\n")
    return d


def test_build_and_resume(spark, instance, tmp_path, capsys):
    elements = spark.createDataFrame([(1, i, *r) for i, r in enumerate(ROWS)], ELEMENTS)
    principles, topics = load_taxonomy(spark, instance / "taxonomy.yaml")
    make = lambda extractor, **o: build(elements, load_profile(instance / "profile.yaml"), principles, topics, load_prompt(instance / "prompt.md"), extractor, str(tmp_path / "ck"), str(tmp_path / "db"), **o)
    en_retry = Flaky("second")
    report = {r.chapter: (r.units, r.failed) for r in make(en_retry, workers=2).collect()}
    # the two equal paras of section 1.1 are one row
    assert report == {"1": (4, 0), "2": (1, 1), "sum": (1, 0), None: (6, 1)}
    units = spark.read.parquet(str(tmp_path / "db/units")).orderBy("id").collect()
    assert [(r.id, r.text, r.section, r.page, r.type, r.principle, r.needs_enrich) for r in units] == [
        (1, "deep modules {section} hide", "1", 1, "definition", "deep-modules", 0), (2, "x = {}", "1", 1, "code", "deep-modules", 0),
        (3, "same", "1.1", 3, "definition", "deep-modules", 0), (4, "y", "1.1", 2, "code", "deep-modules", 0),
        (5, "second", "2", 4, "rationale", "", 1), (6, "summary of depth", "sum", 9, "definition", "", 0),
    ]
    report = {r.chapter: (r.units, r.failed) for r in make(en.StubExtractor(PAYLOAD), resume=True).collect()}
    assert report[None] == (6, 0)
    rows = read_checkpoint(spark, str(tmp_path / "ck"))
    assert rows.count() == 8 and rows.filter("attempt = 1").count() == 1
    corpus = Corpus.load(spark, str(tmp_path / "db"))
    assert [f.name for f in corpus.units.schema] == [c.split()[0] for c in UNIT_COLUMNS.split(", ")]
    assert corpus.search("hide", 1).first().id == 1
    assert {r.type for r in corpus.search("deep", 5, types=["code"]).collect()} == {"code"}
    assert ("all", "", 6) in {tuple(r) for r in corpus.audit().collect()}
    cases = load_cases(spark, instance / "cases.yaml")
    assert score_cases(corpus.index, corpus.units, cases, 1, list(UNIT_WEIGHTS.values())).first().hit_rate == 0.5
    assert score_cases(corpus.index, corpus.units, spark.createDataFrame([], CASES)).first() == (0.0, 0)

    cli.main(["retrieve", "hide", "--db", str(tmp_path / "db"), "-k", "1"])
    assert capsys.readouterr().out.startswith("[deep-modules §1 p.1] (definition)\ndeep modules {section} hide\n")
    cli.main(["retrieve", "deep modules", "--db", str(tmp_path / "db"), "--json", "-k", "2", "--type", "code"])
    hits = json.loads(capsys.readouterr().out)
    assert [h["type"] for h in hits] == ["code", "code"] and list(hits[0])[:2] == ["score", "id"]
    cli.main(["retrieve", "zz", "--db", str(tmp_path / "db")])
    assert capsys.readouterr().out == "(no matches)\n"
    cli.main(["eval", "--db", str(tmp_path / "db"), "--cases", str(instance / "cases.yaml")])
    assert capsys.readouterr().out == "hit_rate=0.50 over n=2\n"
    with pytest.raises(ValueError):
        make(en.StubExtractor(PAYLOAD), chapter="77")


def test_key_prompt_and_size(spark):
    df = spark.createDataFrame([("1.1", False, "a {b}"), ("1.1", True, "é")], "s string, c boolean, t string")
    keys = [r[0] for r in df.select(en.unit_key(F.col("s"), F.col("c"), F.col("t"))).collect()]
    assert keys == [hashlib.sha1(f"1.1|{c}|{t}".encode()).hexdigest()[:12] for c, t in ((False, "a {b}"), (True, "é"))]
    text = "{{x}} {card}-{section}-{passage}-{card}"
    got = [r[0] for r in df.select(en.render_prompt(text, F.lit("{section}"), F.col("s"), F.col("t"))).collect()]
    assert got == [text.format(card="{section}", section="1.1", passage=t) for t in ("a {b}", "é")]
    with pytest.raises(ValueError):
        en.render_prompt("{other}", F.lit(""), F.lit(""), F.lit(""))
    sizes = [en.context_size(spark.createDataFrame([("x" * n,)] if n else [], "prompt string"), "").first() for n in (0, 200_000, 30_000)]
    assert [s.num_ctx for s in sizes] == [8192, 32768, 12048]
    assert sizes[1].over_cap


def test_last_wins_and_types(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, n int, v string")
    assert sorted((r.k, r.v, r.position) for r in en.last_wins(df, ["k"], "n").collect()) == [("a", "z", 1), ("b", "y", 2)]
    bad = spark.createDataFrame([("code",), ("poem",)], "t string")
    with pytest.raises(Exception, match="not a unit type"):
        bad.select(en.checked_type(F.col("t"))).collect()


def test_unknown_principle_is_an_error(spark):
    cards = spark.createDataFrame([("a", "card a")], "slug string, card string")
    rows = spark.createDataFrame([("a",), ("",), (None,)], "principle string")
    assert sorted(r.card for r in en.with_cards(rows, cards).collect()) == ["", "", "card a"]
    with pytest.raises(Exception, match="no such principle"):
        en.with_cards(spark.createDataFrame([("b",)], "principle string"), cards).collect()


def test_streams(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    row = lambda k, t: (1, k, k, t, "1", "1.1", 1, False, f"PASSAGE:{t}", 1)
    for i, (rows, extractor) in enumerate([([row("a", "fine"), row("b", "broken")], Flaky("broken")), ([row("b", "broken"), row("a", "fine"), row("c", "new")], en.StubExtractor(PAYLOAD))]):
        extractor.retries = 0
        spark.createDataFrame(rows, PENDING).coalesce(1).write.mode("append").parquet(src)
        enrich_stream(spark, src, ck, str(tmp_path / "state"), extractor).awaitTermination(120)
    got = sorted((r.key, r.attempt, r.needs_enrich) for r in read_checkpoint(spark, ck).collect())
    assert got == [("a", 0, 0), ("b", 0, 1), ("b", 1, 0), ("c", 1, 0)]
    units = str(tmp_path / "units")
    for i, text in enumerate(["deep module", "shallow modules"]):
        spark.createDataFrame([(i, text)], "id long, text string").write.mode("append").parquet(units)
        index_stream(spark, units, "id long, text string", ["text"], str(tmp_path / "ix"), str(tmp_path / "ixstate")).awaitTermination(120)
    terms = spark.read.parquet(str(tmp_path / "ix/postings")).select("term", "id").collect()
    assert sorted(map(tuple, terms)) == [("deep", 0), ("modul", 0), ("modul", 1), ("shallow", 1)]
    compact_index(spark, str(tmp_path / "ix"), str(tmp_path / "one"), ["text"], True)
    whole = Index.load(spark, str(tmp_path / "one"), ["text"], True)
    assert sorted((r.term, r.id, r.dl) for r in whole.postings.collect()) == [("deep", 0, 2), ("modul", 0, 2), ("modul", 1, 2), ("shallow", 1, 2)] and whole.size == (2, 2.0)


def test_checkpoint_batches_are_whole_or_not_there(spark, tmp_path):
    """Files without a manifest aren't read, a name is written once, and chapters that start anew leave the others."""
    path = str(tmp_path / "ck")
    empty = dict.fromkeys(COLUMNS)
    row = lambda key, chapter, attempt: tuple({**empty, "doc_id": 1, "key": key, "text": f"{key}\n", "chapter": chapter, "attempt": attempt}[c] for c in COLUMNS)
    rows = lambda *r: spark.createDataFrame(list(r), checkpoints.ROWS)
    read = lambda: sorted((r.key, r.chapter, r.attempt) for r in read_checkpoint(spark, path).collect())
    assert read() == []
    start_anew(rows(row("a", "1", 0)), path)
    write_checkpoint(rows(row("a", "1", 0), row("b", "2", 0)), path, "0-0")
    _write(rows(row("lost", "1", 0)), path)
    write_checkpoint(rows(row("twin", "1", 0)), path, "0-0")
    write_checkpoint(rows(row("c", "2", 1)), path)
    assert read() == [("a", "1", 0), ("b", "2", 0), ("c", "2", 1)]
    start_anew(rows(row("x", "2", 0)), path)
    assert read() == [("a", "1", 0)]
    write_checkpoint(rows(row("d", "2", 2)), path, "0-0")
    assert read() == [("a", "1", 0), ("d", "2", 2)]
    start_anew(rows(row("x", "2", 0), row("x", "1", 0)), path)
    assert read() == []


def test_units_that_change_in_a_stream(spark, tmp_path):
    src, index = str(tmp_path / "in"), LivingIndex(spark, str(tmp_path / "ix"), ["text"])
    for rows in ([(1, 1, "deep module"), (2, 1, "shallow"), (1, 2, "deeper modules")], [(2, 3, "wide"), (3, 1, "new")]):
        spark.createDataFrame(rows, "id long, version int, text string").coalesce(1).write.mode("append").parquet(src)
        upsert_stream(spark, src, "id long, version int, text string", index, str(tmp_path / "state")).awaitTermination(120)
    assert sorted((r.term, r.id) for r in index.index().postings.collect()) == [("deeper", 1), ("modul", 1), ("new", 3), ("wide", 2)]
    assert index.index().size == (3, 4 / 3)


class Malformed:
    """Answers without a field, of an unknown type, or no object at all."""

    model = "malformed"

    def extract(self, prompt, schema, *, system=None):
        answers = {"one": {k: v for k, v in PAYLOAD.items() if k != "questions"}, "two": {**PAYLOAD, "type": "poem"}, "three": [1], "four": {**PAYLOAD, "key_terms": "deep"}}
        return answers.get(prompt, {**PAYLOAD, "more": 1})


def test_malformed_answers_are_failed_calls(spark):
    df = spark.createDataFrame([(p, False) for p in ("one", "two", "three", "four", "fine")] + [("two", True)], "prompt string, is_code boolean").withColumn("text", F.col("prompt"))
    got = {(r.text, r.type): (r.needs_enrich, list(r.key_terms)) for r in en.enrich(df, Malformed(), retries=1, back_off=0.0).collect()}
    failed = {(p, "rationale"): (1, []) for p in ("one", "two", "three", "four")}
    assert got == {**failed, ("two", "code"): (1, []), ("fine", "definition"): (0, ["deep", "module"])}


def test_back_off_doubles(monkeypatch):
    waits = []
    monkeypatch.setattr(en.time, "sleep", waits.append)
    assert en.enrich_one(Malformed(), "two", False, retries=3)["needs_enrich"] == 1
    assert waits == [1.0, 2.0, 4.0]


class Breaks(Flaky):
    """Takes the whole job down on passages with a word."""

    def extract(self, prompt, schema, *, system=None):
        if self.word in prompt.split("PASSAGE:")[1]:
            raise SystemExit(1)
        return dict(PAYLOAD)


def test_two_documents_and_a_build_that_breaks_off(spark, instance, tmp_path):
    """Equal units of two documents stay apart, in order; what was saved before a break isn't asked for again."""
    rows = [(d, i, *r) for d in (2, 1) for i, r in enumerate(ROWS)]
    elements = spark.createDataFrame(rows, ELEMENTS)
    principles, topics = load_taxonomy(spark, instance / "taxonomy.yaml")
    lines = []
    make = lambda extractor, **o: build(elements, load_profile(instance / "profile.yaml"), principles, topics, load_prompt(instance / "prompt.md"), extractor, str(tmp_path / "ck"), str(tmp_path / "db"), save_every=2, say=lines.append, **o)
    with pytest.raises(Exception):
        make(Breaks("summary"))
    saved = {(r.doc_id, r.digest) for r in read_checkpoint(spark, str(tmp_path / "ck")).collect()}
    assert 0 < len(saved) < 12
    report = {r.chapter: (r.units, r.failed) for r in make(Flaky("nothing"), resume=True).collect()}
    assert report == {"1": (8, 0), "2": (2, 0), "sum": (2, 0), None: (12, 0)}
    again = [(r.doc_id, r.digest) for r in read_checkpoint(spark, str(tmp_path / "ck")).filter("attempt > 0").collect()]
    assert not saved & set(again)
    units = spark.read.parquet(str(tmp_path / "db/units")).orderBy("id").collect()
    assert [r.id for r in units] == list(range(1, 13)) and [r.doc_id for r in units] == [1] * 6 + [2] * 6
    assert {(r.doc_id, r.text) for r in units} == {(d, t) for d in (1, 2) for t in ("deep modules {section} hide", "x = {}", "same", "y", "second", "summary of depth")}
    assert "chapters=6 units=14 num_ctx=8192 model=flaky" in lines and any(x.startswith("built 12 units (0 failed)") for x in lines)


def test_a_resumed_build_has_the_order_of_a_straight_one(spark, instance, tmp_path):
    """Ids, texts and chapters of a build that broke off twice, with a unit in each batch, and of one that didn't: two documents, with appendices."""
    rows = [(d, i, *r) for d in (2, 1) for i, r in enumerate([*ROWS, *(("para", f"more of it {j}", 9, 0) for j in range(3))])]
    rows += [(d, 100 + i, "para" if i % 2 else "heading", f"text {d} {i}" if i % 2 else f"1.{i} Title", 9, 0 if i % 2 else 2) for d in (1, 2) for i in range(8)]
    elements = spark.createDataFrame(rows, ELEMENTS)
    principles, topics = load_taxonomy(spark, instance / "taxonomy.yaml")

    def make(name, extractor, **o):
        build(elements, load_profile(instance / "profile.yaml"), principles, topics, load_prompt(instance / "prompt.md"), extractor, str(tmp_path / name / "ck"), str(tmp_path / name / "db"), save_every=3, **o)

    def units(name):
        return [tuple(r) for r in spark.read.parquet(str(tmp_path / name / "db/units")).orderBy("id").collect()]

    make("straight", en.StubExtractor(PAYLOAD))
    for word in ("text 2 5", "more of it 2"):
        with pytest.raises(Exception):
            make("broken", Breaks(word), resume=True)
    saved = read_checkpoint(spark, str(tmp_path / "broken/ck")).count()
    assert 0 < saved < len(units("straight"))
    extractor = en.StubExtractor(PAYLOAD)
    make("broken", extractor, resume=True)
    plain = lambda rows: [(*r[:11], *r[12:]) for r in rows]  # without enrich_model
    assert plain(units("broken")) == plain(units("straight"))


class FakeChat:
    """Honours one way of asking."""

    asked = []

    def __init__(self, way, model, num_ctx):
        self.way = way

    def ask(self, messages, schema, way):
        FakeChat.asked.append(way)
        if way != self.way:
            raise RuntimeError("unsupported")
        return {**PAYLOAD, "context_line": messages[0]["content"]}


def test_chat_extractor_finds_and_keeps_its_way():
    import functools
    import pickle

    FakeChat.asked.clear()
    extractor = ChatExtractor("m", functools.partial(FakeChat, "function_calling"))
    assert extractor.extract("p", en.SCHEMA, system="s")["context_line"] == "s"
    extractor.extract("p", en.SCHEMA)
    sent = pickle.loads(pickle.dumps(extractor))
    sent.extract("p", en.SCHEMA)
    assert FakeChat.asked == ["json_schema", "function_calling", "function_calling", "function_calling"]
    assert en.validated(sent.extract("q", en.SCHEMA))["context_line"] == "q"
    with pytest.raises(ValueError, match="gave no answer"):
        ChatExtractor("m", functools.partial(FakeChat, "neither")).extract("p", en.SCHEMA)
    assert isinstance(extractor, en.Extractor)


class WrongTypes(FakeChat):
    """Answers either way, with all fields, but one of a wrong type by its first."""

    def ask(self, messages, schema, way):
        FakeChat.asked.append(way)
        return PAYLOAD if way == self.way else {**PAYLOAD, "key_terms": "a string"}


def test_a_way_is_kept_for_valid_answers_only(spark):
    import functools

    FakeChat.asked.clear()
    extractor = ChatExtractor("m", functools.partial(WrongTypes, "function_calling"))
    assert extractor.extract("p", en.SCHEMA) == PAYLOAD and extractor.way == "function_calling"
    df = spark.createDataFrame([("p", False), ("q", False)], "prompt string, is_code boolean")
    fresh = ChatExtractor("m", functools.partial(WrongTypes, "function_calling"))
    assert [r.needs_enrich for r in en.enrich(df, fresh, retries=0).collect()] == [0, 0]
    with pytest.raises(ValueError, match="key_terms"):
        ChatExtractor("m", functools.partial(WrongTypes, "neither")).extract("p", en.SCHEMA)


def test_build_from_the_command_line_asks_the_endpoint(spark, instance, tmp_path, capsys):
    """Spans of a Parquet table, a model behind HTTP that answers by a tool call alone, and the lines of the report."""
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert body["model"] == "tiny" and body["options"]["num_ctx"] == 8192 and body["messages"][0] == {"role": "system", "content": "Be brief."}
            call = [{"function": {"name": "answer", "arguments": PAYLOAD}}]
            answer = json.dumps({"message": {"content": "no idea", "tool_calls": call if "tools" in body else []}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    d = tmp_path / "instance"
    d.mkdir()
    (d / "profile.yaml").write_text("code_font: Mono\nhead_font: Head\nchapter_size: 20.0\nsection_re: (\\d+\\.\\d+)\nchapter_re: Chapter\\s+(\\d+)\n")
    for name in ("taxonomy.yaml", "prompt.md"):
        (d / name).write_text((instance / name).read_text())
    spans = [(1, 1, i, 0, 0, 0, 0.0, 0.0, 1.0, 1.0, t, font, size) for i, (t, font, size) in enumerate([("Chapter 1", "Head", 22.0), ("deep text", "Serif", 10.0), ("x = 1", "Mono", 10.0)])]
    spark.createDataFrame(spans, SPANS).write.parquet(str(tmp_path / "spans"))
    try:
        cli.main(["build", str(tmp_path / "spans"), "--instance", str(d), "--db", str(tmp_path / "db"), "--build-dir", str(tmp_path / "ck"), "--model", "tiny", "--endpoint", f"http://127.0.0.1:{server.server_port}/api/chat", "--workers", "2"])
    finally:
        server.shutdown()
    assert capsys.readouterr().out.splitlines() == ["chapters=1 units=2 num_ctx=8192 model=tiny", "  1: 2 units (0 failed) principle=deep-modules", f"built 2 units (0 failed) -> {tmp_path / 'db'}"]
    assert {(r.text, r.type, r.enrich_model) for r in Corpus.load(spark, str(tmp_path / "db")).units.collect()} == {("deep text", "definition", "tiny"), ("x = 1", "code", "tiny")}
    with pytest.raises(SystemExit):
        cli.main([])


def test_search_path_needs_no_readers():
    code = "import sys; import lectern.cli; bad = [m for m in ('fitz', 'lectern.sources.pdf', 'lectern.llm') if m in sys.modules]; sys.exit(bool(bad))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0
