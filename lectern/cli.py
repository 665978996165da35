"""Command line: retrieve, build, eval."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lectern.operators.corpus import Corpus, build
from lectern.operators.evaluate import score_cases
from lectern.operators.render import render_json, render_text
from lectern.operators.search import UNIT_WEIGHTS


def _retrieve(spark: SparkSession, args: argparse.Namespace) -> None:
    hits = Corpus.load(spark, args.db).search(args.query, args.k, args.principle, args.type)
    print(render_json(hits) if args.json else render_text(hits))


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    # imported here: searching needs neither extractors nor document readers
    from lectern.operators.enrich import RuleExtractor
    from lectern.operators.layout import elements_of
    from lectern.sources.chat import http_extractor
    from lectern.sources.config import load_profile, load_prompt, load_taxonomy
    from lectern.sources.pdf import read_pdf

    instance = Path(args.instance)
    profile = load_profile(instance / "profile.yaml")
    spans = read_pdf(spark, args.source) if args.source.endswith(".pdf") else spark.read.parquet(args.source)
    principles, topics = load_taxonomy(spark, instance / "taxonomy.yaml")
    extractor = http_extractor(args.model, args.endpoint) if args.model else RuleExtractor()
    build(
        elements_of(spans, profile), profile, principles, topics, load_prompt(instance / "prompt.md"), extractor, args.build_dir, args.db,
        args.chapter, args.resume, args.workers, say=print,
    )


def _eval(spark: SparkSession, args: argparse.Namespace) -> None:
    from lectern.sources.config import load_cases

    corpus = Corpus.load(spark, args.db)
    r = score_cases(corpus.index, corpus.units, load_cases(spark, args.cases), 5, list(UNIT_WEIGHTS.values())).first()
    print(f"hit_rate={r.hit_rate:.2f} over n={r.n}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lectern")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("retrieve", help="the best units for a query")
    p.add_argument("query")
    p.add_argument("--db", required=True)
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--principle", action="append")
    p.add_argument("--type", action="append")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=_retrieve)
    p = commands.add_parser("build", help="a corpus from a PDF or a table of spans")
    p.add_argument("source")
    p.add_argument("--instance", required=True, help="folder of profile.yaml, taxonomy.yaml and prompt.md")
    p.add_argument("--db", required=True)
    p.add_argument("--chapter")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--workers", type=int, help="calls in flight; without it, one for every partition")
    p.add_argument("--model", help="model of the chat endpoint; without it, rules give the metadata")
    p.add_argument("--endpoint", default="http://localhost:11434/api/chat")
    p.add_argument("--build-dir", default="build")
    p.set_defaults(run=_build)
    p = commands.add_parser("eval", help="hit rate over cases")
    p.add_argument("--db", required=True)
    p.add_argument("--cases", required=True)
    p.set_defaults(run=_eval)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
