"""PDF files as spans. Needs a PDF library, which is looked for only where a file is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lectern.operators.layout import SPANS

FIELDS = [c.split()[0] for c in SPANS.split(", ")]


def spans_of_page(doc_id: int, page_no: int, page: dict) -> Iterator[tuple]:
    """Rows of a page given as nested blocks, lines and spans; image blocks give one row."""
    for b, block in enumerate(page["blocks"]):
        box = [float(x) for x in block["bbox"]]
        if block["type"] == 1:
            yield (doc_id, page_no, b, 0, 0, 1, *box, None, None, None)
            continue
        for i, line in enumerate(block["lines"]):
            for s, span in enumerate(line["spans"]):
                yield (doc_id, page_no, b, i, s, int(block["type"]), *box, span["text"], span["font"], float(span["size"]))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF needs PyMuPDF on the executors; spans can be given as a table instead") from e
    for pdf in batches:
        for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
            with fitz.open(stream=content, filetype="pdf") as doc:
                for i, page in enumerate(doc):
                    yield pd.DataFrame(list(spans_of_page(doc_id, i + 1, page.get_text("dict"))), columns=FIELDS)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Spans of all PDF files under ``path``; doc_id is a hash of the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.selectExpr("xxhash64(path) AS doc_id", "content").mapInPandas(_parse, SPANS)
