"""The extraction operator: files in, definition, import and reference rows out, in one Arrow-batched pass."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import braces, python, ruby
from .model import Positions

SCHEMA = (
    "file_path string, language string, status string, message string, kind string, type string, name string, fqn string, scope string, import_path string, alias string, receiver string, "
    "type_hint string, bases string, mixins string, start_byte long, end_byte long, start_line int, end_line int, start_col int, end_col int, ordinal int"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in SCHEMA.split(", ")]

BATCH_ROWS = 4096  # rows after which a batch is closed; the file that reaches it stays whole


def parse_text(path: str, language: str, text: str) -> list[tuple]:
    """Rows of one file; a file that can't be parsed gives one row with status ``error``."""
    try:
        items = list(python.extract(text) if language == "Python" else ruby.extract(text) if language == "Ruby" else braces.extract(text, language))
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, language, "error", f"{type(e).__name__}: {e}"[:500], *[None] * (len(_NAMES) - 4))]
    at = Positions(text)
    out = [(path, language, "ok", None, "file", None, None, None, None, None, None, None, None, None, None, 0, at.byte(len(text)), 0, len(at.lines) - 1, 0, 0, 0)]
    for i, x in enumerate(items):
        (l1, c1), (l2, c2) = at.at(x.start), at.at(x.end)
        hint = x.extra.get("type") or x.extra.get("returns") or ""
        out.append((path, language, "ok", None, x.kind, x.type, x.name, x.fqn, x.scope, x.path, x.alias, x.receiver, hint, x.extra.get("bases", ""), x.extra.get("mixins", ""), at.byte(x.start), at.byte(x.end), l1, l2, c1, c2, i + 1))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def extract(files: DataFrame) -> DataFrame:
    """Rows for files (path, language, text); pass only those with status ``ok`` of the source."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                rows += parse_text(*(batch.column(c)[i].as_py() for c in range(3)))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return files.where(F.col("text").isNotNull() & F.col("language").isNotNull()).select("path", "language", "text").mapInArrow(run, SCHEMA)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def summary(rows: DataFrame) -> DataFrame:
    """Files, failures and items by language."""
    return rows.groupBy("language").agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("status") == "error").alias("errors"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("definition", "import", "reference")],
    )


def write_stats(rows: DataFrame, path: str) -> None:
    """The summary, a few rows, as indented JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict() for r in summary(rows).collect()], f, indent=2)
