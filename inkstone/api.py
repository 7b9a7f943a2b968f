"""The engine's entry points: one document in memory, folders of documents, and functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sinks import docx, report
from inkstone.sources import parse


class Converted(NamedTuple):
    """A converted document: its package (none if it could not be read), what was found, and the model."""

    package: bytes | None
    report: dict
    document: dict


def _reported(model: dict) -> dict:
    return {k: model.get(k) for k in ("status", "error_class", "error_message", "version", "language", "encrypted", "entries", "stories", "stats", "diagnostics")}


def convert(data: bytes, password: str | None = None) -> Converted:
    """One document. What cannot be read gives no package and a report that says why."""
    model = parse.tried(data, password)
    made = docx.package(model) if model["status"] == "ok" else None
    return Converted(made, _reported(model) | {"fault": docx.fault(made) if made else None}, model)


def inspect(data: bytes, password: str | None = None) -> dict:
    """What a document is, without its text."""
    return _reported(parse.tried(data, password, frozenset(("version", "language", "encrypted", "entries", "stories", "stats", "diagnostics"))))


def convert_folder(spark: SparkSession, source: str, target: str, recursive: bool = True, password: str | None = None, report_file: str | None = None) -> DataFrame:
    """Converts all documents below ``source`` into ``target``, in the order of their paths, and gives a row a document: input,
    output, status, error, warnings, statistics. A bad document costs itself. ``report_file`` takes the whole as JSON; it
    may not be a document or a package."""
    from inkstone.operators.lineage import cut

    parsed = cut(parse.parse(parse.files(spark, source, recursive), password=password))
    written = cut(docx.write_files(docx.packages(parsed), target))
    rows = report.results(parsed, written, source)
    if report_file:
        near = rows.filter(F.element_at(F.split("input", "/"), -1) == report_file.rpartition("/")[2]).select("input").toLocalIterator()
        outputs = rows.filter(F.element_at(F.split("output", "/"), -1) == report_file.rpartition("/")[2]).select("output").toLocalIterator()
        if report.clashes(report_file, (r[0] for r in near), (r[0] for r in outputs)):
            raise ValueError("the report would take the place of a document")
        report.write_json(report_file, report.batch_json(rows, source, target, recursive))
    return rows


def register(spark: SparkSession) -> None:
    """Functions for SQL over a column of documents' bytes: ``parse_doc`` gives a row a paragraph (a table function),
    ``doc_text``, ``doc_status`` and ``doc_package`` a value a document. Values come in Arrow batches."""

    class Paragraphs:
        def eval(self, content: bytes) -> Iterator[tuple[str, int, int, str]]:
            model = parse.tried(content, None, frozenset(("paragraphs",)))
            for p in model.get("paragraphs", []):
                yield p["story"], p["ix"], p["style_id"], p["text"]

    @F.arrow_udf("string")
    def doc_text(files: pa.Array) -> pa.Array:
        models = (parse.tried(f, None, frozenset(("paragraphs",))) for f in files.to_pylist())
        return pa.array(["\n".join(p["text"] for p in m["paragraphs"] if p["story"] == "main") if m["status"] == "ok" else None for m in models], pa.string())

    @F.arrow_udf("string")
    def doc_status(files: pa.Array) -> pa.Array:
        models = (parse.tried(f, None, frozenset()) for f in files.to_pylist())
        return pa.array([m.get("error_class") or m["status"] for m in models], pa.string())

    @F.arrow_udf("binary")
    def doc_package(files: pa.Array) -> pa.Array:
        return pa.array([convert(f).package for f in files.to_pylist()], pa.binary())

    for f in (doc_text, doc_status, doc_package):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("parse_doc", F.udtf(Paragraphs, returnType="story string, ix int, style_id int, text string"))
