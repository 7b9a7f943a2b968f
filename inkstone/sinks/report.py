"""Reports: a JSON file that appears whole or not at all, the summary of a batch, and text for people."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(path: str, pieces: Iterable[str]) -> None:
    """Writes the pieces of a JSON text beside ``path`` and puts them in its place once they are on disk."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(prefix=".", suffix=".part", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            for piece in pieces:
                f.write(piece)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def order_of(path: Column, root: str) -> Column:
    """A file's place in a batch: its path below the folder, in one case."""
    below = F.regexp_replace(path, "^.*?" + "/" + _quoted(root.rstrip("/").rpartition("/")[2]) + "/", "")
    return F.lower(below)


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in text)


def results(parsed: DataFrame, written: DataFrame | None, root: str, key: str = "path") -> DataFrame:
    """A row a document, in the order of the batch: input, output, status, error, warnings and statistics."""
    own = parsed.select(key, "status", "error_class", "error_message", "stats", "diagnostics")
    if written is not None:
        own = own.join(written.select(key, F.col("target").alias("output"), F.col("error").alias("write_error")), key, "left")
    else:
        own = own.withColumn("output", F.lit(None).cast("string")).withColumn("write_error", F.lit(None).cast("string"))
    failed = (F.col("status") != "ok") | F.col("write_error").isNotNull()
    return own.select(
        F.col(key).alias("input"), F.when(~failed, F.col("output")).alias("output"), F.when(failed, "failed").otherwise("succeeded").alias("status"), F.coalesce("error_class", F.when(failed, "NotWritten")).alias("error_class"),
        F.coalesce("error_message", "write_error").alias("error"), F.coalesce(F.col("stats")["warning_count"], F.lit(0)).alias("warning_count"), "stats", "diagnostics", order_of(F.col(key), root).alias("place"),
    ).orderBy("place", "input")


def summary(rows: DataFrame) -> dict[str, int]:
    """Totals of a batch."""
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "succeeded").alias("ok"), F.sum("warning_count").alias("w")).first()
    return {"file_count": r["n"], "succeeded": r["ok"], "failed": r["n"] - r["ok"], "warning_count": r["w"] or 0}


def batch_json(rows: DataFrame, source: str, target: str, recursive: bool) -> Iterator[str]:
    """The report of a batch, a document at a time: the driver holds a partition of the results, not all of them."""
    head = {"input": source, "output": target, "recursive": recursive, **summary(rows)}
    yield json.dumps(head, ensure_ascii=False)[:-1] + ', "results": ['
    for k, row in enumerate(rows.drop("place").toLocalIterator()):
        yield (", " if k else "") + json.dumps(row.asDict(recursive=True), ensure_ascii=False)
    yield "]}"


def clashes(report: str, inputs: Iterable[str], outputs: Iterable[str]) -> bool:
    """Whether a report would take the place of a file that is read or written."""
    same = os.path.realpath(report)
    return any(os.path.realpath(p.removeprefix("file:")) == same for p in (*inputs, *outputs))


def as_text(report: dict) -> str:
    """What a document is, for people: its format, streams, stories and counts, a line each."""
    if report.get("status") != "ok":
        return f"{report.get('error_class')}: {report.get('error_message')}"
    lines = [f"format version: {report['version']:#06x}", f"language: {report.get('language') or 'none'}", f"encrypted: {'yes' if report['encrypted'] else 'no'}"]
    lines += [f"entry: {e['path']} ({e['kind']}, {e['size']} bytes)" for e in report.get("entries", [])]
    lines += [f"story: {s['story']} [{s['cp_start']}, {s['cp_end']})" for s in report.get("stories", [])]
    return "\n".join([*lines, *(f"{k}: {v}" for k, v in sorted(dict(report.get("stats", {})).items()) if v)])
