"""python -m inkstone convert|inspect|batch SOURCE [TARGET]: exit 0 if all was read, 1 if some was not, 2 for misuse."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkstone import api
from inkstone.sinks import report
from inkstone.sources import parse

MAX_PASSWORD = 4096


def password_of(file: str | None) -> str | None:
    """The first 4096 bytes hold it, or the file is no password; one line end is not part of it."""
    if file is None:
        return None
    with open(file, "rb") as f:
        raw = f.read(MAX_PASSWORD + 1)
    if len(raw) > MAX_PASSWORD:
        raise ValueError("the password file is too large")
    return raw.decode().rstrip("\r\n")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    cli = argparse.ArgumentParser("inkstone", description=__doc__)
    cli.add_argument("what", choices=("convert", "inspect", "batch"))
    cli.add_argument("source")
    cli.add_argument("target", nargs="?")
    cli.add_argument("-r", "--recursive", action="store_true")
    cli.add_argument("--password-file")
    cli.add_argument("--report", help="a JSON file of the whole batch")
    cli.add_argument("--json", action="store_true", help="inspect as JSON, not as text")
    try:
        said = cli.parse_args(args)
        if said.what != "inspect" and not said.target:
            cli.error("a target is needed")
        password = password_of(said.password_file)
    except SystemExit as e:
        return int(e.code or 0)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    if said.what == "inspect":
        wanted = ("version", "language", "encrypted", "entries", "stories", "stats")
        parsed = parse.parse(parse.files(spark, said.source, said.recursive), password=password, relations=wanted)
        failed = 0
        for row in parse.inspect(parsed).withColumn("place", report.order_of(F.col("path"), said.source)).orderBy("place").toLocalIterator():
            failed += json.loads(row.report)["status"] != "ok"
            print(row.path, row.report if said.json else "\n" + report.as_text(json.loads(row.report)))
        return int(failed > 0)
    try:
        rows = api.convert_folder(spark, said.source, said.target, said.recursive, password, said.report)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    for row in rows.filter("status = 'failed'").toLocalIterator():
        print(row.input, row.error_class, row.error, file=sys.stderr)
    totals = report.summary(rows)
    if said.what == "batch":
        print(json.dumps(totals))
    return int(totals["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
