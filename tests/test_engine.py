"""Queries against SQL, the parse stage and its sinks in Spark, edge rows of the interval operators."""

import os
import re
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkstone.operators import intervals as I
from inkstone.operators import relations as R
from inkstone.plans import base, catalogue
from inkstone.sinks import docx
from inkstone.sources import builder, parse
from inkstone.streaming import ingest

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_no_query_takes_a_part_of_its_tables():
    for name, sql in catalogue.ORACLE_SQL.items():
        assert name == "top_docs_by_warnings" or not re.search(r"\bLIMIT\b|SAMPLE", sql), name


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("docs")
    (at / "sub").mkdir()
    (at / "a.DOC").write_bytes(builder.document("one\rtwo\r"))
    (at / "sub" / "b.doc").write_bytes(builder.document("three\r"))
    (at / "sub" / "B.doc").write_bytes(builder.document("again\r"))
    (at / "~$a.doc").write_bytes(b"owner")
    (at / "bad.doc").write_bytes(b"not a document")
    (at / "c.txt").write_bytes(b"text")
    return at


def test_files_parse_summary_inspect(spark, folder):
    found = parse.files(spark, f"file://{folder}")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == ["B.doc", "a.DOC", "b.doc", "bad.doc"]
    parsed = parse.parse(found)
    assert parse.batch_summary(parsed).first().asDict() == {"file_count": 4, "succeeded": 3, "failed": 1, "warning_count": 0}
    assert '"paragraph_count":2' in parse.inspect(parsed).filter(F.col("path").endswith("a.DOC")).first().report
    assert found.filter(parse.looks_compound(F.col("content"))).count() == 3


def test_packages_and_collisions(spark, folder, tmp_path):
    parsed = parse.parse(parse.files(spark, f"file://{folder}"))
    made = docx.packages(parsed)
    done = {r.path.rsplit("/", 1)[1]: r for r in docx.write_files(made, str(tmp_path)).collect()}
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix == ".docx") in (["a.docx", "b.docx"], ["B.docx", "a.docx"])
    assert sum(r.error is not None for r in done.values()) == 1
    assert docx.text_of((tmp_path / "a.docx").read_bytes()) == ["one", "two"]
    assert docx.fault(b"no zip") and docx.fault((tmp_path / "a.docx").read_bytes()) is None
    assert docx.package(parse.parse_document(builder.document("x\r"))) == docx.package(parse.parse_document(builder.document("x\r")))


def test_ingest_stream_isolates_failures_and_reads_files_once(spark, folder, tmp_path):
    target, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    for _ in range(2):
        ingest.ingest(ingest.arriving(spark, f"file://{folder}"), target, state).awaitTermination()
    assert spark.read.parquet(f"{target}/documents").count() == 4
    assert [r.error_class for r in spark.read.parquet(f"{target}/errors").collect()] == ["NotCompound"]


def test_coalesce_gaps_empty_and_equal_neighbours(spark):
    spans = spark.createDataFrame([(1, 0, 2, "a"), (1, 2, 5, "a"), (1, 5, 5, "b"), (1, 6, 8, "a"), (1, 8, 9, None), (1, 9, 10, None)], "k int, cp_start int, cp_end int, v string")
    assert sorted((r.cp_start, r.cp_end, r.v) for r in I.coalesce(spans, ["k"], ["v"]).collect()) == [(0, 5, "a"), (6, 8, "a"), (8, 10, None)]


def test_bucketed_overlap_equals_the_plain_join(spark):
    a = spark.range(40).select((F.col("id") * 7 % 90).alias("s")).withColumn("e", F.col("s") + F.col("s") % 23)
    b = spark.range(30).select((F.col("id") * 11 % 95).alias("x")).withColumn("y", F.col("x") + F.col("x") % 17)
    got = sorted(map(tuple, I.bucketed_overlap(a, b, ("s", "e"), ("x", "y"), 10).select("s", "e", "x", "y", "cp_start", "cp_end").collect()))
    pairs = [(r.s, r.e, q.x, q.y, max(r.s, q.x), min(r.e, q.y)) for r in a.collect() for q in b.collect() if max(r.s, q.x) < min(r.e, q.y)]
    assert got == sorted(pairs)


def test_chain_missing_parents_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "r", None), (2, 1, None, "x"), (3, 2, "t", None), (4, 99, None, "o"), (5, 6, "c", "c"), (6, 5, "c", "c"), (7, 5, "u", None)], "id int, up int, a string, b string")
    got = {r.id: (r.depth, r.a, r.b) for r in R.chain(spark, nodes, "id", "up", ["a", "b"]).collect()}
    assert got == {1: (0, "r", None), 2: (1, "r", "x"), 3: (2, "t", "x"), 4: (0, None, "o")}


def test_entry_has_a_stable_schema(spark):
    df = catalogue.entry(spark, SF)
    assert df.columns == ["doc_id", "paragraphs", "longest"] and df.count() == 200


def test_command_line(spark, folder, tmp_path, capsys):
    from inkstone.__main__ import main, password_of

    assert main(["batch", f"file://{folder}", str(tmp_path)], spark) == 1  # one file is no document
    assert '"succeeded": 1' in capsys.readouterr().out and (tmp_path / "a.docx").exists()
    assert main(["batch", f"file://{folder}"], spark) == 2 and main(["batch", f"file://{folder}", str(tmp_path), "--password-file", "/no/such"], spark) == 2
    assert main(["batch", f"file://{folder}", str(tmp_path), "--report", str(tmp_path / "a.docx")], spark) == 2  # not over a package
    capsys.readouterr()
    assert main(["inspect", "-r", f"file://{folder}/sub"], spark) == 0
    assert "format version: 0x00c1" in capsys.readouterr().out
    secret = tmp_path / "secret"
    secret.write_bytes("pass wörd\r\n".encode())
    assert password_of(str(secret)) == "pass wörd"
    secret.write_bytes(b"x" * 5000)
    with pytest.raises(ValueError, match="too large"):
        password_of(str(secret))


def against(spark, name, folder):
    """The rows of a query over the tables in a folder, and those of its SQL."""
    c = duckdb.connect()
    for p in folder.iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = catalogue.QUERIES[name](spark, str(folder))
    want = c.sql(f"SELECT {', '.join(f'\"{c}\"' for c in df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    return sorted(map(str, map(tuple, df.collect()))), sorted(map(str, want))


def wrote(folder, table, *, name=None, **columns):
    (folder / name if name else folder).mkdir(exist_ok=True)
    pq.write_table(pa.table(columns), folder / (f"{name}/{table}.parquet" if name else f"{table}.parquet"))


def test_tab_stops_beyond_the_reach_of_a_position(spark, tmp_path):
    wrote(tmp_path, "part", p_partkey=[0, 5, 29_999, 30_000, 31_768, 60_000, 1_200_003, 7_200_001, 30_000**2, 2**40 + 1], p_size=pa.array([1] * 10, pa.int32()))
    got, want = against(spark, "doc_tabs", tmp_path)
    assert got == want


def test_documents_of_any_size_lose_no_allocation_table(spark, tmp_path):
    sizes = [57_000 + 512 * k for k in range(4)] + [122_000 + 512 * k for k in range(12)]  # tables that are full or nearly so
    wrote(tmp_path, "documents", doc_id=[2 * k + 1 for k in range(len(sizes))] + [2, 4], text=["x" * n for n in sizes] + ["x" * 57_500, None])
    got, want = against(spark, "doc_inspect", tmp_path)
    assert got == want


@pytest.mark.parametrize("name", ["stream_documents", "stream_windows", "stream_sessions"])
def test_streams_of_tables_of_several_files(spark, tmp_path, name):
    for k in range(2):
        wrote(tmp_path, f"part-{k}", name="documents.parquet", doc_id=[2 * k, 2 * k + 1], text=["a\nb", "c"])
        at = pa.array([datetime(2024, 1, 1) + timedelta(hours=9 * j) for j in range(6 * k, 6 * k + 6)], pa.timestamp("us"))
        wrote(tmp_path, f"part-{k}", name="events.parquet", ts=at, user_id=[1, 2] * 3, event_type=["x", "y"] * 3, value=[1.5] * 6)
    got, want = against(spark, name, tmp_path)
    assert got and got == want


@pytest.mark.parametrize("name", ["doc_bookmarks", "doc_images", "doc_media", "doc_textboxes", "doc_comments", "doc_endnotes", "doc_headers", "doc_unsafe_links"])
def test_packages_are_of_their_own_row(spark, tmp_path, name):
    """A document is read and packaged in one pass, so that rows with equal keys do not meet each other."""
    wrote(tmp_path, "part", p_partkey=[1, 1, 2, 2], p_name=["a b", "c", "d", "e f"], p_size=pa.array([1, 2, 3, 3], pa.int32()))
    wrote(tmp_path, "customer", c_custkey=[1, 1, 2], c_name=["a", "bc", "d"], c_mktsegment=["x", "y", "z"])
    wrote(tmp_path, "pages", page_id=[1, 1, 2, 2], url=["http://a/", "http://b/"] * 2)
    got, want = against(spark, name, tmp_path)
    assert got == want
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["doc_lists", "doc_formatting", "doc_properties", "doc_comments"])
def test_documents_of_small_rows_are_dealt_by_number(spark, tmp_path, name):
    n = 2 * base.MADE + 1
    keys = list(range(n))
    wrote(tmp_path, "part", p_partkey=keys, p_name=["n"] * n, p_brand=["b"] * n, p_size=pa.array([1] * n, pa.int32()))
    wrote(tmp_path, "customer", c_custkey=keys, c_name=["n"] * n, c_mktsegment=["m"] * n)
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    each = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(each) >= 3 and max(each) < 2 * sum(each) / len(each)


def test_tasks_by_key_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(base, "ROWS", 100)
    n = 1000
    wrote(tmp_path, "lineitem", l_orderkey=[k // 4 for k in range(n)], l_linenumber=pa.array([k % 4 for k in range(n)], pa.int32()), l_returnflag=["R" if k % 3 else "N" for k in range(n)], l_suppkey=list(range(n)), l_partkey=list(range(n)), l_shipdate=list(range(n)))
    got, want = against(spark, "cell_overrides", tmp_path)
    assert got == want
    df = catalogue.QUERIES["cell_overrides"](spark, str(tmp_path))
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 6  # of ten
