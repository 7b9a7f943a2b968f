"""Queries through the binary format: tables become documents, documents are parsed, and SQL says what must be in them."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sinks import docx
from inkstone.sources import builder, parse

from .base import query, spread, table
from .text_model import PARAGRAPHS


def made(df: DataFrame, make: Callable[..., bytes], key: str, columns: list[str]) -> DataFrame:
    """``key, content``: a document of each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = zip(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([make(*r) for r in rows], pa.binary())], [key, "content"])

    return df.select(key, *columns).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, content binary")


def _story(text: str | None) -> str:
    return (text or "").replace("\n", "\r")


def _plain(text: str | None) -> bytes:
    return builder.document(_story(text))


def _locked(cipher: str) -> Callable[[str | None], bytes]:
    return lambda text: builder.document(_story(text), password="open sesame", cipher=cipher)


def parsed_documents(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    return parse.parse(made(table(spark, sf_dir, "documents"), _plain, "doc_id", ["text"]), "doc_id", relations=relations)


@query(f"WITH {PARAGRAPHS} SELECT doc_id, ix, p AS text FROM paras")
def doc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse.relation(parsed_documents(spark, sf_dir, "paragraphs"), "paragraphs", "doc_id")
    return p.select("doc_id", F.col("ix").cast("bigint").alias("ix"), "text")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS paragraphs, max(len(p)) AS longest FROM paras GROUP BY doc_id")
def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform("paragraphs", lambda p: F.length(p["text"]))
    return parsed_documents(spark, sf_dir, "paragraphs").select("doc_id", F.size("paragraphs").cast("bigint").alias("paragraphs"), F.array_max(sizes).cast("bigint").alias("longest"))


def _opened(cipher: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        locked = made(table(spark, sf_dir, "documents"), _locked(cipher), "doc_id", ["text"])
        found = parse.parse(locked, "doc_id", password="open sesame", relations=("paragraphs", "encrypted"))
        return found.select("doc_id", F.size("paragraphs").cast("bigint").alias("paragraphs"), F.md5(F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n")).alias("digest"), "encrypted")

    run.__name__ = f"doc_opened_{cipher}"
    return query(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS paragraphs, md5(string_agg(p, chr(10) ORDER BY ix)) AS digest, true AS encrypted FROM paras GROUP BY doc_id")(run)


doc_opened_xor, doc_opened_rc4, doc_opened_capi = (_opened(c) for c in ("xor", "rc4", "capi"))


@query("SELECT doc_id, 'failed' AS status, 'NeedsPassword' AS error_class FROM documents")
def doc_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    locked = made(table(spark, sf_dir, "documents"), _locked("xor"), "doc_id", ["text"])
    return parse.parse(locked, "doc_id", relations=()).select("doc_id", "status", "error_class")


def _chat(turns: list[dict]) -> bytes:
    """A conversation as a table: a row a turn, the role and the text in its cells."""
    cell, row = struct.pack("<HB", 0x2416, 1), struct.pack("<HBHB", 0x2416, 1, 0x2417, 1)
    text, runs, at = "", [], 0
    for t in turns:
        own = f"{t['role'] or ''}\x07{_story(t['text'])}\x07"
        n = len(own.encode("utf-16-le")) // 2
        runs += [(at, at + n, 0, cell), (at + n, at + n + 1, 0, row)]
        text += own + "\x07"
        at += n + 1
    return builder.document(text, para_runs=runs)


@query("SELECT conv_id, 1::BIGINT AS tables, count(*) AS table_rows, (2 * count(*))::BIGINT AS cells, sum(1 + len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS paragraphs FROM conversations GROUP BY conv_id")
def doc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    found = parse.parse(made(turns, _chat, "conv_id", ["turns"]), "conv_id", relations=("nodes",))
    of = lambda kind: F.size(F.filter("nodes", lambda n: n["kind"] == kind)).cast("bigint")
    return found.select("conv_id", of("table").alias("tables"), of("row").alias("table_rows"), of("cell").alias("cells"), of("paragraph").alias("paragraphs"))


def _linked(url: str | None, page: int | None) -> bytes:
    return builder.document(f'Page {page}: \x13 HYPERLINK "{url}" \x14here\x15 and \x13 DDE server \x14there\x15\r')


@query("""SELECT page_id, 'HYPERLINK' AS field_type, 'HYPERLINK "' || url || '"' AS instruction, true AS live, 'Page ' || page_id || ': here and there' AS text FROM pages
UNION ALL SELECT page_id, 'DDE', 'DDE server', false, 'Page ' || page_id || ': here and there' FROM pages""")
def doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages")).withColumn("page", F.col("page_id"))
    found = parse.parse(made(pages, _linked, "page_id", ["url", "page"]), "page_id", relations=("paragraphs", "fields"))
    each = found.select("page_id", F.element_at("paragraphs", 1)["text"].alias("text"), F.inline("fields"))
    return each.select("page_id", "field_type", "instruction", "live", "text")


def _formatted(name: str | None, brand: str | None, size: int | None) -> bytes:
    """A bold name, a brand of some size in a style based on another, and a bookmark on it."""
    a, b = len(name or ""), len(brand or "")
    sheet = builder.style_sheet([builder.style("Normal", chp=struct.pack("<HH", 0x4A43, 20)), builder.style("Brand", based_on=0, chp=struct.pack("<HB", 0x0836, 1))])
    names = builder.wide_strings([f"b{size}"])
    starts, ends = struct.pack("<iiHH", a + 1, a + b + 2, 0, 0), struct.pack("<ii", a + 1 + b, a + b + 2)
    return builder.document(
        f"{name or ''}\r{brand or ''}\r",
        char_runs=[(0, a, struct.pack("<HB", 0x0835, 1)), (a + 1, a + 1 + b, struct.pack("<HH", 0x4A43, size or 1))],
        para_runs=[(0, a + 1, 0, b""), (a + 1, a + b + 2, 1, b"")],
        tables={"styles": sheet, "bookmark_names": names, "bookmark_starts": starts, "bookmark_ends": ends},
    )


@query("""SELECT p_partkey, 0 AS paragraph, p_name AS text, true AS bold, false AS italic, 20 AS half_points, NULL::VARCHAR AS bookmark FROM part
UNION ALL SELECT p_partkey, 1, p_brand, false, true, CASE WHEN p_size < 2 THEN 20 ELSE p_size END, 'b' || p_size FROM part""")
def doc_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.parse(made(spread(table(spark, sf_dir, "part")), _formatted, "p_partkey", ["p_name", "p_brand", "p_size"]), "p_partkey", relations=("bookmarks", "inlines"))
    each = found.select("p_partkey", F.element_at("bookmarks", 1).alias("mark"), F.inline("inlines"))
    on = lambda k: F.coalesce(F.col("props")[k] == "true", F.lit(False))
    return each.select(
        "p_partkey", "paragraph", "text", on("bold").alias("bold"), on("italic").alias("italic"), F.col("props")["size_half_points"].cast("int").alias("half_points"),
        F.when((F.col("mark.cp_start") <= F.col("cp")) & (F.col("cp") < F.col("mark.cp_end")), F.col("mark.name")).alias("bookmark"),
    )


def _noted(name: str | None, comment: str | None) -> bytes:
    text, note = f"{name or ''}\x02\r", f"\x02{comment or ''}\r"
    n = len(name or "")
    return builder.document(text, stories={"footnotes": note + "\r"}, char_runs=[(n, n + 1, struct.pack("<HB", 0x0855, 1))], tables={"footnote_refs": struct.pack("<iiH", n, n + 2, 1), "footnote_texts": struct.pack("<iii", 0, len(note), len(note) + 1)}, summary={"title": name or ""})


@query("SELECT n_nationkey, n_name AS text, n_regionkey::VARCHAR AS note, n_name AS title FROM nation")
def doc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("note", F.col("n_regionkey").cast("string"))
    found = parse.parse(made(nations, _noted, "n_nationkey", ["n_name", "note"]), "n_nationkey", relations=("paragraphs", "notes", "core_properties"))
    return found.select("n_nationkey", F.element_at("paragraphs", 1)["text"].alias("text"), F.element_at("notes", 1)["text"].alias("note"), F.col("core_properties")["title"].alias("title"))


@query("SELECT count(*) AS file_count, count(*) AS succeeded, 0::BIGINT AS failed, 0::BIGINT AS warning_count FROM documents")
def doc_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.batch_summary(parsed_documents(spark, sf_dir, "stats"))


def _torn(text: str | None, doc_id: int | None) -> bytes:
    """Every document in one of three states: whole, without its signature, or cut short."""
    whole = _plain(text)
    return (whole, b"\0" + whole[1:], whole[:700])[(doc_id or 0) % 3]


@query("SELECT coalesce(error_class, 'none') AS error_class, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 1 THEN 'NotCompound' WHEN 2 THEN 'CorruptCompound' END AS error_class FROM documents) GROUP BY ALL")
def doc_error_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("nth", F.col("doc_id"))
    found = parse.parse(made(docs, _torn, "doc_id", ["text", "nth"]), "doc_id", relations=())
    return found.groupBy(F.coalesce("error_class", F.lit("none")).alias("error_class")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n, true AS sound FROM (WITH " + PARAGRAPHS.strip() + " SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id)")
def doc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made_ = docx.converted(made(table(spark, sf_dir, "documents"), _plain, "doc_id", ["text"]), "doc_id", checked=True)

    @F.arrow_udf("bigint")
    def paragraphs(files: pa.Array) -> pa.Array:
        return pa.array([len(docx.text_of(f)) for f in files.to_pylist()], pa.int64())

    return made_.select("doc_id", paragraphs("docx").alias("n"), F.col("fault").isNull().alias("sound"))
