"""Queries that run as streams over all that a table holds, and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators.lineage import made as made_at
from inkstone.sources import parse
from inkstone.streaming import ingest

from .base import query, table
from .documents import _plain, made


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """All rows of a table as a stream. The pattern, which nothing else fits, stands for its file or the files in its folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("""SELECT start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, sum(value * 100)::BIGINT AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that can no longer change; what is still open is not given yet."""
    cents = (F.col("value") * 100).cast("decimal(20,6)")
    events = _streamed(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", cents.alias("value"))
    folder = made_at(spark, "windows")
    rows = ingest.run_once(events, folder, lambda e: ingest.windows(e, "ts", "event_type", "6 hours", "1 hour"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total").cast("bigint").alias("total"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = (F.col("value") * 100).cast("decimal(20,6)")
    return _streamed(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", cents.alias("value"))


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 4 HOUR]) AS start FROM events)
SELECT start, event_type, count(*) AS n, sum(value * 100)::BIGINT AS total FROM w GROUP BY ALL HAVING start + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours, one each two; what can still change is not given yet."""
    rows = ingest.run_once(_events(spark, sf_dir), made_at(spark, "sliding"), lambda e: ingest.windows(e, "ts", "event_type", "6 hours", "1 hour", "2 hours"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total").cast("bigint").alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n, sum(value * 100)::BIGINT AS total FROM s GROUP BY user_id, nth
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each user's events that are less than twelve hours apart, once they are over."""
    rows = ingest.run_once(_events(spark, sf_dir), made_at(spark, "sessions"), lambda e: ingest.sessions(e, "ts", "user_id", "12 hours", "1 hour"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n", F.round("total").cast("bigint").alias("total"))


@query("SELECT doc_id, 'ok' AS status, len(string_split(CASE WHEN text LIKE '%_' || chr(10) THEN text[1:len(text) - 1] ELSE coalesce(text, '') END, chr(10)))::BIGINT AS paragraphs FROM documents")
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as rows of a stream, parsed in the stream."""
    folder = made_at(spark, "documents")

    def change(docs: DataFrame) -> DataFrame:
        return parse.parse(made(docs, _plain, "doc_id", ["text"]), "doc_id", relations=("paragraphs",)).select("doc_id", "status", F.size("paragraphs").cast("bigint").alias("paragraphs"))

    return ingest.run_once(_streamed(spark, sf_dir, "documents"), folder, change)
