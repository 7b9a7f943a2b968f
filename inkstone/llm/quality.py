"""Operator 4, quality rules: the log-likelihood ratio of hashed n-grams under two multinomials, trusted target against
raw corpus, per n-gram, held against a fixed threshold.

Features are single units and pairs of neighbours among words and runs of punctuation, hashed into ``BUCKETS``; a pair
of equal units is one feature whatever the unit, so that stutter is seen in any language. Both multinomials are counted
over whole tables, with few enough buckets that a small corpus fills them: every document counts as raw, every document that ``labels`` trusts counts as target also. A
partition adds up its own histogram, so the shuffle takes one row a bucket and partition, and the model that goes to the
tasks has a fixed size. The ids of trusted documents are looked up in mapped files; the corpus is never shuffled.

Defined results: a document is trusted if it has a label and its lowest ``quality`` is 1; null labels and null ids
trust nothing. A null or empty text has no n-grams and scores 0. Without trusted documents every score is 0. Repeated
rows are counted and scored each; a score of exactly the threshold is kept. Other columns of the input pass through the
stage as they are and do not matter to the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import KeySet

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Mean log-likelihood ratio a feature, in nats, under which a document is rejected.
THRESHOLD = -0.25
_SHIFT = T.U64(32)


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, and where each text's begin: its units, then its pairs."""
    w = T.word_puncts(texts)
    pairs = T.mix(w.hashes[:-1] * T._C1 + w.hashes[1:])
    pairs[w.hashes[:-1] == w.hashes[1:]] = T.U64(1)
    size = np.diff(w.bounds)
    n_pairs = np.maximum(size - 1, 0)
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + n_pairs, out=out[1:])
    values = np.zeros(out[-1], np.int64)
    single = (T.mix(w.hashes) >> _SHIFT).astype(np.int64) % buckets
    double = (T.mix(pairs + T._C2) >> _SHIFT).astype(np.int64) % buckets
    owner = np.repeat(np.arange(len(size)), size)
    values[np.arange(len(single)) - w.bounds[owner] + out[owner]] = single
    owner = np.repeat(np.arange(len(size)), n_pairs)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs)
    values[out[owner] + size[owner] + rank] = double[w.bounds[owner] + rank]
    return values, out


def ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) of every bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + smoothing) / (target.sum() + smoothing * len(raw))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p / q)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """The ratio of every bucket, from all of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``."""
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    keys = KeySet.write(trusted, "trusted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in T.slices(batches, "text"):
            values, bounds = features(batch.column("text"), buckets)
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            is_target = known & keys.holds(np.asarray(ids.fill_null(0), dtype=np.int64))
            counts[0] += np.bincount(values, minlength=buckets)
            counts[1] += np.bincount(values[np.repeat(is_target, np.diff(bounds))], minlength=buckets)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = slim.mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = total["bucket"].to_numpy()
    raw[at], target[at] = total["raw"].to_numpy(), total["target"].to_numpy()
    return ratios(target, raw, smoothing)


def scorer(spark: SparkSession, model: np.ndarray):  # noqa: ANN201
    """A column function: the mean ratio of a text's features, rounded to 6 places."""
    sent = spark.sparkContext.broadcast(model.astype(np.float64))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for piece in T.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text"):
            values, bounds = features(piece.column("text"), len(sent.value))
            sums = np.zeros(len(values) + 1)
            np.cumsum(sent.value[values], out=sums[1:])
            n = np.diff(bounds)
            out.append(np.round((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), 6) + 0.0)
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, score, keep`` of every row of ``docs``; see the module."""
    score = scorer(docs.sparkSession, fit(docs, labels, buckets))
    return docs.select("doc_id", score(F.col("text").cast("string")).alias("score")).withColumn("keep", F.col("score") >= threshold)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
