"""Operator 5, benchmark decontamination: suffix arrays of the training texts, searched for every suffix of every test
item.

A task cuts its texts into shards of about ``SHARD_BYTES`` and sorts all suffixes of a shard that begin at a word, by
prefix doubling as deep as the longest test item. Every test suffix is then binary-searched in the shard; where its
longest match is long enough, all places of the suffix array that share that much are read off, and each match is
extended to its full length. Shards are independent: no training text is shuffled, and each task maps the test items
from files in the shared folder, so nothing is broadcast either.

Defined results: words are compared, without case and punctuation, and matches do not cross documents. A match is
reported if it cannot be extended on either side and has at least ``min_words`` words, or is a whole item of fewer,
however short. Null and empty texts and items have no words and match nothing. Matches in
documents without an id are reported with a null id, and the stage removes no row for them; items without an id are
reported with a null id. A repeated row or item gives its matches once (the result is distinct). Empty tables give an
empty result, and the stage then keeps everything. Very long texts are shards of their own, sorted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import existing, fresh, put

MIN_WORDS = 10
SHARD_BYTES = 8 << 20
SCHEMA = "doc_id bigint, item_id bigint, item_start int, doc_start int, length int"
_FIELDS = ("doc_id", "item_id", "item_start", "doc_start", "length")


class Items:
    """Words of the test items in files of the shared folder, one of each task that had some."""

    def __init__(self, paths: list[str], min_words: int) -> None:
        self.paths, self.min_words = paths, min_words

    @classmethod
    def write(cls, benchmark: DataFrame, min_words: int = MIN_WORDS) -> Items:
        """A file is named after what it holds, so that a second attempt at a task writes the same one."""
        folder = fresh(benchmark.sparkSession, "items")

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches, "text"):
                w = T.words(batch.column("text"))
                ids, sizes = batch.column("item_id"), np.diff(w.bounds)
                number, known = np.asarray(ids.fill_null(0), dtype=np.int64), np.asarray(ids.is_valid()).astype(np.int64)
                if not sizes.any():
                    continue
                data = np.concatenate([np.array([len(ids)], np.int64), sizes, number, known, w.hashes.view(np.int64)]).tobytes()
                path = f"{folder}/{xxhash.xxh128_hexdigest(data)}"
                put(path, data)
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        slim = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
        return cls(sorted(r["path"] for r in slim.mapInArrow(save, "path string").collect()), min_words)

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, bounds of the items, their ids and whether those are known; only items that have words."""
        parts = [[np.zeros(0, np.int64)] * 4]
        for path in self.paths:
            raw = existing(path).view(np.int64)
            n = int(raw[0])
            parts.append([raw[1 : n + 1], raw[n + 1 : 2 * n + 1], raw[2 * n + 1 : 3 * n + 1], raw[3 * n + 1 :]])
        sizes, ids, known, hashes = (np.concatenate(c) for c in zip(*parts))
        use = sizes > 0
        return hashes.view(np.uint64), np.concatenate([[0], np.cumsum(sizes[use])]).astype(np.int64), ids[use], known[use] > 0


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ranks`` (non-negative; 0 ends a document) whose rank is not 0, ordered by their first ``depth``
    ranks at least."""
    n, base = len(ranks), int(ranks.max(initial=0)) + 1
    width = max(1, min(depth, int(63 // max(1, np.log2(base + 1)))))
    padded = np.concatenate([ranks, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key * base + padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    group[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    reach = width
    while reach < depth:
        size = np.diff(np.append(heads, n))
        tied = heads[size > 1]
        if not len(tied):
            break
        count = size[size > 1]
        at = np.repeat(tied - (np.cumsum(count) - count), count) + np.arange(count.sum())  # places in ``order``
        where = order[at]
        follow = np.where(where + reach < n, group[np.minimum(where + reach, n - 1)], -1)
        again = np.lexsort((follow, group[where]))
        where, follow = where[again], follow[again]
        order[at] = where
        fresh_ = np.ones(len(at), bool)
        fresh_[1:] = (group[where[1:]] != group[where[:-1]]) | (follow[1:] != follow[:-1])
        starts = np.flatnonzero(fresh_)
        group[where] = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
        new[at] = fresh_
        heads = np.flatnonzero(new)
        reach *= 2
    return order[ranks[order] > 0]


def common(text: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of text[at:] and test[start:], at most ``most``."""
    n = np.zeros(len(at), np.int64)
    live = np.flatnonzero((most > 0) & (at < len(text)))
    k = 0
    while len(live):
        live = live[text[at[live] + k] == test[start[live] + k]]
        k += 1
        n[live] = k
        live = live[(most[live] > k) & (at[live] + k < len(text))]
    return n


def below(text: np.ndarray, sa: np.ndarray, test: np.ndarray, start: np.ndarray, most: np.ndarray, equal_is_below: bool) -> np.ndarray:
    """For each test suffix, cut to ``most`` words, how many suffixes of the array are less than it."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        at, s, m = sa[mid], start[live], most[live]
        n = common(text, at, test, s, m)
        end = n == m
        mine = text[np.minimum(at + n, len(text) - 1)]
        less = np.where(end, equal_is_below, np.where(at + n >= len(text), True, mine < test[np.minimum(s + n, len(test) - 1)]))
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    return lo


def matches(hashes: np.ndarray, bounds: np.ndarray, tests: np.ndarray, test_bounds: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """All maximal matches between the documents of a shard and the test items, by row of each."""
    size, test_size = np.diff(bounds), np.diff(test_bounds)
    none = {k: np.zeros(0, np.int64) for k in ("doc", "item", "item_start", "doc_start", "length", "longest")}
    if not len(hashes) or not len(tests):
        return none
    vocabulary, rank = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(len(size)), size)
    text = np.zeros(len(hashes) + len(size), np.int64)  # a 0 after each document
    text[np.arange(len(hashes)) + doc] = rank + 1
    found = np.minimum(np.searchsorted(vocabulary, tests), len(vocabulary) - 1)
    # A test word that the shard lacks ends any match; it sorts after all that the shard has.
    test = np.where(vocabulary[found] == tests, found + 1, len(vocabulary) + 1)
    sa = suffix_array(text, int(test_size.max()))
    item = np.repeat(np.arange(len(test_size)), test_size)
    start = np.arange(len(tests))
    left = test_bounds[1:][item] - start
    p = below(text, sa, test, start, left, False)
    longest = np.maximum(
        np.where(p > 0, common(text, sa[np.maximum(p - 1, 0)], test, start, left), 0),
        np.where(p < len(sa), common(text, sa[np.minimum(p, len(sa) - 1)], test, start, left), 0),
    )
    need = np.minimum(min_words, test_size)[item]
    use = np.flatnonzero(longest >= need)
    if not len(use):
        return none
    start, need, left = start[use], need[use], left[use]
    first, last = below(text, sa, test, start, need, False), below(text, sa, test, start, need, True)
    count = last - first
    which = np.repeat(np.arange(len(use)), count)
    at = sa[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    length = common(text, at, test, start[which], left[which])
    inner = (start[which] > test_bounds[:-1][item[use][which]]) & (at > 0)
    inner[inner] = text[at[inner] - 1] == test[start[which][inner] - 1]
    keep = ~inner
    which, at, length = which[keep], at[keep], length[keep]
    begins = bounds[:-1] + np.arange(len(size))
    owner = np.searchsorted(begins, at, side="right") - 1
    return {
        "doc": owner,
        "item": item[use][which],
        "item_start": start[which] - test_bounds[:-1][item[use][which]],
        "doc_start": at - begins[owner],
        "length": length,
        "longest": longest[use][which],
    }


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, item_start, doc_start, length`` (in words) of every maximal verbatim match; see the module."""
    items = Items.write(benchmark, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, test_bounds, item_ids, item_known = items.read()
        for batch in T.slices(batches, "text", SHARD_BYTES):
            w = T.words(batch.column("text"))
            m = matches(w.hashes, w.bounds, tests, test_bounds, min_words)
            if not len(m["doc"]):
                continue
            arrays = [
                batch.column("doc_id").take(pa.array(m["doc"])),
                pa.array(item_ids[m["item"]], mask=~item_known[m["item"]]),
                *(pa.array(m[k].astype(np.int32)) for k in _FIELDS[2:]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, list(_FIELDS))

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA).distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without those that hold a match, with all their columns."""
    items = Items.write(benchmark, min_words)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        tests, test_bounds, _, _ = items.read()
        out = []
        for piece in T.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", SHARD_BYTES):
            w = T.words(piece.column("text"))
            ok = np.ones(piece.num_rows, bool)
            ok[matches(w.hashes, w.bounds, tests, test_bounds, min_words)["doc"]] = False
            out.append(ok)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(clean(F.col("text").cast("string")))


def op5_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '(?:[0-9a-z]|[^\x00-\x7F])+')"
OP5_SQL = f"""
WITH items AS (SELECT DISTINCT item_id, {WORDS} AS w FROM benchmark),
used AS (SELECT item_id, w, least({MIN_WORDS}, len(w)) AS k FROM items WHERE len(w) > 0),
docs AS (SELECT DISTINCT doc_id, {WORDS} AS w FROM documents),
test AS (SELECT item_id, k, i - 1 AS item_start, list_aggregate(list_slice(w, i, i + k - 1), 'string_agg', ' ') AS gram
         FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM used)),
train AS (SELECT doc_id, k, i - 1 AS doc_start, list_aggregate(list_slice(w, i, i + k - 1), 'string_agg', ' ') AS gram
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM used) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, item_id, k, item_start, doc_start FROM test JOIN train USING (k, gram)),
runs AS (SELECT *, doc_start - row_number() OVER (PARTITION BY doc_id, item_id, doc_start - item_start ORDER BY doc_start) AS island FROM hits)
SELECT doc_id, item_id, min(item_start)::INT AS item_start, min(doc_start)::INT AS doc_start, (count(*) + any_value(k) - 1)::INT AS length
FROM runs GROUP BY doc_id, item_id, doc_start - item_start, island
"""
