"""Operator 3, line dedup: an exact set-similarity self-join of all lines of the corpus; later matches are removed.

A line is a set of words. Words are ordered by rarity in the whole corpus; two lines whose Jaccard similarity is at
least ``THRESHOLD`` share a word among the rarest ``n - ceil(t n) + 1`` of each (prefix filter), have sizes within the
factor t (length filter), and have enough words left after the shared one (positional filter). Pairs that pass are
thinned by a 128-bit signature, whose differing bits bound the symmetric difference from below, and then verified on
the whole sets. All filters are exact: none loses a match.

1. Words are counted, map tasks first; counts of two and more go to sorted files in the shared folder.
2. Every line sends its prefix, packed by shard of the word. A line that an earlier one of the same slice equals as a
   set is removed there and sends nothing, so a line that is everywhere does not load one reducer.
3. Reducers turn each word's list into candidate pairs (earlier, later); equal sets need no verification.
4. The lines of candidates are read once more and each later line is verified against its nearest candidate, then, only
   if that fails, against all others: one match is enough.
5. Texts are rewritten by looking their removed lines up in mapped files. Texts themselves are never shuffled.

Defined results: a line is known by (doc_id, row, its number); it is removed if any line of a smaller one matches it,
whether or not that one is itself removed. ``row`` is 0 where no other row has the id, else a 64-bit hash of id and text:
rows that share an id are documents of their own, in the order of that hash, and rows that share id and text are one.
Lines end at a line feed. Lines without words match nothing and stay. Null and empty texts stay as they are; texts
without an id are neither compared nor changed. A text that loses all its lines is "". Very long lines and texts are
compared whole; empty tables give empty results; other columns pass through the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .blobs import pack, ranges, split, unpack, unpack_all
from .shared import Counts, KeySet, PairMap, by_shard, discard, fresh, parts, repeated_ids, staged, unused

THRESHOLD = 0.8
_EPS = 1e-9
#: Reducers expand lists into pairs so many at a time.
_PAIRS = 1 << 20
_FOUND = "kind int, yd bigint, yr bigint, yl bigint, xd bigint, xr bigint, xl bigint, far int"


def line_words(texts: pa.Array) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words by line; the text of each line; its number in that text."""
    split_ = pc.split_pattern(pc.fill_null(T.one_array(texts), ""), "\n")
    offsets = np.asarray(split_.offsets)
    count = np.diff(offsets)
    return T.words(split_.flatten()), np.repeat(np.arange(len(count)), count), ranges(np.zeros(len(count), np.int64), count)


def needed(n: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of a set of size n with any match."""
    return np.ceil(t * n - _EPS).astype(np.int64)


def overlap(both: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of two matching sets whose sizes add up to ``both``."""
    return np.ceil(t / (1 + t) * both - _EPS).astype(np.int64)


def _slim(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.filter("doc_id IS NOT NULL AND text IS NOT NULL")


def row_marks(ids: np.ndarray, texts: pa.Array, again: KeySet) -> np.ndarray:
    """What tells rows of one id apart, as the module has it. ``ids ^ row_marks`` is a key for a row."""
    out = np.zeros(len(ids), np.int64)
    at = np.flatnonzero(again.holds(ids))
    for i, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist()):
        if text is not None:
            mark = xxhash.xxh64_intdigest(text.encode(), int(ids[i]) & 0xFFFFFFFFFFFFFFFF) or 1
            out[i] = mark - (mark >> 63 << 64)
    return out


def count_words(docs: DataFrame) -> Counts:
    shards = parts(docs)
    counts = Counts(fresh(docs.sparkSession, "words"), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            h, n = np.unique(T.words(batch.column("text")).hashes, return_counts=True)
            rows = list(split(counts.shard(h), h, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

    def save(table: pa.Table) -> pa.Table:
        T.release()
        h, n = unpack_all(table["data"].to_pylist())
        return pa.table({"n": pa.array([counts.save(table["shard"][0].as_py(), h, n.astype(np.int64))], pa.int64())})

    by_shard(_slim(docs).mapInArrow(run, "shard int, data binary"), shards).groupBy("shard").applyInArrow(save, "n bigint").count()
    return counts


def postings(batch: pa.RecordBatch, counts: Counts, t: float, shards: int, again: KeySet) -> Iterator[tuple[int, int, bytes]]:
    """(shard, kind, blob): kind 0 are prefix entries, kind 1 lines that repeat one of this batch."""
    w, doc, number = line_words(batch.column("text"))
    if not len(w.hashes):
        return
    vocabulary, place = np.unique(w.hashes, return_inverse=True)
    tf = counts.of(vocabulary)
    rarity = np.empty(len(vocabulary), np.int64)
    by_rarity = np.lexsort((vocabulary, tf))
    rarity[by_rarity] = np.arange(len(vocabulary))
    line = np.repeat(np.arange(len(doc)), np.diff(w.bounds))
    both = T.distinct(line * len(vocabulary) + rarity[place])
    line, word = both // len(vocabulary), by_rarity[both % len(vocabulary)]
    hashes = vocabulary[word]
    n = np.bincount(line, minlength=len(doc))
    bounds = np.concatenate([[0], np.cumsum(n)])
    ids = T.set_hash(hashes, bounds)
    bit = T.U64(1) << (T.mix(hashes) & T.U64(63))
    high = (T.mix(hashes) >> T.U64(6) & T.U64(1)).astype(bool)
    sign = np.zeros((2, len(doc)), np.uint64)
    some = np.flatnonzero(n)
    for k in (0, 1):
        sign[k, some] = np.bitwise_or.reduceat(np.where(high == bool(k), bit, T.U64(0)), bounds[:-1][some])
    all_ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
    doc_id, row = all_ids[doc], row_marks(all_ids, batch.column("text"), again)[doc]

    order = np.lexsort((number, row, doc_id, ids))
    order = order[ids[order] > 0]
    repeats = np.zeros(len(order), bool)
    repeats[1:] = ids[order][1:] == ids[order][:-1]
    if repeats.any():
        # the first of the run: where ``repeats`` was last False
        head = order[np.maximum.accumulate(np.where(repeats, 0, np.arange(len(order))))]
        later = repeats & ((doc_id[order] != doc_id[head]) | (row[order] != row[head]) | (number[order] != number[head]))
        gone = order[later]
        if len(gone):
            yield int(ids[gone[0]] % T.U64(shards)), 1, pack(doc_id[gone], row[gone], number[gone])
    first = np.zeros(len(doc), bool)
    first[order[~repeats]] = True

    position = np.arange(len(line)) - bounds[line]
    use = first[line] & (position < (n - needed(n, t) + 1)[line]) & (tf[word] > 1)
    line, hashes, position = line[use], hashes[use], position[use]
    rarest = np.zeros(len(doc), np.uint64)
    head = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    rarest[line[head]] = hashes[head]
    order = np.argsort(hashes)
    line, hashes, position = line[order], hashes[order], position[order]
    cuts = np.searchsorted(counts.shard(hashes), np.arange(shards + 1))
    for shard in range(shards):
        at = slice(cuts[shard], cuts[shard + 1])
        if cuts[shard] < cuts[shard + 1]:
            i, steps = line[at], np.diff(hashes[at], prepend=T.U64(0))
            yield shard, 0, pack(steps, ids[i], doc_id[i], row[i], number[i], n[i], position[at], sign[0, i], sign[1, i], rarest[i])


def candidates(blobs: list[bytes], t: float) -> Iterator[tuple]:
    """From all prefix entries of a shard: (0, later doc, row and line, zeros) of lines that equal an earlier one as a
    set, and (1, later doc, row and line, earlier doc, row and line, distance) of pairs that pass the filters."""
    entries = [unpack(x) for x in blobs]
    for e in entries:
        e[0] = np.cumsum(e[0])
    h, s, d, r, number, n, p, a, b, rarest = (np.concatenate(c) for c in zip(*entries))
    del entries
    d, r, number, n, p = (x.view(np.int64) for x in (d, r, number, n, p))
    order = np.lexsort((number, r, d, s, h))
    h, s, d, r, number, n, p, a, b, rarest = (x[order] for x in (h, s, d, r, number, n, p, a, b, rarest))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    later = np.flatnonzero(same & (p == 0) & ((d != d[head]) | (r != r[head]) | (number != number[head])))
    none = np.zeros(len(later), np.int64)
    yield 0, d[later], r[later], number[later], none, none, none, none
    order = np.flatnonzero(~same)
    order = order[np.lexsort((n[order], h[order]))]
    h, d, r, number, n, p, a, b, rarest = (x[order] for x in (h, d, r, number, n, p, a, b, rarest))
    word = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    top = int(n.max(initial=0)) + 1
    key = word * top + n
    end = np.searchsorted(key, word * top + np.minimum(np.floor(n / t + _EPS).astype(np.int64), top - 1), side="right")
    count = end - np.arange(len(h)) - 1
    done = np.cumsum(count)
    i = 0
    while i < len(h):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + _PAIRS, side="right")))
        c = count[i:j]
        x = np.repeat(np.arange(i, j), c)
        y = ranges(np.arange(i, j) + 1, c)
        i = j
        need = overlap(n[x] + n[y], t)
        ok = np.minimum(n[x] - p[x], n[y] - p[y]) >= need
        ok &= (rarest[x] != rarest[y]) | (rarest[x] == h[x])  # else the list of that word has the pair
        x, y, need = x[ok], y[ok], need[ok]
        far = np.bitwise_count(a[x] ^ a[y]).astype(np.int64) + np.bitwise_count(b[x] ^ b[y])
        ok = (far <= n[x] + n[y] - 2 * need) & ((d[x] != d[y]) | (r[x] != r[y]) | (number[x] != number[y]))
        x, y, far = x[ok], y[ok], far[ok]
        swap = (d[x] > d[y]) | ((d[x] == d[y]) & ((r[x] > r[y]) | ((r[x] == r[y]) & (number[x] > number[y]))))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        yield 1, d[y], r[y], number[y], d[x], r[x], number[x], far


def same_sets(x: pa.Array, y: pa.Array, t: float) -> pa.Array:
    """Whether two packed word sets match, for each pair."""
    left, right = [np.frombuffer(v, np.uint64) for v in x.to_pylist()], [np.frombuffer(v, np.uint64) for v in y.to_pylist()]
    nx, ny = np.array([len(v) for v in left], np.int64), np.array([len(v) for v in right], np.int64)
    pair = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
    word = np.concatenate([*left, *right]) if len(pair) else np.zeros(0, np.uint64)
    order = np.lexsort((word, pair))
    pair, word = pair[order], word[order]
    both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (word[1:] == word[:-1])], minlength=len(nx))
    return pa.array(both >= overlap(nx + ny, t))


class Removed:
    """``lines`` is (doc_id, row, line), from 0, of every line that matches an earlier one, repeated rows included once or
    more; ``again`` are the ids that several rows have."""

    def __init__(self, docs: DataFrame, t: float = THRESHOLD) -> None:
        spark = docs.sparkSession
        discard(spark)  # what earlier work left
        self.again = again = repeated_ids(docs, "line-again")
        counts = count_words(docs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches, "text"):
                rows = list(postings(batch, counts, t, counts.shards, again))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["shard", "kind", "data"])

        def reduce(table: pa.Table) -> pa.Table:
            T.release()
            kind, data = table["kind"].to_pylist(), table["data"].to_pylist()
            out = []
            for k, blob in zip(kind, data):
                if k == 1:
                    d, r, number = (x.view(np.int64) for x in unpack(blob))
                    none = np.zeros(len(d), np.int64)
                    out.append((0, d, r, number, none, none, none, none))
            entries = [blob for k, blob in zip(kind, data) if k == 0]
            del data
            if entries:
                out += candidates(entries, t)
            columns = [np.concatenate([c[i] for c in out]) if out else np.zeros(0, np.int64) for i in range(1, 8)]
            kinds = np.concatenate([np.full(len(c[1]), c[0], np.int32) for c in out]) if out else np.zeros(0, np.int32)
            return pa.table([pa.array(kinds), *(pa.array(c) for c in columns[:6]), pa.array(columns[6].astype(np.int32))], _FOUND.replace(" bigint", "").replace(" int", "").split(", "))

        shuffled = by_shard(_slim(docs).mapInArrow(run, "shard int, kind int, data binary"), counts.shards).groupBy("shard").applyInArrow(reduce, _FOUND)
        found = staged(shuffled, "line-pairs")
        discard(spark, counts.path)
        equal = found.filter("kind = 0").select("yd", "yr", "yl")
        pairs = found.filter("kind = 1").groupBy("yd", "yr", "yl", "xd", "xr", "xl").agg(F.min("far").alias("far"))
        pairs = staged(pairs.join(equal, ["yd", "yr", "yl"], "left_anti"), "line-candidates")

        # The lines that occur in candidates, read from the corpus once more.
        lines = pairs.select(F.col("yd").bitwiseXOR(F.col("yr")).alias("k"), F.col("yl").alias("l")).union(pairs.select(F.col("xd").bitwiseXOR(F.col("xr")), "xl"))
        wanted = PairMap.write(lines, "line-wanted")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches, "text"):
                ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
                marks = row_marks(ids, batch.column("text"), again)
                place, number = wanted.find(ids ^ marks)
                if not len(place):
                    continue
                texts = batch.column("text").take(pa.array(np.unique(place)))
                w, doc, at = line_words(texts)
                doc = np.unique(place)[doc]
                line = np.flatnonzero(np.isin(doc * (1 << 32) + at, place * (1 << 32) + number))
                sets, bounds = T.unit_sets(w.hashes, w.bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc[line]]), pa.array(marks[doc[line]]), pa.array(at[line]), pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in line], pa.binary())], ["d", "r", "l", "words"]
                )

        texts = staged(_slim(docs).mapInArrow(fetch, "d bigint, r bigint, l bigint, words binary").groupBy("d", "r", "l").agg(F.min("words").alias("words")), "line-texts")
        discard(spark, wanted.path)

        @F.arrow_udf("boolean")
        def matches(x: pa.Array, y: pa.Array) -> pa.Array:
            return same_sets(x, y, t)

        def verified(some: DataFrame) -> DataFrame:
            x, y = texts.toDF("xd", "xr", "xl", "xw"), texts.toDF("yd", "yr", "yl", "yw")
            both = some.join(x, ["xd", "xr", "xl"]).join(y, ["yd", "yr", "yl"])
            return both.withColumn("ok", matches("xw", "yw")).filter("ok").select("yd", "yr", "yl")

        nearest = pairs.groupBy("yd", "yr", "yl").agg(F.min(F.struct("far", "xd", "xr", "xl")).alias("n")).select("yd", "yr", "yl", "n.xd", "n.xr", "n.xl")
        first = staged(verified(nearest), "line-first")
        rest = pairs.join(first, ["yd", "yr", "yl"], "left_anti").join(nearest, ["yd", "yr", "yl", "xd", "xr", "xl"], "left_anti")
        self.lines = equal.union(first).union(verified(rest)).toDF("doc_id", "row", "line")
        self._used = [found, pairs, texts, first]

    def write(self) -> PairMap:
        """The lines of each row, by its key; what they were found with is deleted."""
        gone = PairMap.write(self.lines.select(F.col("doc_id").bitwiseXOR(F.col("row")).alias("k"), "line"), "line-gone")
        discard(self.lines.sparkSession, *self._used)
        return gone


def without(texts: pa.Array, ids: pa.Array, gone: PairMap, again: KeySet) -> pa.Array:
    """The texts without the lines that ``gone`` lists for their rows."""
    known = np.asarray(ids.is_valid())
    ids = np.asarray(ids.fill_null(0), dtype=np.int64)
    place, number = gone.find(ids ^ row_marks(ids, texts, again))
    use = known[place]
    place, number = place[use], number[use]
    touched, first = np.unique(place, return_index=True)
    if not len(touched):
        return texts
    cuts = np.append(first, len(place))
    mask, new = np.zeros(len(texts), bool), []
    for i, text in enumerate(texts.take(pa.array(touched)).to_pylist()):
        if text is None:
            continue
        drop = set(number[cuts[i] : cuts[i + 1]].tolist())
        new.append("\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop))
        mask[touched[i]] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))


def _rewriter(docs: DataFrame, t: float):  # noqa: ANN202
    removed = Removed(docs, t)
    gone, again = removed.write(), removed.again

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, ids: pa.Array) -> pa.Array:
        return without(texts, ids, gone, again)

    return rewrite(F.col("text").cast("string"), F.col("doc_id").cast("bigint"))


def line_dedup(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """``docs`` with the later matches removed from ``text``; all other columns as they are. See the module."""
    return docs.withColumn("text", _rewriter(docs, t))


def deduped(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` after line dedup: ``n_chars`` follows a changed text, and a document that lost all its text
    goes; all other columns are as they were."""
    new = unused(docs, "new_text")
    both = docs.withColumn(new, _rewriter(docs, t))
    both = both.filter(F.coalesce(F.length(new) > 0, F.lit(True)) | (F.length("text") == 0))
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.col(new).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(new) != F.col("text"), F.length(new)).otherwise(F.col(c)).cast(kind).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return both.select(*columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")


assert math.isclose(THRESHOLD, 4 / 5)  # the SQL below compares 5 * overlap with 4 * union
OP3_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
lines AS (SELECT doc_id, i - 1 AS line, ls[i] AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
sets AS (SELECT doc_id, line, w, len(w) AS n FROM (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(lower(s), '(?:[0-9a-z]|[^\x00-\x7F])+'))) AS w FROM lines) WHERE len(w) > 0),
firsts AS (SELECT w, any_value(n) AS n, min({'doc_id': doc_id, 'line': line}) AS loc FROM sets GROUP BY w),
ided AS (SELECT row_number() OVER (ORDER BY loc) AS id, w, n, loc FROM firsts),
tokens AS (SELECT id, n, unnest(w) AS t FROM ided),
df AS (SELECT t, count(*) AS df FROM tokens GROUP BY t),
prefix AS (SELECT id, n, t FROM (
  SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS p FROM tokens JOIN df USING (t) WHERE TRUE) WHERE p <= n - ((4 * n + 4) // 5) + 1),
cand AS (SELECT DISTINCT x.id AS xi, y.id AS yi FROM prefix x JOIN prefix y ON x.t = y.t AND x.id < y.id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
hit AS (SELECT DISTINCT yi AS id FROM (SELECT yi, x.n + y.n AS total, len(list_intersect(x.w, y.w)) AS o FROM cand JOIN ided x ON x.id = xi JOIN ided y ON y.id = yi)
  WHERE 5 * o >= 4 * (total - o)),
stay AS (SELECT loc.doc_id AS doc_id, loc.line AS line FROM (SELECT loc FROM ided WHERE id NOT IN (SELECT id FROM hit))),
kept AS (SELECT l.doc_id, l.line, l.s FROM lines l LEFT JOIN sets z ON z.doc_id = l.doc_id AND z.line = l.line
  LEFT JOIN stay k ON k.doc_id = l.doc_id AND k.line = l.line WHERE z.n IS NULL OR k.doc_id IS NOT NULL),
joined AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.doc_id IS NULL THEN d.text ELSE coalesce(j.text, '') END AS text
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""
