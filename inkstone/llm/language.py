"""Operator 2, LM scoring: an interpolated trigram model of the whole corpus in an Elias-Fano trie, and every document's
log probability under it.

Each text is ``<s> w1 ... wn </s>``. With discount D, c counting and T counting distinct successors,

    p(c | a b) = max(0, c(abc) - D) / c(ab.) + D T(ab) / c(ab.) p(c | b)
    p(b | a)   = max(0, c(ab) - D) / c(a)    + D T(a)  / c(a)   p(b)
    p(b)       = (c(b) + 1) / (c(.) + V + 1)

and an unseen context passes the lower order through. The discounted terms and the weights are what the trie stores,
quantised to ``BITS`` bits on a logarithmic scale.

1. The vocabulary: word counts by hash range; a word's id is its place among all sorted hashes.
2. Every adjacent pair goes with its successor, as ids, to the shard of the pair. A shard builds its trie and writes it
   to the shared folder: contexts (Elias-Fano), monotone pointers (Elias-Fano) to the successors of each context,
   bit-packed successor ids in ascending order within their context, and once more for the third word. Shards depend on
   pairs, so the successors of a frequent word are spread over all of them.
3. Successor counts of single words are added up by vocabulary shard.
4. Scoring maps the files. Each slice looks up its distinct pairs, then its distinct triples: the pointers of the
   context give a range, and the successor is searched within it. Nothing is broadcast and no text is shuffled; what is
   gathered from the corpus is every trigram of it.

Defined results: a null or empty text, or one without words, is neither counted nor scored (tokens 0, null
``log_prob`` and ``perplexity``). Null and repeated ids are scored row by row, repeated rows count again. Very long
texts are counted and scored whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .blobs import pack, split, unpack, unpack_all
from .shared import by_shard, discard, existing, fresh, parts, put
from .succinct import EliasFano, Packed, search, sections, split_sections

DISCOUNT = 0.75
BITS = 10
_FLOOR = 32.0  # nats: the smallest probability that quantisation tells apart
#: Files of a model that a task keeps open from slice to slice; a worker keeps none.
_OPEN = 256
BEGIN, END = (np.array([h], np.uint64) for h in (0x0123456789ABCDEF, 0xFEDCBA9876543210))
SCHEMA = "doc_id bigint, tokens bigint, log_prob double, perplexity double"


def quantise(p: np.ndarray) -> np.ndarray:
    """0 stands for probability 0; other steps are equal in the logarithm."""
    top = (1 << BITS) - 1
    with np.errstate(divide="ignore"):
        q = np.rint((top - 1) * np.log(p) / -_FLOOR)
    return np.where(p > 0, 1 + np.clip(q, 0, top - 1), 0).astype(np.uint64)


def restore(q: np.ndarray) -> np.ndarray:
    return _levels()[q.astype(np.int64)]


@lru_cache(maxsize=1)
def _levels() -> np.ndarray:
    top = (1 << BITS) - 1
    return np.concatenate([[0.0], np.exp(-_FLOOR * np.arange(top) / (top - 1))])


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys in the order of (a, b), whatever their size: side by side where 64 bits hold both, else by rank."""
    width = int(b.max()).bit_length() if len(b) else 0
    if width + (int(a.max()).bit_length() if len(a) else 0) > 64:
        a, b = (np.unique(x, return_inverse=True)[1] for x in (a, b))
        width = int(b.max()).bit_length()
    return (a.astype(np.uint64) << np.uint64(width)) | b.astype(np.uint64)


class Model(NamedTuple):
    """Where the files of a model are; ``offsets[s]`` is the first id of vocabulary shard s, its last entry the size."""

    path: str
    shards: int
    offsets: np.ndarray
    total: int

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def pair_shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.word_shard(T.mix(a.astype(np.uint64) * T._C1 + b.astype(np.uint64)))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word; the size of the vocabulary for an unknown one."""
        out = np.full(len(hashes), self.size, np.int64)
        order = np.argsort(hashes)
        cuts = np.searchsorted(self.word_shard(hashes[order]), np.arange(self.shards + 1))
        for s in range(self.shards):
            at = order[cuts[s] : cuts[s + 1]]
            own = existing(f"{self.path}/words/{s}").view(np.uint64) if len(at) else ()
            if len(own):
                words = own[: len(own) // 2]
                i = np.minimum(np.searchsorted(words, hashes[at]), len(words) - 1)
                out[at] = np.where(words[i] == hashes[at], self.offsets[s] + i, self.size)
        return out

    def _by_id(self, ids: np.ndarray, width: int, read) -> np.ndarray:  # noqa: ANN001
        out = np.zeros((width, len(ids)), np.int64)
        shard = np.searchsorted(self.offsets, ids, side="right") - 1
        for s in T.distinct(shard):
            if s < self.shards:
                at = np.flatnonzero(shard == s)
                out[:, at] = read(int(s), ids[at] - self.offsets[s])
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        def read(s: int, i: np.ndarray) -> np.ndarray:
            own = existing(f"{self.path}/words/{s}").view(np.uint64)
            return own[len(own) // 2 :][i].astype(np.int64)[None]

        return self._by_id(ids, 1, read)[0]

    def unigrams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w) and the weight that context w gives to it; of unknown words, 1 / (c(.) + V + 1) and 1."""

        def read(s: int, i: np.ndarray) -> list[np.ndarray]:
            return [p[i].astype(np.int64) for p in _unigrams(f"{self.path}/unigrams/{s}")]

        p, weight = self._by_id(ids, 2, read)
        known = ids < self.size
        return np.where(known, restore(p), 1 / (self.total + self.size + 1)), np.where(known, restore(weight), 1.0)


@lru_cache(maxsize=_OPEN)
def _unigrams(uri: str) -> list[Packed]:
    return [Packed.decode(x) for x in split_sections(existing(uri))]


class Trie(NamedTuple):
    contexts: EliasFano  # ids of first words
    to_pairs: EliasFano  # where the successors of each begin
    second: Packed
    pair_p: Packed
    pair_weight: Packed
    to_triples: EliasFano
    third: Packed
    triple_p: Packed

    @staticmethod
    def encode(a: np.ndarray, b: np.ndarray, c: np.ndarray, none: int, count_of) -> tuple[bytes, np.ndarray, np.ndarray]:  # noqa: ANN001
        """The trie of all (a, b, c) of a shard, repeats included; ``none`` stands for no third word. Also each first
        word with its number of distinct second words."""
        order = np.argsort(together(a, b))
        a, b, c = a[order], b[order], c[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        pair = np.cumsum(new) - 1
        order = np.argsort(together(pair, c))
        pair, c = pair[order], c[order]
        first = np.concatenate([[True], (pair[1:] != pair[:-1]) | (c[1:] != c[:-1])])
        n = np.diff(np.append(np.flatnonzero(first), len(pair)))
        pair, third = pair[first], c[first]
        a, b = a[new], b[new]
        pair_n = np.bincount(pair, weights=n).astype(np.int64)
        go_on = third != none
        pair, third, n = pair[go_on], third[go_on], n[go_on]
        followed = np.bincount(pair, weights=n, minlength=len(a))
        kinds = np.bincount(pair, minlength=len(a))
        head = np.concatenate([[True], a[1:] != a[:-1]])
        contexts = a[head]
        successors = np.diff(np.append(np.flatnonzero(head), len(a)))
        before = count_of(contexts)[np.cumsum(head) - 1]
        zero = np.zeros(1, np.int64)
        return (
            sections(
                EliasFano.encode(contexts),
                EliasFano.encode(np.concatenate([zero, np.cumsum(successors)])),
                Packed.encode(b),
                Packed.encode(quantise((pair_n - DISCOUNT) / before), BITS),
                Packed.encode(quantise(np.where(followed > 0, DISCOUNT * kinds / np.maximum(followed, 1), 1.0)), BITS),
                EliasFano.encode(np.concatenate([zero, np.cumsum(kinds)])),
                Packed.encode(third),
                Packed.encode(quantise((n - DISCOUNT) / followed[pair]), BITS),
            ),
            contexts,
            successors,
        )

    @classmethod
    def decode(cls, data: np.ndarray) -> Trie:
        kinds = (EliasFano, EliasFano, Packed, Packed, Packed, EliasFano, Packed, Packed)
        return cls(*(k.decode(x) for k, x in zip(kinds, split_sections(data))))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each pair."""
        i, known = self.contexts.find(a)
        place, found = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        at = np.flatnonzero(known)
        first, end = (self.to_pairs[i[at] + k].astype(np.int64) for k in (0, 1))
        place[at], found[at] = search(self.second, first, end, b[at].astype(np.uint64))
        return place, found

    def triples(self, pair: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, end = (self.to_triples[pair + k].astype(np.int64) for k in (0, 1))
        return search(self.third, first, end, c.astype(np.uint64))


@lru_cache(maxsize=_OPEN)
def _trie(uri: str) -> Trie | None:
    data = existing(uri)
    return Trie.decode(data) if len(data) else None


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``<s> w1 ... wn </s>`` of the texts that have words, and the bounds of all texts."""
    w = T.words(texts)
    size = np.diff(w.bounds)
    full = size > 0
    bounds = np.concatenate([[0], np.cumsum(size + 2 * full)])
    out = np.empty(bounds[-1], np.uint64)
    rank = np.cumsum(full) - full
    out[np.arange(len(w.hashes)) + np.repeat(2 * rank + 1, size)] = w.hashes
    out[bounds[:-1][full]] = BEGIN
    out[bounds[1:][full] - 1] = END
    return out, bounds


def train(docs: DataFrame) -> Model:
    """Counts ``docs(text)`` and writes the files of its model."""
    shards = parts(docs)
    path = fresh(docs.sparkSession, "lm")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    blank = Model(path, shards, np.zeros(shards + 1, np.int64), 0)

    def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            h, n = np.unique(sequences(batch.column("text"))[0], return_counts=True)
            yield blobs(list(split(blank.word_shard(h), h, n)))

    def save_words(table: pa.Table) -> pa.Table:
        T.release()
        h, n = unpack_all(table["data"].to_pylist())
        order = np.argsort(h)
        h, n = h[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(n, first)
        shard = table["shard"][0].as_py()
        put(f"{path}/words/{shard}", h[first].tobytes() + n.tobytes())
        return pa.table([pa.array([shard], pa.int32()), pa.array([len(first)], pa.int64()), pa.array([int(n[h[first] != BEGIN].sum())], pa.int64())], ["shard", "size", "n"])

    sizes = by_shard(texts.mapInArrow(count, "shard int, data binary"), shards).groupBy("shard").applyInArrow(save_words, "shard int, size bigint, n bigint").collect()
    per_shard = np.zeros(shards, np.int64)
    for r in sizes:
        per_shard[r["shard"]] = r["size"]
    model = Model(path, shards, np.concatenate([[0], np.cumsum(per_shard)]), sum(r["n"] for r in sizes))
    discard(docs.sparkSession)  # the counts of words are in their files

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            h, bounds = sequences(batch.column("text"))
            if not len(h):
                continue
            vocabulary, place = np.unique(h, return_inverse=True)
            x = np.append(model.ids(vocabulary)[place], [model.size, model.size])
            first = np.ones(len(h), bool)
            first[bounds[1:][np.diff(bounds) > 0] - 1] = False
            i = np.flatnonzero(first)
            a, b = x[i], x[i + 1]
            c = np.where(first[np.minimum(i + 1, len(h) - 1)], x[i + 2], model.size)
            shard = model.pair_shard(a, b)
            order = np.argsort(together(shard, a))
            a, b, c = a[order], b[order], c[order]
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            yield blobs([(k, pack(np.diff(a[u:v], prepend=0), b[u:v], c[u:v])) for k, (u, v) in enumerate(zip(cuts[:-1], cuts[1:])) if u < v])

    def save_trie(table: pa.Table) -> pa.Table:
        T.release()
        entries = [unpack(x) for x in table["data"].to_pylist()]
        a = np.concatenate([np.cumsum(e[0]) for e in entries]).astype(np.int64)
        b, c = (np.concatenate([e[k] for e in entries]).astype(np.int64) for k in (1, 2))
        del entries
        data, contexts, successors = Trie.encode(a, b, c, model.size, model.counts)
        put(f"{path}/trie/{table['shard'][0].as_py()}", data)
        shard = np.searchsorted(model.offsets, contexts, side="right") - 1
        return pa.Table.from_batches([blobs(list(split(shard, contexts, successors)))])

    def save_unigrams(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        own = existing(f"{path}/words/{shard}").view(np.uint64)
        n = own[len(own) // 2 :].astype(np.float64)
        ids, kinds = unpack_all(table["data"].to_pylist())
        kinds = np.bincount(ids.astype(np.int64) - model.offsets[shard], weights=kinds, minlength=len(n))
        p = (n + 1) / (model.total + model.size + 1)
        weight = np.where(kinds > 0, DISCOUNT * kinds / n, 1.0)
        put(f"{path}/unigrams/{shard}", sections(Packed.encode(quantise(p), BITS), Packed.encode(quantise(weight), BITS)))
        return pa.table([pa.array([len(n)], pa.int64())], ["n"])

    # A shard whose words begin no pair (</s> alone) sends an empty blob, so that its file is written too.
    every = docs.sparkSession.createDataFrame([(r["shard"], bytearray(pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))) for r in sizes], "shard int, data binary")
    kinds = by_shard(texts.mapInArrow(send, "shard int, data binary"), shards).groupBy("shard").applyInArrow(save_trie, "shard int, data binary")
    kinds.union(every).groupBy("shard").applyInArrow(save_unigrams, "n bigint").count()
    discard(docs.sparkSession)  # all that was shuffled is in the model
    return model


def log_probs(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Predicted tokens (words and the end) and log probability of each text."""
    h, bounds = sequences(texts)
    tokens = np.maximum(np.diff(bounds) - 1, 0)
    if not len(h):
        return tokens, np.zeros(len(tokens))
    vocabulary, place = np.unique(h, return_inverse=True)
    known = model.ids(vocabulary)
    x = known[place]
    p1, weight1 = (v[place] for v in model.unigrams(known))
    first = np.ones(len(h), bool)
    first[bounds[1:][tokens > 0] - 1] = False
    i = np.flatnonzero(first)  # pairs (i, i + 1)
    # Distinct pairs by shard, then distinct triples within each pair found.
    a, b = x[i], x[i + 1]
    shard = model.pair_shard(a, b)
    p2, weight2, alpha3 = p1[i + 1] * weight1[i], np.ones(len(i)), np.zeros(len(i))
    lower = p2.copy()
    after = np.flatnonzero(np.append(i[1:] == i[:-1] + 1, False))  # pairs that the next pair continues
    c = np.full(len(i), -1)
    c[after] = b[after + 1]
    by_shard = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by_shard], np.arange(model.shards + 1))
    for s in range(model.shards):
        at = by_shard[cuts[s] : cuts[s + 1]]
        trie = _trie(f"{model.path}/trie/{s}") if len(at) else None
        if trie is None:
            continue
        own_a, own_b = a[at], b[at]
        pair, one, back = np.unique(together(own_a, own_b), return_index=True, return_inverse=True)
        node, found = trie.pairs(own_a[one], own_b[one])
        hit = np.flatnonzero(found)
        alpha, weight = np.zeros(len(pair)), np.ones(len(pair))
        alpha[hit], weight[hit] = restore(trie.pair_p[node[hit]]), restore(trie.pair_weight[node[hit]])
        lower[at] += alpha[back]
        weight2[at] = weight[back]
        go = np.flatnonzero(found[back] & (c[at] >= 0))
        pair_of, third = node[back[go]], c[at[go]]
        triple, one, again = np.unique(together(pair_of, third), return_index=True, return_inverse=True)
        leaf, seen = trie.triples(pair_of[one], third[one])
        value = np.zeros(len(triple))
        value[seen] = restore(trie.triple_p[leaf[seen]])
        alpha3[at[go]] = value[again]
    # A pair's second word is predicted from the pair before it where there is one.
    p = lower.copy()
    p[after + 1] = alpha3[after] + weight2[after] * lower[after + 1]
    logs = np.zeros(len(tokens))
    full = np.flatnonzero(tokens)
    starts = np.concatenate([[0], np.cumsum(tokens)])[:-1]
    logs[full] = np.add.reduceat(np.log(p), starts[full])
    return tokens, logs


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, tokens, log_prob, perplexity`` of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            tokens, logs = log_probs(batch.column("text"), model)
            none = tokens == 0
            perplexity = np.exp(-logs / np.maximum(tokens, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokens), pa.array(np.round(logs, 6), mask=none), pa.array(np.round(perplexity, 6), mask=none)],
                ["doc_id", "tokens", "log_prob", "perplexity"],
            )
        _trie.cache_clear()
        _unigrams.cache_clear()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))
