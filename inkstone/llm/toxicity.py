"""Operator 7, toxicity: a logistic classifier of texts whose scores change little when identity terms are swapped.

The model is fitted on labelled texts and on their counterfactuals, in which every identity term is replaced by the next
of its group. Beside the usual loss and a ridge, the squared change of the logit between a text and its counterfactual
is penalised, so that weight which rests on a mention of a group moves to the words that make a text toxic; a neutral
mention then is no evidence. Features are whether each of ``FEATURES`` words occurs, chosen by their log-likelihood
ratio between toxic and other texts; each is a word of its own, not a bucket that others share. Beside words these are
their beginnings of ``STEMS`` bytes, so that inflected and compound forms of a word count together; identity terms have
none, so that what they share with other words does not tie them to these.

Only the fit is bounded: it takes at most ``MAX_LABELLED`` labelled documents, by the order of a hash of their id, and
its cost does not grow with the corpus. Labels are looked up in mapped files, so that no text is shuffled to meet them;
every document is scored whole in one pass, by a model of fixed size.

Defined results: a document is labelled toxic if any of its labels with a value says so. Labels without an id, a value or
a document train nothing. A null or empty text has the score of no evidence, the bias. Without both toxic and other
labelled texts the score is 0 for all. Repeated rows are scored each, and train each. Null ids are scored. Other columns
are ignored. ``toxic`` is whether the score reaches ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import PairMap, staged

MAX_LABELLED = 20_000
FEATURES = 4096
STEMS = (4, 6)
#: The least log-likelihood ratio of a feature: one in a hundred words that tell nothing reaches it.
EVIDENCE = 6.63
CUT = 0.5
FAIRNESS = 1.0
RIDGE = 2e-4
STEPS = 400
#: Terms of a group are swapped in a circle; plural and singular, nouns and adjectives, are groups of their own.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("she", "he"), ("her", "his"), ("mothers", "fathers"), ("wife", "husband"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american", "indian", "mexican"), ("blacks", "whites", "asians", "latinos", "arabs", "africans", "europeans", "americans", "indians", "mexicans"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("gays", "straights", "lesbians", "bisexuals"), ("transgender", "cisgender"), ("trans", "cis"),
    ("immigrant", "native", "refugee", "foreigner"), ("immigrants", "natives", "refugees", "foreigners"), ("deaf", "blind", "disabled", "autistic"), ("old", "young"), ("elderly", "teenagers"), ("rich", "poor"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"), ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "asiáticos"),
)


def _hashes(words: list[str]) -> np.ndarray:
    return T.words(pa.array(words)).hashes


@lru_cache(maxsize=8)
def swaps(groups: tuple[tuple[str, ...], ...] = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the identity terms, sorted, and of what each is replaced by."""
    terms = [(g[i], g[(i + 1) % len(g)]) for g in groups for i in range(len(g))]
    a, b = _hashes([t[0] for t in terms]), _hashes([t[1] for t in terms])
    order = np.argsort(a)
    return a[order], b[order]


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of their beginnings, and where each text's begin."""
    w = T.words(texts)
    owner, size = w.owner, w.ends - w.starts
    term = swaps()[0]
    at = np.minimum(np.searchsorted(term, w.hashes), len(term) - 1)
    free = term[at] != w.hashes
    hashes, owners = [w.hashes], [owner]
    for n in STEMS:
        use = np.flatnonzero(free & (size > n))
        hashes.append(T.word_hashes(w.data, w.starts[use], w.starts[use] + n) ^ T._C3)
        owners.append(owner[use])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bounds = np.zeros(len(w.bounds), np.int64)
    np.cumsum(np.bincount(owner, minlength=len(bounds) - 1), out=bounds[1:])
    return np.concatenate(hashes)[order], bounds


def choose(values: np.ndarray, owner: np.ndarray, toxic: np.ndarray, most: int) -> np.ndarray:
    """The words whose occurrence tells most about the label, by log-likelihood ratio; sorted hashes."""
    word, place = np.unique(values, return_inverse=True)
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    k1 = np.bincount(place, weights=toxic[owner], minlength=len(word))
    k0 = np.bincount(place, minlength=len(word)) - k1

    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (k1 + k0) / (n1 + n0)
    g = 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, both) - part(k0, n0, both))
    use = np.flatnonzero((k1 + k0 > 1) & (g > EVIDENCE))
    use = use[np.lexsort((word[use], -g[use]))][:most]
    return np.sort(word[use])


def fit(values: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, groups=GROUPS, most: int = FEATURES, fairness: float = FAIRNESS, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:  # noqa: ANN001
    """(sorted words, weights, bias) from the word sets of labelled texts; ``chosen`` are the features, if known."""
    if not toxic.any() or toxic.all():
        return np.zeros(0, np.uint64), np.zeros(0), -np.inf
    owner = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    term, other = swaps(groups)
    words = T.distinct(np.concatenate([choose(values, owner, toxic, most) if chosen is None else chosen, term]))

    def rows(v: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(words, v), len(words) - 1)
        use = words[at] == v
        both = T.distinct(o[use] * len(words) + at[use])
        return both // len(words), both % len(words)

    i, j = rows(values, owner)
    at = np.minimum(np.searchsorted(term, values), len(term) - 1)
    swapped = np.where(term[at] == values, other[at], values)
    mentions = np.zeros(len(toxic), bool)
    mentions[owner[term[at] == values]] = True
    use = mentions[owner]
    ci, cj = rows(swapped[use], owner[use])
    # +1 where a word occurs in the text, -1 where in the counterfactual; words of both cancel.
    di, dj = np.concatenate([i[mentions[i]], ci]), np.concatenate([j[mentions[i]], cj])
    dv = np.concatenate([np.ones(int(mentions[i].sum())), -np.ones(len(ci))])
    n, y = len(toxic), toxic.astype(float)
    share = np.where(toxic, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # both labels weigh alike
    w, bias = np.zeros(len(words)), 0.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(i, weights=w[j], minlength=n) + bias, -30, 30)))
        error = share * (p - y)
        change = np.bincount(di, weights=w[dj] * dv, minlength=n)
        gradient = np.bincount(j, weights=error[i], minlength=len(words)) + RIDGE * w
        gradient += 2 * fairness / max(1, int(mentions.sum())) * np.bincount(dj, weights=change[di] * dv, minlength=len(words))
        g = np.append(gradient, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w, bias = w - move[:-1], bias - move[-1]
    return words, w, float(bias)


def logits(texts: pa.Array, words: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    hashes, bounds = units(texts)
    out = np.full(len(bounds) - 1, bias)
    if len(words) and len(hashes):
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        use = np.flatnonzero(words[at] == hashes)
        owner = np.searchsorted(bounds, use, side="right") - 1
        both = T.distinct(owner * len(words) + at[use])
        out += np.bincount(both // len(words), weights=weights[both % len(words)], minlength=len(out))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("bigint").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Of equal hashes, which does not matter: a hash is of the id, and ids are distinct here.
    some = PairMap.write(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "toxic-labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            place, toxic = some.find(np.asarray(batch.column("doc_id"), dtype=np.int64))
            if not len(place):
                continue
            values, bounds = T.unit_sets(*units(batch.column("text").take(pa.array(place))))
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(place)), pa.array(toxic > 0), pa.array(sets, pa.binary())], ["doc_id", "toxic", "words"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    labelled = staged(slim.mapInArrow(run, "doc_id bigint, toxic boolean, words binary"), "toxic-labelled")
    tally = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = _chosen(labelled, tally.get(True, 0), tally.get(False, 0))
    keep = T.distinct(np.concatenate([chosen, swaps()[0]]))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            few = [x[np.isin(x, keep)].tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(few, pa.binary())], ["doc_id", "toxic", "words"])

    # What the driver gets is bounded by the labelled documents and the features; the words of a text stay with the tasks.
    table = labelled.mapInArrow(select, "doc_id bigint, toxic boolean, words binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    sets = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return fit(np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds, np.array(table["toxic"].to_pylist(), bool), chosen=chosen)


def _chosen(labelled: DataFrame, n1: int, n0: int, most: int = FEATURES) -> np.ndarray:
    """``choose`` over a table of word sets, by counts that are added up by word."""
    if not n1 or not n0:
        return np.zeros(0, np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("words").to_pylist()]
            if not sets:
                continue
            word, place = np.unique(np.concatenate(sets), return_inverse=True)
            toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), bool), [len(x) for x in sets])
            k1 = np.bincount(place, weights=toxic, minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(k1), pa.array(np.bincount(place, minlength=len(word)) - k1)], ["word", "k1", "k0"])

    def part(k, n, p):  # noqa: ANN001, ANN202
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    k1, k0, both = F.col("k1"), F.col("k0"), (F.col("k1") + F.col("k0")) / F.lit(float(n1 + n0))
    g = 2 * (part(k1, n1, k1 / F.lit(float(n1))) + part(k0, n0, k0 / F.lit(float(n0))) - part(k1, n1, both) - part(k0, n0, both))
    counted = labelled.select("toxic", "words").mapInArrow(count, "word bigint, k1 bigint, k0 bigint").groupBy("word").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    best = counted.filter("k1 + k0 > 1").select("word", g.alias("g")).filter(F.col("g") > EVIDENCE).orderBy(F.col("g").desc(), "word").limit(most)
    return np.sort(np.array([r["word"] for r in best.collect()], np.int64).view(np.uint64))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, score, toxic`` of every row of ``docs``; see the module."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))  # a few thousand words at most

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [
            np.round(1 / (1 + np.exp(-logits(piece.column("text"), *sent.value))), 6)
            for piece in T.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")
        ]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.select("doc_id", score(F.col("text").cast("string")).alias("score")).withColumn("toxic", F.col("score") >= CUT)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
