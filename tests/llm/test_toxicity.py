import random

import numpy as np
import pyarrow as pa

from inkstone.llm import text as T
from inkstone.llm import toxicity as X

from .common import corpus, frame, got, prose

INSULTS = ("idiot", "scum", "moron", "trash")


def sample(rng, n, biased):
    """Texts with labels; with ``biased``, toxic ones mention a group more often than others do."""
    out = []
    for k in range(n):
        toxic = k % 4 == 0
        t = prose(rng, rng.randrange(20, 80))
        if toxic:
            t += " " + " ".join(rng.sample(INSULTS, 2))
        if biased and rng.random() < (0.7 if toxic else 0.02):
            t += " muslims"
        out.append((t, toxic))
    return out


def fitted(data, fairness):
    w = T.words(pa.array([t for t, _ in data]))
    return X.fit(*T.unit_sets(w.hashes, w.bounds), np.array([y for _, y in data]), fairness=fairness)


def test_penalty_frees_neutral_mentions():
    data = sample(random.Random(1), 800, True)
    rng = random.Random(2)
    neutral = [prose(rng, 40) for _ in range(200)]
    gaps = []
    for fairness in (0.0, 3.0):
        model = fitted(data, fairness)
        plain = X.logits(pa.array(neutral), *model)
        named = X.logits(pa.array([t + " muslims" for t in neutral]), *model)
        other = X.logits(pa.array([t + " christians" for t in neutral]), *model)
        gaps.append((np.abs(named - other).mean(), (named > 0).mean(), (plain > 0).mean()))
    assert gaps[1][0] < 0.3 * gaps[0][0] and gaps[1][1] <= gaps[0][1]
    held = sample(random.Random(3), 300, True)
    scores = X.logits(pa.array([t for t, _ in held]), *fitted(data, 3.0))
    assert np.mean((scores > 0) == np.array([y for _, y in held])) > 0.97


def test_held_out_documents(spark):
    data = sample(random.Random(4), 600, False)
    rows = [(k, t) for k, (t, _) in enumerate(data)]
    labels = spark.createDataFrame([(k, 1, int(y)) for k, (_, y) in enumerate(data[:400])] + [(None, 1, 1), (5, 1, None), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = {r[0]: r for r in got(X.toxicity(frame(spark, rows, clashing=True), labels))}
    assert np.mean([found[k][2] == data[k][1] for k in range(400, 600)]) > 0.97
    again = got(X.toxicity(frame(spark, rows), labels, most=150))
    assert len(again) == 600 and np.mean([r[2] == data[r[0]][1] for r in again]) > 0.95


def test_swaps_and_edges(spark):
    a, b = X.swaps()
    assert len(a) == len(set(a.tolist())) and sorted(a.tolist()) == sorted(b.tolist())
    rows = corpus(2)
    no_labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert got(X.toxicity(frame(spark, rows, clashing=True), no_labels)) == sorted([(i, 0.0, False) for i, _ in rows], key=repr)
    assert got(X.toxicity(frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))) == []
    some = spark.createDataFrame([(i, int(i == 3)) for i in range(10)] + [(4, 1), (4, 0)], "doc_id bigint, toxic int")
    assert len(got(X.toxicity(frame(spark, rows), some))) == len(rows)


def test_chosen_words_equal_those_of_one_array(spark):
    data = sample(random.Random(6), 300, True)
    values, bounds = T.unit_sets(*X.units(pa.array([t for t, _ in data])))
    toxic = np.array([y for _, y in data])
    rows = [(k, bool(toxic[k]), bytearray(values[bounds[k] : bounds[k + 1]].tobytes())) for k in range(len(data))]
    table = spark.createDataFrame(rows, "doc_id bigint, toxic boolean, words binary").repartition(3)
    whole = X.choose(values, np.repeat(np.arange(len(data)), np.diff(bounds)), toxic, X.FEATURES)
    assert len(whole) > 10 and X._chosen(table, int(toxic.sum()), int((~toxic).sum())).tolist() == whole.tolist()


def test_beginnings_of_words(spark):
    rng = random.Random(7)
    data = [(prose(rng, 30) + (f" vermin{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" if k % 2 else ""), bool(k % 2)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(y)) for k, (_, y) in enumerate(data[:300])], "doc_id bigint, toxic int")
    found = {r[0]: r[2] for r in got(X.toxicity(frame(spark, [(k, t) for k, (t, _) in enumerate(data)]), labels))}
    assert np.mean([found[k] == data[k][1] for k in range(300, 600)]) > 0.97
    values, bounds = X.units(pa.array(["women girls", "", None, "vermin"]))
    assert np.diff(bounds).tolist() == [2, 0, 0, 2]  # identity terms have no beginnings; a word of six bytes has one of four


def plain_fit(texts, toxic, groups, fairness):
    """The same classifier with loops over words: choice of features, loss, penalty, steps; (word -> weight, bias)."""
    import math
    import re

    swap = {g[i]: g[(i + 1) % len(g)] for g in groups for i in range(len(g))}

    def features(words):
        out = set(words)
        for w in words:
            if w not in swap:
                out |= {("begins", n, w.encode()[:n]) for n in X.STEMS if len(w.encode()) > n}
        return out

    words = [re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", t.lower()) for t in texts]
    sets = [features(w) for w in words]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    part = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    chosen = set()
    for f in set().union(*sets):
        k1 = sum(f in s for s, y in zip(sets, toxic) if y)
        k0 = sum(f in s for s, y in zip(sets, toxic) if not y)
        both = (k1 + k0) / (n1 + n0)
        if k1 + k0 > 1 and 2 * (part(k1, n1, k1 / n1) + part(k0, n0, k0 / n0) - part(k1, n1, both) - part(k0, n0, both)) > X.EVIDENCE:
            chosen.add(f)
    chosen |= set(swap)
    index = {f: k for k, f in enumerate(sorted(chosen, key=repr))}
    x = np.zeros((len(texts), len(index)))
    z = np.zeros_like(x)  # the counterfactuals
    mentions = np.array([any(w in swap for w in ws) for ws in words])
    for r, (s, ws) in enumerate(zip(sets, words)):
        for f in s & chosen:
            x[r, index[f]] = 1
        if mentions[r]:
            # an identity term has no beginnings, so that only words are swapped
            for f in {swap.get(f, f) if isinstance(f, str) else f for f in s} & chosen:
                z[r, index[f]] = 1
        else:
            z[r] = x[r]
    y = np.array(toxic, float)
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0)

    def loss(v):
        logit = x @ v[:-1] + v[-1]
        p = 1 / (1 + np.exp(-logit))
        change = (x - z) @ v[:-1]
        return -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + X.RIDGE / 2 * (v[:-1] ** 2).sum() + fairness / max(1, mentions.sum()) * (change**2).sum()

    def slope(v):
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        change = (x - z) @ v[:-1]
        g = x.T @ (share * (p - y)) + X.RIDGE * v[:-1] + 2 * fairness / max(1, mentions.sum()) * ((x - z).T @ change)
        return np.append(g, (share * (p - y)).sum())

    # the gradient is that of the loss
    at = np.random.default_rng(0).normal(0, 0.1, len(index) + 1)
    for k in range(0, len(at), max(1, len(at) // 7)):
        e = np.zeros(len(at))
        e[k] = 1e-5
        assert abs((loss(at + e) - loss(at - e)) / 2e-5 - slope(at)[k]) < 1e-6
    v, m, u = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, X.STEPS + 1):
        g = slope(v)
        m, u = 0.9 * m + 0.1 * g, 0.99 * u + 0.01 * g * g
        v = v - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8) * (1 - step / (X.STEPS + 1))
    return lambda t: float(sum(v[index[f]] for f in features(re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", (t or "").lower())) & chosen) + v[-1])


def test_scores_against_brute_force(spark):
    """Scores of the operator, and that of no evidence, against a dense classifier written down from the loss."""
    data = sample(random.Random(11), 240, True)
    rows = [(k, t) for k, (t, _) in enumerate(data)] + [(900, None), (901, ""), (902, "never seen words")]
    labels = spark.createDataFrame([(k, int(y)) for k, (_, y) in enumerate(data)], "doc_id bigint, toxic int")
    found = {r.doc_id: r.score for r in X.toxicity(frame(spark, rows, clashing=True), labels).collect()}
    logit = plain_fit([t for t, _ in data], [y for _, y in data], X.GROUPS, X.FAIRNESS)
    for i, t in rows:
        assert abs(found[i] - 1 / (1 + np.exp(-logit(t)))) < 2e-3, (i, found[i])
    assert found[900] == found[901] == found[902] and abs(found[900] - 1 / (1 + np.exp(-logit("")))) < 2e-3
