import collections

import numpy as np
import pyarrow as pa

from inkstone.llm import quality as Q

from .common import SCHEMA, corpus, frame, got


def units(text):
    import re

    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_against_brute_force(spark):
    rows = corpus(3)
    rows = [(i, t + " &&& ### | " * 30 if t and i and i % 6 == 5 else t) for i, t in rows]
    marks = [(i, int(i % 6 != 5), 0) for i in range(0, 30)] + [(4, 0, 0), (None, 1, 0), (6, None, None), (7777, 1, 0), (8, 1, 0), (8, 1, 1)]
    found = got(Q.quality_rules(frame(spark, rows, clashing=True), labels(spark, marks)))
    worst = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, 1))
    trusted = {i for i, q in worst.items() if q == 1}
    # Buckets of each feature, taken from the operator one text at a time; counts and scores by hand.
    own = [Q.features(pa.array([t], pa.string()))[0] for _, t in rows]
    raw, target = collections.Counter(), collections.Counter()
    for (i, t), v in zip(rows, own):
        assert len(v) == max(0, 2 * len(units(t)) - 1)
        raw.update(v.tolist())
        if i in trusted:
            target.update(v.tolist())
    n, m = sum(raw.values()), sum(target.values())
    score = lambda v: np.mean([np.log((target[b] + 1) / (m + Q.BUCKETS)) - np.log((raw[b] + 1) / (n + Q.BUCKETS)) for b in v.tolist()]) if len(v) else 0.0
    want = sorted(((i, round(float(score(v)), 6) + 0.0) for (i, t), v in zip(rows, own)), key=repr)
    assert len(found) == len(want)
    for f, w in zip(sorted(found, key=lambda r: (repr(r[0]), r[1])), sorted(want, key=lambda r: (repr(r[0]), r[1]))):
        assert f[0] == w[0] and abs(f[1] - w[1]) < 2e-6 and f[2] == (f[1] >= Q.THRESHOLD)
    bad = {r[0] for r in found if not r[2]}
    assert {i for i, t in rows if t and "&&&" in t} <= bad


def test_stage_keeps_columns_and_edges(spark):
    docs = frame(spark, corpus(4), clashing=True)
    kept = Q.kept(docs, labels(spark, []))
    assert kept.columns == docs.columns and got(kept) == got(docs)  # nothing is trusted: all scores are 0
    empty = frame(spark, [])
    assert got(Q.quality_rules(empty, labels(spark, [(1, 1, 0)]))) == [] and Q.kept(empty, labels(spark, [])).schema == spark.createDataFrame([], SCHEMA).schema


def test_stutter_is_one_feature():
    a, _ = Q.features(pa.array(["der der der"]))
    b, _ = Q.features(pa.array(["und und und"]))
    assert a[3] == a[4] == b[3] == b[4] and a[0] != b[0]


def test_features_by_a_second_computation():
    """Units and pairs, one at a time: each is a bucket, equal ones the same, pairs of equal units one feature, and few of
    the others meet."""
    texts = ["The cat -- the dog!! the the", "b a b a", "", None, "x", "ünï --- ünï"]
    values, bounds = Q.features(pa.array(texts, pa.string()), 1 << 40)
    bucket, back = {}, {}
    for k, t in enumerate(texts):
        own, u = values[bounds[k] : bounds[k + 1]].tolist(), units(t)
        pairs = [("pair", "same") if a == b else ("pair", a, b) for a, b in zip(u, u[1:])]
        assert len(own) == len(u) + len(pairs)
        for name, v in zip([("unit", x) for x in u] + pairs, own):
            assert bucket.setdefault(name, v) == v and back.setdefault(v, name) == name
    assert ("pair", "b", "a") in bucket and bucket["pair", "b", "a"] != bucket["pair", "a", "b"] and bucket["unit", "The"] != bucket["unit", "the"]
