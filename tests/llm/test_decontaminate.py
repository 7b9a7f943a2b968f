import random

import numpy as np

from inkstone.llm import decontaminate as D

from .common import corpus, frame, got, words


def brute(rows, items, least=D.MIN_WORDS):
    out = set()
    for i, t in rows:
        w = words(t)
        for j, s in items:
            x = words(s)
            for a in range(len(x)):
                for b in range(len(w)):
                    if a and b and x[a - 1] == w[b - 1]:
                        continue
                    n = 0
                    while a + n < len(x) and b + n < len(w) and x[a + n] == w[b + n]:
                        n += 1
                    if n >= min(least, len(x)):
                        out.add((i, j, a, b, n))
    return sorted(out, key=repr)


def items_frame(spark, items):
    return spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, shard int")


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, t if t is None or len(t) < 3000 else t[:900]) for i, t in corpus(8)]
    some = [t for _, t in rows if t and len(words(t)) > 30]
    items = [(k, " ".join(words(t)[4 : 4 + rng.randrange(8, 26)])) for k, t in enumerate(some[:6])]
    items += [(50, "one two"), (51, " ".join(words(some[0])[:6])), (52, "nowhere " + " ".join(words(some[1])[3:20]) + " else"), (None, items[0][1]), (53, None), (54, ""), items[0]]
    rows += [(700, f"clean, {items[1][1].upper()}!"), (701, items[2][1] + " and once more " + items[2][1]), (702, " ".join(["again"] * 40)), (703, " ".join(["again"] * 12))]
    items.append((55, " ".join(["again"] * 14)))
    want = brute(rows, items)
    items.append((56, "Just these three"))
    rows.append((704, "he wrote just these three, and no more"))
    want = brute(rows, items)
    assert {700, 701, 702, 704} <= {r[0] for r in want} and {r[0] for r in want if r[1] == 50}
    assert got(D.benchmark_matches(frame(spark, rows, clashing=True), items_frame(spark, items))) == want
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    out = D.decontaminated(frame(spark, rows, clashing=True), items_frame(spark, items))
    dirty = {t for i, t in rows if t and brute([(i, t)], items)}
    assert got(out.select("doc_id", "text")) == sorted([r for r in rows if r[1] not in dirty], key=repr)


def test_empty(spark):
    docs, none = frame(spark, corpus(9)), items_frame(spark, [])
    assert got(D.benchmark_matches(docs, none)) == [] and got(D.decontaminated(docs, none)) == got(docs)
    assert got(D.benchmark_matches(frame(spark, []), items_frame(spark, [(1, "a b c d e f g h i j k")]))) == []


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, k, depth in ((200, 3, 40), (300, 2, 300), (50, 1, 10), (1, 1, 1), (400, 5, 3)):
        x = rng.integers(0, k + 1, n)
        sa = D.suffix_array(x, depth)
        ends = [next((j for j in range(i, n) if not x[j]), n) for i in range(n)]  # what follows the end of a document has no order
        cut = [tuple(x[i : min(i + depth, ends[i])]) for i in sa]
        assert sorted(sa.tolist()) == np.flatnonzero(x > 0).tolist() and cut == sorted(cut)
