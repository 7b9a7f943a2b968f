import random
import re

from inkstone.llm import packing as P

from .common import corpus, frame, got


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time; the oldest of equally tight sequences."""
    free, held = [], []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        i = min(fits, key=lambda i: (free[i], i)) if fits else len(free)
        if i == len(free):
            free.append(capacity)
            held.append([])
        free[i] -= n
        held[i].append(n)
    return held


def size(text):
    return len(re.findall(rf"\S{{1,{P.UNIT_CHARS}}}", text or "", re.A)) + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.randrange(1, 40)
        counts = {n: rng.randrange(1, 12) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, min(capacity, 12) + 1))}
        bins = {}
        for n, a, b, first, each, offset in P.plan(counts, capacity):
            for r in range(a, b):
                bins.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * n, n))
        assert [[n for _, n in sorted(bins[i])] for i in range(len(bins))] == best_fit([n for n, k in counts.items() for _ in range(k)], capacity)


def test_documents_take_the_slots(spark):
    rows = corpus(10) * 2
    for capacity in (16, 200):
        found = P.best_fit_packing(frame(spark, rows, clashing=True), capacity).collect()
        want = []
        for i, t in rows:
            n = size(t)
            want += [(i, k, k * capacity, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))] if n > 1 else []
        assert sorted((tuple(r)[:4] for r in found), key=repr) == sorted(want, key=repr)
        bins = {}
        for r in found:
            bins.setdefault(r.bin, []).append((r.offset, r.length))
        for held in bins.values():
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(sorted(n for _, n in b) for b in bins.values()) == sorted(sorted(b) for b in best_fit([w[3] for w in want], capacity))


def test_empty(spark):
    assert got(P.best_fit_packing(frame(spark, [(1, None), (2, "")]))) == [] and got(P.best_fit_packing(frame(spark, []))) == []
    found = P.best_fit_packing(frame(spark, [(1, "x" * 100_000)])).collect()  # no space in it, and cut all the same
    assert sum(r.length for r in found) == 6251 and max(r.length for r in found) <= P.CAPACITY
