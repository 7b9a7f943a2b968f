from collections import Counter

import xxhash

from inkstone.llm import lines as L

from .common import corpus, frame, got, words


def marks(rows):
    """What tells each row from others of its id: 0 where there is none, else a hash of id and text."""
    several = Counter(i for i, _ in rows)
    return [0 if several[i] < 2 or i is None or t is None else (h := xxhash.xxh64_intdigest(t.encode(), i & (1 << 64) - 1)) - (h >> 63 << 64) for i, t in rows]


def brute(rows, t=L.THRESHOLD):
    """The lines that match one of a smaller (id, row, number), by comparing all pairs."""
    lines = [(i, r, k, frozenset(words(s))) for (i, text), r in zip(rows, marks(rows)) if i is not None and text is not None for k, s in enumerate(text.split("\n"))]
    lines = [x for x in lines if x[3]]
    gone = set()
    for i, r, k, s in lines:
        for j, q, m, z in lines:
            if (j, q, m) < (i, r, k) and len(s & z) >= t * len(s | z) - 1e-9:
                gone.add((i, r, k))
                break
    return gone


def cleaned(rows, gone):
    return [(i, t if i is None or t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (i, r, k) not in gone)) for (i, t), r in zip(rows, marks(rows))]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        found = L.line_dedup(frame(spark, rows, clashing=True))
        assert got(found.select("doc_id", "text")) == sorted(cleaned(rows, brute(rows)), key=repr)


def test_other_thresholds_and_slices(spark, monkeypatch):
    from inkstone.llm import text as T

    monkeypatch.setattr(L, "_PAIRS", 7)
    monkeypatch.setattr(T, "SLICE_BYTES", 64)
    rows = corpus(5, 25)
    for t in (0.5, 1.0):
        gone = set(map(tuple, L.Removed(frame(spark, rows), t).lines.collect()))
        assert gone == brute(rows, t)


def test_stage(spark):
    rows = corpus(6)
    docs = frame(spark, rows, clashing=True)
    out = L.deduped(docs)
    assert out.dtypes == docs.dtypes
    gone = brute(rows)
    want = [(i, new) for (i, old), (_, new) in zip(rows, cleaned(rows, gone)) if new is None or new or not old]
    assert got(out.select("doc_id", "text")) == sorted(want, key=repr)
    once = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
    changed = {i: len(new) for (i, old), (_, new) in zip(rows, cleaned(rows, gone)) if old != new and i in once}
    assert changed and all(r.n_chars == changed[r.doc_id] for r in out.collect() if r.doc_id in changed)
    assert got(L.line_dedup(frame(spark, []))) == [] and got(L.deduped(frame(spark, []))) == []


def test_rows_that_share_an_id(spark):
    """A line goes from the row that repeats another's, not from rows that only share its id."""
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon\nonly here one two"), (2, "quite another first line\nand a second"), (2, None), (3, "x y z")]
    kept = got(L.deduped(frame(spark, rows)).select("doc_id", "text"))
    assert kept == sorted([rows[0], (2, "only here one two"), *rows[2:]], key=repr)
