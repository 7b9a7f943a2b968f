import math
from collections import Counter

from inkstone.llm import language as M

from .common import corpus, frame, got, words

D = M.DISCOUNT
STEP = M._FLOOR / (2**M.BITS - 2)


class Exact:
    """The same model from dictionaries of words, without quantisation."""

    def __init__(self, texts):
        seqs = [["<s>", *w, "</s>"] for t in texts if (w := words(t))]
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for s in seqs:
            self.one.update(s)
            self.two.update(zip(s, s[1:]))
            self.three.update(zip(s, s[1:], s[2:]))
        self.after = Counter(a for a, _ in self.two)
        self.kinds, self.follow = Counter(k[:2] for k in self.three), Counter()
        for k, n in self.three.items():
            self.follow[k[:2]] += n
        self.total = sum(n for w, n in self.one.items() if w != "<s>")

    def p1(self, w):
        return (self.one[w] + 1) / (self.total + len(self.one) + 1)

    def p2(self, a, b):
        if not self.one[a] or not self.after[a]:
            return self.p1(b)
        return max(0, self.two[a, b] - D) / self.one[a] + D * self.after[a] / self.one[a] * self.p1(b)

    def p3(self, a, b, c):
        if not self.follow[a, b]:
            return self.p2(b, c)
        return max(0, self.three[a, b, c] - D) / self.follow[a, b] + D * self.kinds[a, b] / self.follow[a, b] * self.p2(b, c)

    def score(self, text):
        s = ["<s>", *words(text), "</s>"]
        if len(s) == 2:
            return 0, None
        return len(s) - 1, math.log(self.p2(*s[:2])) + sum(math.log(self.p3(*k)) for k in zip(s, s[1:], s[2:]))


def compare(found, rows, exact):
    assert len(found) == len(rows)
    for (i, t), r in zip(sorted(rows, key=lambda r: (repr(r[0]), r[1] or "")), found):
        n, want = exact.score(t)
        assert (r[0], r[1]) == (i, n)
        if n:
            assert abs(r[2] - want) <= n * STEP * 1.5 and math.isclose(r[3], math.exp(-r[2] / n), rel_tol=1e-4)
        else:
            assert r[2] is None and r[3] is None


def test_against_an_exact_model(spark, monkeypatch):
    from inkstone.llm import text as T

    rows = [(k, t) for k, (_, t) in enumerate(corpus(12))] + [(None, "w1x w2x")]
    docs = frame(spark, rows, clashing=True)
    exact = Exact([t for _, t in rows])
    model = M.train(docs)
    assert model.size == len(exact.one) and model.total == exact.total
    compare(got(M.score(docs, model)), rows, exact)
    monkeypatch.setattr(T, "SLICE_BYTES", 100)
    compare(got(M.score(docs, model)), rows, exact)
    new = [(1, "w1x w2x unknown w1x w1x"), (2, "quite new words"), (3, None), (4, "w3x")]
    compare(got(M.score(frame(spark, new), model)), new, exact)


def test_probabilities_add_up():
    exact = Exact(["a b a c", "b c"])
    for a, b in (("a", "b"), ("<s>", "a"), ("b", "c")):
        everything = sum(exact.p3(a, b, w) for w in exact.one) + exact.p3(a, b, "?") * 1
        assert everything > 0.99


def test_words_beyond_32_bits():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (5, 1 << 33, 1 << 45):
        a, b = rng.integers(0, top, 500), rng.integers(0, top, 500)
        a[:50], b[:50] = a[50:100], b[50:100]
        key = M.together(a, b)
        assert sorted(zip(a.tolist(), b.tolist())) == [(int(a[i]), int(b[i])) for i in np.lexsort((np.arange(500), key))] and len(np.unique(key)) == len(set(zip(a.tolist(), b.tolist())))
    # a trie of such words
    base = 1 << 40
    a, b, c = (np.array(x) + base for x in ([1, 1, 2], [5, 5, 6], [7, 8, 7]))
    data, contexts, successors = M.Trie.encode(a, b, c, base + 99, lambda x: np.full(len(x), 4))
    trie = M.Trie.decode(np.frombuffer(data, np.uint8))
    place, found = trie.pairs(np.array([1, 2, 2]) + base, np.array([5, 6, 5]) + base)
    assert found.tolist() == [True, True, False] and trie.triples(place[:2], np.array([8, 7]) + base)[1].tolist() == [True, True]


def test_quantiser():
    import numpy as np

    p = np.exp(-np.linspace(0, 30, 500))
    assert np.abs(np.log(M.restore(M.quantise(p))) - np.log(p)).max() <= STEP / 2 + 1e-9
    assert M.restore(M.quantise(np.zeros(1)))[0] == 0


def test_empty(spark):
    for rows in ([], [(1, None), (2, "")]):
        docs = frame(spark, rows)
        assert got(M.score(docs, M.train(docs))) == [(i, 0, None, None) for i, _ in rows]
