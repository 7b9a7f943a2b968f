import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import blobs
from inkstone.llm import text as T
from inkstone.llm.succinct import EliasFano, Packed, search

from .common import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\n.ß-", max_size=40)), max_size=12)


@settings(deadline=None, max_examples=100)
@given(TEXTS)
def test_words_are_the_expression_s(texts):
    w = T.words(pa.array(texts, pa.string()))
    assert np.diff(w.bounds).tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    by_word = {}
    for x, h in zip(flat, w.hashes.tolist()):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


@settings(deadline=None, max_examples=60)
@given(TEXTS, st.integers(1, 4))
def test_grams_and_sets(texts, n):
    w = T.words(pa.array(texts, pa.string()))
    g, bounds = T.grams(w.hashes, w.bounds, n)
    values, cuts = T.unit_sets(g, bounds)
    for i, t in enumerate(texts):
        x = words(t)
        runs = [tuple(x[k : k + n]) for k in range(max(1, len(x) - n + 1))] if x else []
        assert bounds[i + 1] - bounds[i] == len(runs)
        own = values[cuts[i] : cuts[i + 1]]
        assert len(own) == len(set(runs)) and (np.diff(own.astype(object)) > 0).all()
    ids = T.set_hash(values, cuts)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (ids[i] == ids[j]) == (a == b)


def test_long_words_slices_and_sliced_arrays():
    texts = ["a" * 100, "a" * 100 + "b", "x " * 10, None, "é" * 70]
    array = pa.array(["skip", *texts])[1:]
    w = T.words(array)
    assert np.diff(w.bounds).tolist() == [1, 1, 10, 0, 1] and len(set(w.hashes.tolist())) == 4
    batch = pa.RecordBatch.from_arrays([array], ["text"])
    parts = list(T.slices(iter([batch]), "text", 50))
    assert sum(p.num_rows for p in parts) == 5 and [t for p in parts for t in p.column(0).to_pylist()] == texts


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=30))
def test_blobs(values):
    a = np.array(values, np.int64)
    b = -a
    x, y = blobs.unpack(blobs.pack(a, b))
    assert x.view(np.int64).tolist() == a.tolist() and y.view(np.int64).tolist() == b.tolist()
    back = {s: blobs.unpack(d)[0].view(np.int64).tolist() for s, d in blobs.split(a % 3, a)}
    assert back == {s: [v for v in a.tolist() if v % 3 == s] for s in set((a % 3).tolist())}


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), max_size=20))
def test_elias_fano(values, others):
    v = np.sort(np.array(values, np.uint64))
    ef = EliasFano.decode(np.frombuffer(EliasFano.encode(v), np.uint8))
    assert ef[np.arange(len(v))].tolist() == v.tolist()
    once = np.unique(v)
    ef = EliasFano.decode(np.frombuffer(EliasFano.encode(once), np.uint8))
    asked = np.array(values + others, np.uint64)
    place, found = ef.find(asked)
    assert found.tolist() == [x in set(values) for x in asked.tolist()]
    assert [once[p] for p, f in zip(place, found) if f] == [x for x, f in zip(asked.tolist(), found) if f]


def test_elias_fano_dense_and_packed_search():
    v = np.cumsum(np.random.default_rng(1).integers(0, 3, 5000)).astype(np.uint64)
    ef = EliasFano.decode(np.frombuffer(EliasFano.encode(v), np.uint8))
    assert (ef[np.arange(5000)] == v).all()
    p = Packed.decode(np.frombuffer(Packed.encode(v, 17), np.uint8))
    assert (p[np.arange(5000)] == v).all()
    at, found = search(p, np.zeros(3, np.int64), np.full(3, 5000), np.array([0, v[77], 10**6], np.uint64))
    assert at.tolist() == [0, int(np.searchsorted(v, v[77])), 5000] and found.tolist() == [v[0] == 0, True, False]


def test_files_of_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    """Read whole, kept up to a bound, and gone with their folder; the same bytes as where they are mapped."""
    import numpy as np

    from inkstone.llm import shared as S

    uri = f"file://{tmp_path}/some"
    for k in range(5):
        S.put(f"{uri}/{k}", np.arange(100 + k).tobytes())
    mapped = [np.array(S.mapped(f"{uri}/{k}")) for k in range(5)]
    monkeypatch.setattr(S, "local", lambda u: None)
    monkeypatch.setattr(S, "KEPT_BYTES", 2000)
    for k in (0, 1, 2, 3, 4, 0):
        assert (S.mapped(f"{uri}/{k}") == mapped[k]).all() and sum(x.nbytes for x in S._read.values()) <= 2000
    assert list(S._read) == [f"{uri}/4", f"{uri}/0"]
    S.put(f"{uri}/more/9", b"12345678")
    assert bytes(S.existing(f"{uri}/more/9")) == b"12345678" and not len(S.existing(f"{uri}/none"))
    S.remove(uri)
    assert not (tmp_path / "some").exists()
    S.remove(uri)  # again: nothing
