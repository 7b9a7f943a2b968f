"""Inputs that every operator must handle: nulls in any column, empty and very long texts, ties, repeated rows, an empty
table, and other columns whose names clash with those that operators use."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "score double, keep boolean, line int, shard int, n bigint, count bigint, fate string, nth int, new_text string, kind int, head string"
_EXTRA = (0.5, True, 3, 7, 9, 11, "a", 2, "b", 4, "c")


def words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7F])+", (text or "").lower())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}x" for _ in range(n))


def corpus(seed=1, n=40):
    """(doc_id, text) with near and exact copies, shared lines, repeats, ties, nulls, empty and very long texts."""
    rng = random.Random(seed)
    texts = ["\n".join(prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    for i in range(0, n - 8, 5):  # near copies
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        texts[i + 1] = " ".join(w)
    texts[7], texts[12] = texts[2], texts[2]
    texts[13] += "\n" + texts[4].split("\n")[0]
    texts[20] = prose(rng, 5000) + "\n" + "z" * 20000
    texts += ["", "\n\n", "one", "one two", "one two", "ünïcode Straße ÉÈ", "... !!!"]
    rows = list(enumerate(texts))
    rows += [(3, texts[3]), (3, texts[3]), (None, texts[1]), (None, None), (900, None), (901, texts[20])]
    return rows


def frame(spark, rows, clashing=False):
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if k % 5 == 0 or t is None else len(t)) for k, (i, t) in enumerate(rows)]
    if clashing:
        return spark.createDataFrame([(*r, *_EXTRA) for r in full], f"{SCHEMA}, {CLASHING}").repartition(3)
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)
