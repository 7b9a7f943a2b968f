import numpy as np
import pytest

from inkstone.llm import chat as C

from .common import got

if not __import__("os").path.exists(C.TOKENIZER):
    pytest.skip("no tokenizer", allow_module_level=True)

ROWS = [
    (1, 0, "system", "Be brief."), (1, 2, "assistant", "Zwölf Äpfel — naïve 日本語 🙂!"), (1, 1, "user", "How many <|assistant|> apples?"), (1, 2, "assistant", "a tie"), (1, 2, "assistant", "a tie"),
    (2, None, None, None), (2, 0, "assistant", None), (2, 1, "assistant", ""), (3, 0, "user", "x " * 60_000), (3, 1, "assistant", "y" * 5000), (4, 0, "robot", "?"), (None, 0, "user", "nobody's"), (5, None, "assistant", "\n\n  spaced\n"),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, mask string, turns int"


def test_against_brute_force(spark):
    found = {r.conv_id: r for r in C.format_chats(spark.createDataFrame([(*r, "m", 1) for r in ROWS], SCHEMA).repartition(3)).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    order = lambda x: (x is not None, x)
    encoder = C.tokenizer(C.TOKENIZER)
    for conv, r in found.items():
        turns = sorted((x[1:] for x in ROWS if x[0] == conv), key=lambda x: tuple(map(order, x)))
        trained, text = [], ""
        for _, role, said in turns:
            head, body = f"<|{role if role in C.ROLES else 'unknown'}|>\n", (said or "") + C.END
            trained += [False] * len(head) + [role == "assistant"] * len(body)
            text += head + body
        code = encoder.encode(text, add_special_tokens=False)
        assert r.token_ids == code.ids and encoder.decode(code.ids) == text
        assert r["mask"] == [int(any(trained[a:b])) for a, b in code.offsets]
        assert (r.n_tokens, r.n_trained) == (len(code.ids), sum(r["mask"]))
    assert found[4].n_trained == 0


def test_mask_edges():
    spans = np.array([(2, 4), (4, 6), (9, 12)])
    tokens = np.array([(0, 2), (1, 3), (3, 5), (5, 5), (6, 9), (8, 20), (12, 13)])
    assert C.mask(tokens, spans).tolist() == [0, 1, 1, 0, 0, 1, 0]
    assert C.mask(tokens, np.zeros((0, 2), int)).tolist() == [0] * 7 and len(C.mask(np.zeros((0, 2), int), spans)) == 0


def test_empty(spark):
    assert got(C.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))) == []
