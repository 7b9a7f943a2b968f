import random
import re

from inkstone.llm import secrets as S

from .common import frame, got


def token(rng, prefix):
    body = "".join(rng.choice(S._BASE62) for _ in range(30))
    return f"{prefix}_{body}{S.crc62(body)}"


def brute(text):
    """Every rule's expression tried at every place of the text."""
    out = set()
    for rule in S.RULES:
        pattern = re.compile(rule.pattern)
        for i in range(len(text or "")):
            if (m := pattern.match(text, i)) and (rule.check is None or rule.check(m["s"])) and any(text[i : i + len(k)].lower() == k for k in rule.keywords):
                out.add((rule.name, m.start("s"), len(m["s"])))
    return out


def test_rules_and_edges(spark):
    rng = random.Random(5)
    good = [token(rng, p) for p in ("ghp", "ghs", "npm")]
    bad = good[0][:-1] + ("A" if good[0][-1] != "A" else "B")
    texts = [
        f"a {good[0]} b {good[1]}, {good[2]}", f"wrong checksum {bad}", f'TOKEN = "{"AB12" * 10}" token: {"0f" * 20}', "AKIA" + "A2B3" * 4, "card: 4111 1111 1111 1111 card 4111 1111 1111 1112",
        "IBAN DE89 3704 0044 0532 0130 00 and IBAN DE88 3704 0044 0532 0130 00", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abcdefgh12345678", "-----BEGIN RSA PRIVATE KEY-----\n" + "Q" * 64 + "\n-----END RSA PRIVATE KEY-----",
        "xoxb-123456789012-abcdef", "sk_live_" + "a1B2" * 6, "AIza" + "x" * 35, "İ tokens of ü ghp_short", "", "x" * 300_000 + " " + good[0],
    ]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[3]), (99, None)]
    found = got(S.secret_scan(frame(spark, rows, clashing=True)))
    want = sorted(((i, name, at, n) for i, t in rows for name, at, n in brute(t if t is None or len(t) < 1000 else "")), key=repr)
    assert sorted((r[:4] for r in found if r[0] != 13), key=repr) == want
    assert [r[1:4] for r in found if r[0] == 13] == [("github_token", 300_001, 40)]
    assert {r[1] for r in found} == {r.name for r in S.RULES}
    assert not [r for r in found if r[0] == 1]
    assert sum(r[0] == 0 for r in found) == 6  # a repeated row is reported again


def test_numbers_followed_by_more_and_away_from_the_keyword(spark):
    card, other, iban = "4111 1111 1111 1111", "5500-0000-0000-0004", "BE68 5390 0754 7034"
    want = {
        f"card {card} 12/25": [card], "card: 4111111111111111 123": ["4111111111111111"], f"IBAN {iban} BIC ABCDEFGH": [iban], f"card number is {card}": [card], f"visa card ending, {card} 2027": [card],
        f"Cards: {other}, {card}": [other, card], f"card exp 12/25 {card}": [card], f"IBAN of the firm: {iban}, or IBAN DE89370400440532013000 EUR": [iban, "DE89370400440532013000"],
        "maestro card 6304 0000 0000 0000": ["6304 0000 0000 0000"], "no keyword 378282246310005 here": ["378282246310005"], f"7536784127813050 {other}": [other],
        "card" + " x" * 40 + " 6304 0000 0000 0000": [], "no keyword 6304 0000 0000 0000": [], "0.4111111111111111": [], "4111111111111112": [], "41111111111111110000": [], "id a4111111111111111": [],
        f"IBAN {iban[:-1]}5 BIC ABCDEFGH": [], "pan 0000 0000 0000 0000": [],
    }
    found = {}
    for r in S.secret_scan(frame(spark, list(enumerate(want)))).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, (text, secrets) in enumerate(want.items()):
        assert [text[a : a + n] for a, n in sorted(found.get(i, []))] == secrets, text


def test_empty(spark):
    assert got(S.secret_scan(frame(spark, []))) == []
