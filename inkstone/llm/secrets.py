"""Operator 1, secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at the hits, and the
checksum that the format embeds.

One pass over the corpus without a shuffle. Each Arrow batch goes through one automaton of all rules' keywords; only
where a keyword occurs is that rule's expression tried, anchored at the keyword; only a match whose checksum holds is
reported. A text without a keyword never meets an expression.

An account or card number may stand up to ``NEAR`` characters after its keyword, or after the number before it. At each
place where one can begin, every length that ends with a group of digits or capitals is tried until the checksum holds:
of an account the length its country prescribes, of a card its issuer's first. A card number without a keyword counts
if it has a prefix and a length that an issuer uses and is written whole or in the usual groups; the prefixes are its
keywords.

``checksum`` says what was tested: ``valid`` for a checksum that holds, ``format`` for a header that decodes, where the
format embeds no checksum, ``none`` for the pattern alone.

Defined results: a null or empty text has no findings; a null ``doc_id`` is reported as null; repeated rows are reported
each; very long texts are scanned whole; an empty table gives an empty result; other columns of the input are ignored.
A secret itself is never in the result, only its place, length and SHA-256.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

SCHEMA = "doc_id bigint, rule string, start bigint, length int, checksum string, sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("checksum", pa.string()), ("sha256", pa.string())])
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits, as access tokens embed it."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def crc62_ok(secret: str) -> bool:
    body = secret.partition("_")[2]
    return crc62(body[:-6]) == body[-6:]


def luhn_ok(secret: str) -> bool:
    digits = [int(c) for c in secret if c.isdigit()][::-1]
    return len(set(digits)) > 1 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def issuer_lengths(secret: str) -> tuple[int, ...]:
    """How many digits the card numbers with this prefix have, the usual length first; none if no issuer has it."""
    n = int("".join(c for c in secret if c.isdigit())[:4])
    if 4000 <= n <= 4999:
        return 16, 19, 13
    if 5100 <= n <= 5599 or 2221 <= n <= 2720:
        return (16,)
    if n // 100 in (34, 37):
        return (15,)
    if n // 100 in (36, 38, 39) or 3000 <= n <= 3059 or n == 3095:
        return 14, 16, 19
    if 3528 <= n <= 3589 or n == 6011 or 6440 <= n <= 6599 or 6200 <= n <= 6299 or 2200 <= n <= 2204:
        return 16, 19, 18, 17
    return ()


def card_lengths(secret: str) -> list[int]:
    return list(dict.fromkeys([*issuer_lengths(secret), *range(19, 12, -1)]))


def issued_ok(secret: str) -> bool:
    return sum(c.isdigit() for c in secret) in issuer_lengths(secret) and luhn_ok(secret)


_IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 "
        "GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 "
        "OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def iban_lengths(secret: str) -> list[int]:
    return [_IBAN_LENGTHS[secret[:2]]] if secret[:2] in _IBAN_LENGTHS else list(range(35, 11, -1))


def mod97_ok(secret: str) -> bool:
    s = re.sub(r"\s", "", secret).upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def jwt_ok(secret: str) -> bool:
    """The header is base64url JSON with an algorithm; the format has no checksum of its own."""
    import base64
    import json

    try:
        head = json.loads(base64.urlsafe_b64decode(secret.split(".")[0] + "=="))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried at the start of each keyword's occurrence; its group ``s`` is the secret. With ``lengths``, the
    lengths to try, ``head`` is tried there instead, and ``value`` from its end on."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: Callable[[str], bool] | None = None
    head: str = ""
    value: str = ""
    lengths: Callable[[str], Iterable[int]] | None = None


NEAR = 64
_LONGEST = 48  # of a value with its separators


def near(name: str, keywords: tuple[str, ...], head: str, value: str, check: Callable[[str], bool], lengths: Callable[[str], Iterable[int]]) -> Rule:
    return Rule(name, keywords, rf"{head}[\s\S]{{1,{NEAR}}}?{value}", check, head, value, lengths)


_ASSIGN = r"['\"]?\s*(?:=|:|=>|:=)\s*['\"]?"
_END = r"(?![0-9A-Za-z_\-])"
_ISSUERS = ("4", *map(str, range(51, 56)), *map(str, range(22, 28)), "30", *map(str, range(34, 40)), "60", "62", "64", "65")
_GROUPS = r"[0-9]{13,19}|[0-9]{4}(?P<a>[ -])[0-9]{4}(?P=a)[0-9]{4}(?P=a)[0-9]{1,4}(?:(?P=a)[0-9]{1,3})?|[0-9]{4}(?P<b>[ -])[0-9]{6}(?P=b)[0-9]{4,5}"
_BARE = rf"(?<![\w+])(?<![0-9][.,:/\-])(?P<s>{_GROUPS})(?!\w)"
RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rf"(?P<s>gh[pousr]_[0-9A-Za-z]{{36}}){_END}", crc62_ok),
    Rule("npm_token", ("npm_",), rf"(?P<s>npm_[0-9A-Za-z]{{36}}){_END}", crc62_ok),
    Rule("jwt", ("eyj",), rf"(?P<s>eyJ[0-9A-Za-z_\-]{{8,}}\.eyJ[0-9A-Za-z_\-]{{4,}}\.[0-9A-Za-z_\-]{{8,}}){_END}", jwt_ok),
    near("iban", ("iban",), r"(?i:ibans?(?![a-z]))", r"(?<![0-9A-Za-z])(?P<s>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)" + _END, mod97_ok, iban_lengths),
    near("card_number", ("card", "visa", "pan"), r"(?i:(?:card|visa|pan)(?:s|[ _-]?(?:number|no|nr))?(?![a-z]))", r"(?<![\dA-Za-z])(?P<s>\d(?:[ -]?\d){12,18})(?!\d)", luhn_ok, card_lengths),
    Rule("card_number", _ISSUERS, _BARE, issued_ok, "", _BARE, issuer_lengths),
    Rule("aws_access_key", ("akia", "asia"), rf"(?P<s>A(?:KIA|SIA)[A-Z2-7]{{16}}){_END}"),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rf"(?P<s>xox[baprs]-[0-9A-Za-z\-]{{10,250}}){_END}"),
    Rule("stripe_key", ("sk_live_", "rk_live_"), rf"(?P<s>[sr]k_live_[0-9A-Za-z]{{16,247}}){_END}"),
    Rule("google_api_key", ("aiza",), rf"(?P<s>AIza[0-9A-Za-z_\-]{{35}}){_END}"),
    Rule("private_key", ("-----begin ",), r"(?P<s>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[0-9A-Za-z+/=\s]{32,}?-----END (?:[A-Z]+ )*PRIVATE KEY-----)"),
    Rule("assigned_hex", ("token", "secret", "api_key", "apikey", "passwd", "password"), rf"(?i:token|secret|api_?key|passwd|password){_ASSIGN}(?P<s>[0-9A-Fa-f]{{32,128}}){_END}"),
)


def candidates(secret: str, lengths: Iterable[int]) -> Iterator[str]:
    """The beginnings of ``secret`` that have one of these lengths, separators not counted, and end where a group ends."""
    ends, n = {}, 0
    for k, c in enumerate(secret, 1):
        if c.isalnum():
            n += 1
            if k == len(secret) or not secret[k].isalnum():
                ends[n] = k
    for n in lengths:
        if n in ends:
            yield secret[: ends[n]]


def values(text: str, at: int, rule: Rule, value: re.Pattern) -> Iterator[tuple[int, str]]:
    """(start, secret) of the values that begin at most ``NEAR`` characters after ``at`` or after the value before."""
    limit = at + NEAR
    while (m := value.search(text, at, limit + _LONGEST)) and m.start() <= limit:
        at = m.start() + 1
        for secret in candidates(m["s"], rule.lengths(m["s"])):
            if rule.check(secret):
                yield m.start(), secret
                at = m.start() + len(secret)
                limit = at + NEAR
                break


def scan(text: str | None, automaton: ahocorasick.Automaton, rules: tuple[tuple[Rule, re.Pattern, re.Pattern], ...]) -> Iterator[tuple[str, int, str, str]]:
    """(rule, start, secret, checksum) of every finding, in order of start and rule."""
    if not text:
        return
    found = set()
    for end, (n, which) in automaton.iter(text.encode().lower().decode()):
        for r in which:
            rule, head, value = rules[r]
            if not (m := head.match(text, end - n + 1)):
                continue
            if rule.head:
                found.update((start, rule.name, secret, "valid") for start, secret in values(text, m.end(), rule, value))
                continue
            some = candidates(m["s"], rule.lengths(m["s"])) if rule.lengths else (m["s"],)
            if secret := next((x for x in some if rule.check is None or rule.check(x)), None):
                found.add((m.start("s"), rule.name, secret, "none" if rule.check is None else "format" if rule.check is jwt_ok else "valid"))
    for start, name, secret, checksum in sorted(found):
        yield name, start, secret, checksum


def prepared(rules: tuple[Rule, ...]) -> tuple[ahocorasick.Automaton, tuple[tuple[Rule, re.Pattern, re.Pattern], ...]]:
    by_word: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for k in rule.keywords:
            by_word.setdefault(k, []).append(i)
    automaton = ahocorasick.Automaton()
    for k, which in by_word.items():
        automaton.add_word(k, (len(k), tuple(which)))
    automaton.make_automaton()
    return automaton, tuple((r, re.compile(r.head or r.pattern), re.compile(r.value)) for r in rules)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every secret of every text of ``docs(doc_id, text)``; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, compiled = prepared(rules)
        for batch in T.slices(batches, "text"):
            rows = [
                (doc, name, start, len(secret), checksum, hashlib.sha256(secret.encode()).hexdigest())
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for name, start, secret, checksum in scan(text, automaton, compiled)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
