import base64
import gzip
import hashlib
import json
import random
import time
from pathlib import Path

import pytest

from inkstone.llm import warc as W

from .common import got

PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head>
<body><!-- hidden <p> --><nav><a href="/x?a=1&amp;b=2">Go</a> <a href='y'>to</a><a href=z>Z</a></nav><h1>Head&nbsp;line</h1><p>One   two<br>three &lt;four&gt; 1 < 2</p><script>never closed"""
ROWS = [(1, "http://a.example/", PAGE), (2, None, None), (3, "http://b.example/é", ""), (None, "http://c.example/", "plain"), (1, "http://a.example/", PAGE), (5, "u", "<p>" + "long " * 100_000)]


def records(spark, rows):
    return W.build(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, headers string, content int").repartition(2))


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_links_digests_and_text(spark):
    found = records(spark, ROWS).collect()
    assert len(found) == 2 * len(ROWS)
    by = {(r.page_id, r.record_type): r for r in found}
    for i, url, page in ROWS:
        meta, text = by[i, "metadata"], by[i, "conversion"]
        headers, block = W.response(url, page)
        body = (page or "").encode()
        assert meta.refers_to == text.refers_to == headers["WARC-Record-ID"] and meta.target_uri == text.target_uri == (url or "about:blank")
        assert meta.payload_digest == text.payload_digest == sha1(body) == headers["WARC-Payload-Digest"]
        said = json.loads(meta.content)
        assert said["envelope"]["warc-headers"] == [list(h) for h in headers.items()] and ["Content-Length", str(len(body))] in said["envelope"]["http-headers"]
        assert said["conversion"] == {"record-id": text.record_id, "digest": sha1(text.content.encode()), "length": text.content_length}
        for r in (meta, text):
            assert r.block_digest == sha1(r.content.encode()) and r.content_length == len(r.content.encode()) and json.loads(r.headers)["WARC-Refers-To"] == r.refers_to
    assert by[1, "conversion"].content == "Go toZ\nHead line\nOne two\nthree <four> 1 < 2"
    assert json.loads(by[1, "metadata"].content)["html"] == {"title": "A & B", "lang": "en", "links": ["/x?a=1&b=2", "y", "z"]}
    assert by[2, "conversion"].content == by[3, "conversion"].content == "" and by[None, "conversion"].content == "plain"
    assert len({r.record_id for r in found}) == 2 * len(ROWS) - 2  # the repeated row repeats its records


def test_files_round_trip(spark):
    built = records(spark, ROWS[:4])
    data = b"".join(gzip.decompress(r.warc) for r in W.warc_files(built).collect())
    back = sorted((dict(h)["WARC-Record-ID"], block.decode()) for h, block in W.parse(data))
    assert back == sorted((r.record_id, r.content) for r in built.collect())
    h, block = W.response("u", PAGE)
    assert list(W.parse(W.serialise(h, block) * 2)) == [(list(h.items()), block)] * 2


def test_empty(spark):
    assert got(records(spark, [])) == []


def by_hand(page):
    """Text, title, language and links by a second reading, a character at a time, of pages whose markup closes."""
    import html

    hidden, raw = ("script", "style", "noscript", "template", "svg", "head"), ("script", "style", "template")
    block = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article nav header footer aside main blockquote pre title hr dl dt dd form figure".split()
    out, links, title, lang, i = "", [], None, None, 0
    inside = None  # the hidden element that the place is in
    in_title = ""
    while i < len(page):
        if page[i : i + 4] == "<!--":
            i = page.index("-->", i) + 3
            out += "" if inside else " "
            continue
        if page[i] == "<" and (page[i + 1 : i + 2] in ("/", "!") or page[i + 1 : i + 2].isalpha()):
            j = page.index(">", i) + 1
            tag, i = page[i:j], j
            closing = tag[1] == "/"
            name = ""
            for c in tag[1 + closing : -1]:
                if c in " /\n":
                    break
                name += c.lower()
            attributes = {}
            rest = tag[1 + closing + len(name) : -1]
            while "=" in rest:
                key, rest = rest.split("=", 1)
                rest = rest.lstrip()
                if rest[:1] in "\"'" and rest:
                    value, rest = rest[1:].split(rest[0], 1)
                else:
                    value = rest.split()[0] if rest.split() else ""
                    rest = rest[len(value) :]
                attributes.setdefault(key.split()[-1].lower(), value)
            if name in raw and not closing:
                end = page.lower().index(f"</{name}", i)
                i = page.index(">", end) + 1
                out += "" if inside else " "
                continue
            if name == "html" and not closing and lang is None:
                lang = attributes.get("lang")
            if name == "a" and not closing and "href" in attributes:
                links.append(html.unescape(attributes["href"]))
            if name == "title" and not closing and title is None:
                end = page.lower().index("</title", i)
                in_title = page[i:end]
                title = " ".join(html.unescape(in_title).split())
            if name in hidden:
                if not closing and inside is None:
                    inside = name
                elif closing and inside == name:
                    inside = None
                    out += " "
                    continue
            if inside is None and name in block:
                out += "\n"
            continue
        if inside is None:
            out += page[i]
        i += 1
    lines = (" ".join(x.split()) for x in html.unescape(out).split("\n"))
    return "\n".join(x for x in lines if x), title, lang, links


def random_page(rng):
    word = lambda: rng.choice(["alpha", "b&amp;c", "&lt;x&gt;", "1 < 2", "é", "a > b", "&#233;", "&nbsp;", "the", "\n", "  "])
    some = lambda: " ".join(word() for _ in range(rng.randrange(0, 6)))

    def part(depth):
        kind = rng.randrange(9)
        if kind == 0 or depth > 4:
            return some()
        if kind == 1:
            return f"<!-- {some()} <p> -->"
        if kind == 2:
            name = rng.choice(["script", "STYLE", "template"])
            return f'<{name} type="x">if (a < b) {{ "<p>" }} {some().replace("<", "")}</{name}>'
        if kind == 3:
            q = rng.choice(['"', "'", ""])
            return f"<a class=k href={q}/p?a=1&amp;b={rng.randrange(99)}{q}>{part(depth + 1)}</a>"
        if kind == 4:
            return "<br/>" + some() + "<hr>"
        if kind == 5:
            return f"<noscript>{some()}<a href='/n'>n</a></noscript>"
        name = rng.choice(["p", "div", "span", "b", "H2", "li", "td", "article"])
        return f"<{name} id=z>{''.join(part(depth + 1) for _ in range(rng.randrange(0, 4)))}</{name}>"

    head = f"<head><title>{some().replace('<', '').replace('&lt;x&gt;', '')}</title><meta charset=utf-8></head>" if rng.random() < 0.7 else ""
    return f"<!DOCTYPE html><html lang={rng.choice(['en', 'fr'])}>{head}<body>{''.join(part(0) for _ in range(rng.randrange(0, 8)))}</body></html>"


def test_against_a_second_reading(spark, sf_dir):
    rng = random.Random(5)
    rows = [(k, f"http://h/{k}", random_page(rng)) for k in range(1500)]
    rows += [(10_000 + r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = {(r.page_id, r.record_type): r for r in records(spark, rows).collect()}
    assert len(found) == 2 * len(rows)
    for i, url, page in rows:
        text, title, lang, links = by_hand(page)
        meta, conversion = found[i, "metadata"], found[i, "conversion"]
        assert conversion.content == text, page
        assert json.loads(meta.content)["html"] == {"title": title, "lang": lang, "links": links}, page
        headers, block = W.response(url, page)
        assert meta.refers_to == conversion.refers_to == headers["WARC-Record-ID"] and meta.payload_digest == sha1(page.encode()) and conversion.block_digest == sha1(text.encode())


@pytest.mark.parametrize("unit", ["<a ", "<html ", "<title ", "<p ", "<title>", "<script ", "<!--", "</script ", "<a href='", '<a href="x" ', "&#1", "&", " ", "\n ", "<", "<head>", "href ", "<a href =", "</title "])
def test_hostile_markup_takes_linear_time(unit):
    page = "<title>t</title><a href=x>" + unit * ((1 << 20) // len(unit))
    began = time.process_time()
    W.derivatives(*W.response("u", page))
    assert time.process_time() - began < 4
    W.derivatives(*W.response("u", "&#" + "9" * 5000 + ";"))  # more digits than a number may have


def test_headers_and_charset():
    block = "HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX:tight\r\nLong: one\r\n two\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\u00e9".encode("latin-1")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>")]
    (_, meta), (h, text) = W.derivatives(headers, block)
    said = json.loads(meta)["envelope"]
    assert said["http-headers"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"], ["X", "tight"], ["Long", "one two"], ["Content-Type", "text/html; charset=iso-8859-1"]]
    assert said["warc-headers"] == [list(x) for x in headers] and h["WARC-Refers-To"] == "<urn:uuid:1>" and text.decode() == "caf\u00e9"
    for wrong in ("no-such", "base64", "utf-16"):
        assert W.derivatives(headers, block.replace(b"iso-8859-1", wrong.encode()))[1][1]


def test_files_of_responses(spark, tmp_path):
    whole = b"".join(gzip.compress(W.serialise(*W.response(url, page))) for _, url, page in ROWS[:4])
    other = W.serialise([("WARC-Type", "warcinfo"), ("Content-Length", "2")], b"hi") + W.serialise(*W.response("http://d/", "<p>d"))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc").write_bytes(other + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    Path(tmp_path / "c.txt").write_text("no warc")
    found = W.read_warc(spark, str(tmp_path))
    rows = found.collect()
    assert sorted((r.path.rpartition("/")[2], r.record, r.error is None) for r in rows) == [("a.warc.gz", k, True) for k in range(4)] + [("b.warc", k, k < 2) for k in range(3)]
    built = {(r.target_uri, r.record_type, r.record_id, r.content) for r in records(spark, ROWS[:4]).collect()}
    derived = {(r.target_uri, r.record_type, r.record_id, r.content) for r in W.derive(found).collect()}
    assert built < derived and len(derived) == len(built) + 2 and any(r[0] == "http://d/" and r[3] == "d" for r in derived)
