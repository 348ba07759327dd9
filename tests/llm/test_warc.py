import gzip
import json
import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from blockloom.llm import warc

PAGE = "<!DOCTYPE html><html lang='de'><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t='</p>';</script><p>One<b>two</b></p><!-- gone --><ul><li>x</li><li>y&nbsp;z</li></ul><a href=\"/u?a=1&amp;b=2\">link</a></body></html>"


def test_text():
    assert warc.plain_text(PAGE) == "Onetwo\nx\ny z\nlink"
    assert warc.plain_text("") == "" and warc.plain_text("a < b <br>c") == "a < b\nc"
    assert warc.plain_text("x<script>never closed") == "x"


def test_derivatives_keep_ids_headers_and_digests():
    data = warc.response_record(7, "http://h/x", PAGE, "2020-01-02T03:04:05Z")
    headers, block = warc.parse(data)
    source = dict(headers)
    assert source["WARC-Block-Digest"] == warc.digest(block) and int(source["Content-Length"]) == len(block)
    made = warc.derive(*warc.parse(gzip.compress(data)))
    for kind in ("metadata", "conversion"):
        h, body = warc.parse(made[kind])
        d = dict(h)
        assert d["WARC-Type"] == kind and d["WARC-Refers-To"] == source["WARC-Record-ID"] and d["WARC-Record-ID"] == made[f"{kind}_id"]
        assert d["WARC-Target-URI"] == "http://h/x" and d["WARC-Date"] == "2020-01-02T03:04:05Z" and d["WARC-Block-Digest"] == warc.digest(body)
    about = json.loads(warc.parse(made["metadata"])[1])
    assert about["source"]["warc-headers"] == [list(x) for x in headers] and about["html"] == {"title": "A & B", "lang": "de", "links": ["/u?a=1&b=2"]}
    assert about["payload"]["digest"] == about["payload"]["computed-digest"] == warc.digest(PAGE.encode())
    assert warc.parse(made["conversion"])[1].decode() == warc.plain_text(PAGE) and dict(warc.parse(made["conversion"])[0])["WARC-Source-Payload-Digest"] == about["payload"]["digest"]


def test_rows(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (2, None, None), (None, "http://b/", ""), (3, "http://c/", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = warc.derive_pages(pages).collect()
    assert len(got) == 5 and len({r.response_id for r in got}) == 4 and {r.http_status for r in got} == {200}
    by = {r.page_id: r for r in got}
    assert by[2].text == "" and len(by[3].text) == 300_000
    responses = spark.createDataFrame([(r[0], warc.response_record(*r)) for r in rows] + [(9, None), (8, warc.record("request", [], b"x"))], "page_id long, record binary")
    assert sorted(map(str, warc.derive_records(responses).collect())) == sorted(map(str, got))
    files = warc.save(warc.derive_pages(pages), f"file://{tmp_path}", "conversion").collect()
    whole = b"".join(gzip.decompress(open(f.path[7:], "rb").read()) for f in files)
    assert sum(f.n_records for f in files) == 5 and whole.count(b"WARC/1.0\r\n") == 5
    assert warc.derive_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse(b"nothing")


class Plain(HTMLParser):
    """The same rules on the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden, self.title, self.lang, self.links, self.in_title = [], [], None, None, [], False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.hidden and self.hidden[-1] != "head":
            return
        self.tag(tag)
        if tag in ("script", "style", "template", "noscript", "svg", "head"):
            self.hidden.append(tag)
        if tag == "a" and attrs.get("href") is not None:
            self.links.append(attrs["href"])
        if tag == "html" and attrs.get("lang"):
            self.lang = attrs["lang"]
        self.in_title = tag == "title"

    def handle_startendtag(self, tag, attrs):
        self.tag(tag)

    def tag(self, tag):
        if not self.hidden and tag in ("script", "style", "template", "noscript", "svg"):
            self.parts.append(" ")
        if not self.hidden:
            self.parts.append("\n" if tag in warc._BREAKS else " " if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        self.in_title = False
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        elif not self.hidden:
            self.tag(tag)

    def handle_comment(self, data):
        self.parts.append("" if self.hidden else " ")

    def handle_data(self, data):
        if self.in_title and self.title is None:
            self.title = " ".join(data.split())
        if not self.hidden:
            self.parts.append(data)


def by_library(page):
    p = Plain()
    p.feed(page)
    p.close()
    lines = [" ".join(re.split(r"[ \t\r\f\v\xa0]+", x)).strip(" ") for x in "".join(p.parts).split("\n")]
    return "\n".join(x for x in lines if x), p.title, p.lang, p.links


def test_against_the_standard_library():
    r = random.Random(3)
    words = ["one", "zwei", "a &amp; b", "1 &lt; 2", "&eacute;t&#233;", "x\ty", "&nbsp;", "naïve"]
    inner = ["<b>{}</b>", "<p>{}</p>", "<div class='a>b'>{}</div>", "<li>{}", "{}<br/>{}", "<td>{}</td><td>{}</td>", "<!-- {} <p> -->", "<script>var a = '<p>{}</p>';</script>", "<style>p{{}}</style>", "<a href=\"/u?a=1&amp;b={}\">{}</a>", "<a title='x > y' href='/v'>{}</a>", "<svg><text>{}</text></svg>", "<noscript>{}</noscript>", "<H2>{}</H2>", "{} < {}", "<img alt=\"a > b\" src=x>{}"]
    for _ in range(300):
        body = " ".join(r.choice(inner).replace("{}", r.choice(words)) for _ in range(r.randrange(1, 12)))
        page = f"<!DOCTYPE html><html lang=\"de\"><head><title>T {r.choice(words)}</title><style>a{{}}</style></head><body>{body}</body></html>"
        got = warc.read(page)
        assert (got.text, got.title, got.lang, got.links) == by_library(page), page


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_pages_against_the_standard_library(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        got = warc.read(page or "")
        assert (got.text, got.title, got.lang, got.links) == by_library(page or "")


def test_hostile_pages_take_linear_time():
    unit = ["<svg>", "<a ", "<!--", "<title>", "<a href=\"", "<a =\">\"", "<head>", "<script", "</", "<p ='", "&#1", "&#" + "9" * 40, "<", "\n ", "<html lang", "<!-- -->", "<a href=x>", "<title></title>", "</svg", "= \"", "<b a= '>'"]
    for u in unit:
        for tail in ("", ">", "\"", "</title>", "\">"):
            page = u * (1_000_000 // len(u)) + tail
            began = time.process_time()
            warc.read(page)
            assert time.process_time() - began < 2.5, (u, tail)  # about a third on an idle machine


def test_bad_records_are_rows(spark):
    good = warc.response_record(1, "http://h/", PAGE)
    bad = [b"nothing", good.replace(b"Content-Length: ", b"Content-Length: x", 1), good[:-40], gzip.compress(good)[:-30], b"\x1f\x8bxx", b"WARC/1.0\r\nA: b", b"", good + b"rest"]
    big = good.replace(b"WARC-Date", b"Content-Length: 99999999999999999999999\r\nWARC-Date")
    rows = [(i, x) for i, x in enumerate([*bad, big, good, good + good, gzip.compress(good) + gzip.compress(warc.record("request", [], b"x")) + gzip.compress(good)])]
    got = warc.derive_records(spark.createDataFrame([(i, bytearray(x), "x") for i, x in rows], "page_id long, record binary, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.page_id, []).append(r.status)
        assert (r.metadata is None) == (r.status != "ok")
    assert all("ok" not in found[i] and len(found[i]) == 1 for i in [*range(7), 8]) and found[7] == ["ok", "not a WARC record"]
    assert found[9] == ["ok"] and found[10] == ["ok"] * 2 and found[11] == ["ok"] * 2
