import gzip
import hashlib
import re
import time
from html.parser import HTMLParser

import duckdb

from blockmill.llm import queries, warc
from tests.helpers import DATA


def parse(data):
    """Records of a WARC file: (fields, block)"""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields.get("Content-Length", 0))
        out.append((fields, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    return out


def test_query_and_files(spark, tmp_path):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet'").fetchall()
    rows = queries.op1_warc_derivatives(spark, DATA)
    got = {(r.page_id, r.warc_type): r for r in rows.collect()}
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got.values()}) == len(got)
    for page, url, html in pages:
        meta, text = got[page, "metadata"], got[page, "conversion"]
        assert meta.refers_to == text.refers_to and meta.target_uri == text.target_uri == url
        assert meta.payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert "http-status-line: HTTP/1.1 200 OK" in meta.block and "http-header-Content-Type: text/html" in meta.block
        assert text.block == warc.plain_text(html) and "<" not in text.block
        for r in (meta, text):
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", r.record_id)
            assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
            assert r.content_length == len(r.block.encode())
    out = str(tmp_path / "warc")
    warc.write_warc(rows, out)
    files = sorted((tmp_path / "warc").glob("*.gz"))
    read = [x for f in files for x in parse(gzip.decompress(f.read_bytes()))]
    assert len(read) == len(got)
    for fields, block in read:
        assert "sha256:" + hashlib.sha256(block).hexdigest() == fields["WARC-Block-Digest"]


def test_plain_text():
    page = "<head><title>t</title></head><p>a &lt;b&gt;\n c<br>d<script>x<p></script>e<!-- n --><i>f</i> &eacute;<style>"
    assert warc.plain_text(page) == "a <b> c\nd e f é"
    assert warc.plain_text(None) == warc.plain_text("") == ""


def test_plain_text_of_elements_left_open():
    head = "<html><head><meta charset=utf-8><title>t <b> u</title><script>'</head><p>'</script><link rel=x>"
    for start in ("<body class=a>", "", "<BODY>"):
        assert warc.plain_text(f"{head}{start}<p>seen</p><div>too") == "seen\ntoo"
        assert warc.plain_text(f"{head}</head>{start}<p>seen</p><div>too") == "seen\ntoo"
    assert warc.plain_text(f"{head}seen <p>too") == "seen\ntoo"
    assert warc.plain_text("<header>a</header><p>b") == "a\nb"
    assert warc.plain_text("<p>a<svg width=1 />b</p>c<svg><text>x</text></svg>d") == "ab\nc d".replace("ab", "a b")
    assert warc.plain_text("<p>a<template>b<noscript>c") == "abc"
    assert warc.plain_text("<p>a<script>b</p>c") == "a"


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "http://a\r\nWARC-Type: x", ""), (None, "u", "p")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, header string")
    got = warc.derive(warc.responses_of_pages(df)).collect()
    assert len(got) == 8
    assert all(r.header.count("WARC-Type: ") == 1 + ("http" in (r.target_uri or "")) for r in got)
    assert all("\r\nWARC-Type: x" not in r.header for r in got)
    assert {r.block for r in got if r.warc_type == "conversion"} == {"", "p"}
    ids = [r.derived_id for r in got if r.page_id == 1]
    assert len(set(ids)) == 2
    bare = spark.createDataFrame([(None, None, None, None, None)], "record_id string, target_uri string, warc_date string, http_headers string, payload string")
    assert [r.refers_to is not None for r in warc.derive(bare).collect()] == [True, True]
    assert warc.derive(warc.responses_of_pages(df.limit(0))).count() == 0


class Reader(HTMLParser):
    """Text by a parser that shares nothing with the operator; for pages that close what they open."""

    HIDDEN = ("head", "script", "style", "template", "noscript", "svg")

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        self.cut(tag)

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        self.cut(tag)

    def cut(self, tag):
        if tag in warc._LINE_ENDS:
            self.out.append(None)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def text(self):
        lines = [[]]
        for piece in self.out:
            if piece is None:
                lines.append([])
            else:
                lines[-1].append(piece)
        return "\n".join(x for x in (" ".join("".join(line).split()) for line in lines) if x)


def test_text_equals_that_of_another_parser(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{DATA.replace('0.001', '0.01')}/pages.parquet'").fetchall()
    for page, html in pages:
        assert warc.plain_text(html) == Reader(html).text(), page


def test_quoted_attributes_and_stray_signs():
    assert warc.plain_text("<p title='a>b' x=\"c>d\">x</p>") == "x"
    assert warc.plain_text("a < b <3 c <") == "a < b <3 c <"
    assert warc.plain_text("<p>it's<b>so</b>") == "it'sso"
    # A quote that stays open is none.
    assert warc.plain_text("<p title='a>seen<b c=\"d>e</b>f</p>") == "seenef"
    assert warc.plain_text("<!doctype html><p>a<!-- b > c --><br/>d<!-- e") == "a\nd"


def test_what_is_left_open_takes_time_in_proportion():
    for piece in ("<head>", "<noscript>", "<template>", "<head><title>", "<svg>", "<!", "<a '", "<a '>\"", "</head><head>", "<"):
        started = time.perf_counter()
        warc.plain_text(piece * 150_000 + ">x")
        assert time.perf_counter() - started < 8, piece


def test_digests_of_a_response_are_kept(spark):
    rows = [("a", "p", "sha1:OWN"), ("b", "p", None)]
    df = spark.createDataFrame(
        [(i, "u", "2024-01-01T00:00:00Z", "", p, d) for i, p, d in rows],
        "record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string",
    )
    got = {(r.refers_to, r.warc_type): r for r in warc.derive(df).collect()}
    worked_out = "sha256:" + hashlib.sha256(b"p").hexdigest()
    for i, want in (("a", "sha1:OWN"), ("b", worked_out)):
        assert got[i, "metadata"].payload_digest == got[i, "conversion"].payload_digest == want
        assert f"payload-digest: {want}" in got[i, "metadata"].block
        assert f"WARC-Source-Payload-Digest: {want}" in got[i, "conversion"].header
