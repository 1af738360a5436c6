"""Derived WARC records: from each response one metadata and one conversion record.

Both name the response they come from: ``WARC-Refers-To`` is its record id, and
target, date and payload digest are carried over. The metadata record's block is
``application/warc-fields``: the response's HTTP status line and headers, one
``http-...`` field each, with the lengths and digests of what was captured. The
conversion record's block is the page as plain text. Record ids are made from the
response's id and the kind of record, so that building them again gives the same
records. All but the text conversion are built-in functions; rows never move.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from blockmill.llm.tables import text_of

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Given to responses without a date of their own.
CAPTURED = "2024-01-01T00:00:00Z"

# A quoted value may hold ">". Possessive, so that a tag is read once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"']*+)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>")
#: Their contents are never text; the first two run to the end of a page that doesn't
#: close them, of the others only the tag is left out then.
_TO_THE_END, _IF_CLOSED = ("script", "style"), ("template", "noscript", "svg")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_TO_THE_END, *_IF_CLOSED)}
#: What may stand in a head that isn't closed.
_IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "template", "title"}
_LINE_ENDS = set(
    "address article aside blockquote body br caption center dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_SPACE = re.compile(r"\s+")


def _tokens(page: str) -> list[tuple[str, str]]:
    """``("", text)``, and ``(name, "")`` or ``("/name", "")`` for tags; comments and
    unseen elements are a space. Each character is looked at a bounded number of times:
    what was once looked for in vain is not looked for again."""
    out, at, last = [], 0, page.rfind(">")
    quotes, lost = True, set()
    while True:
        start = page.find("<", at)
        if start < 0 or start > last:
            # An open comment hides the rest also where nothing is closed any more.
            comment = page.find("<!--", at)
            out.append(("", page[at:] if comment < 0 else page[at:comment]))
            return out
        if start > at:
            out.append(("", page[at:start]))
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            out.append(("", " "))
            if end < 0:
                return out
            at = end + 3
            continue
        if page[start + 1] in "!?":
            at = page.index(">", start) + 1
            continue
        tag = _TAG.match(page, start) if quotes else None
        if tag is None:
            tag = _BARE_TAG.match(page, start)
            if tag is None:
                out.append(("", "<"))
                at = start + 1
                continue
            # A quote stays open to the end of the page: none is heeded from here on.
            quotes = False
        slash, name, at = tag[1], tag[2].lower(), tag.end()
        if name == "svg" and page[at - 2] == "/":
            out.append(("", " "))
            continue
        if not slash and name in _CLOSING:
            close = None if name in lost else _CLOSING[name].search(page, at)
            if close or name in _TO_THE_END:
                out.append(("", " "))
                if close is None:
                    return out
                at = close.end()
                continue
            lost.add(name)
        out.append((slash + name, ""))


def _next_of(tokens: list[tuple[str, str]], name: str) -> Callable[[int], int]:
    """Where the next tag of a name is at or after a token; the number of tokens if nowhere."""
    places = [i for i, (tag, _) in enumerate(tokens) if tag == name]
    return lambda i: places[k] if (k := bisect_left(places, i)) < len(places) else len(tokens)


def plain_text(page: str | None) -> str:
    """Text of a whole page: no scripts, styles, head or comments, one line per
    block, character references decoded, white space within a line made one space.

    A head ends at its closing tag, or where a body begins before that (or there is
    none) at the first thing that cannot be in a head. Takes time in proportion to the
    page, whatever is left open in it."""
    tokens = _tokens(page or "")
    head_end, body, title_end = (_next_of(tokens, name) for name in ("/head", "body", "/title"))
    out, i = [], 0
    while i < len(tokens):
        tag, text = tokens[i]
        i += 1
        if tag == "head":
            out.append(" ")
            if head_end(i) < body(i):
                i = head_end(i) + 1
            while i < len(tokens) and (tokens[i][0].lstrip("/") in _IN_HEAD or (not tokens[i][0] and tokens[i][1].isspace())):
                i = (title_end(i) if tokens[i][0] == "title" and title_end(i) < len(tokens) else i) + 1
        elif tag:
            out.append("\n" if tag.lstrip("/") in _LINE_ENDS else "")
        else:
            out.append(_SPACE.sub(" ", text))
    lines = (" ".join(html.unescape(line).split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(StringType())
def _plain_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([plain_text(p) for p in pages], dtype=object)


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A ``urn:uuid:`` from what identifies a record: equal parts, equal id."""
    # Lengths keep neighbouring parts apart; null differs from the empty text.
    told = [F.concat_ws(":", F.length(p).cast("string"), p) for p in (p.cast("string") for p in parts)]
    h = F.sha2(F.concat_ws("|", *told), 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.ascii(F.substring(h, 17, 1)), F.lit(4)) + 1, F.lit(1))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def responses_of_pages(pages: DataFrame, date: str = CAPTURED) -> DataFrame:
    """Response records of ``pages(page_id, url, html)``: ``page_id, record_id,
    target_uri, warc_date, http_headers, payload``. A null page is an empty
    payload; equal rows are the same record."""
    payload = text_of("html")
    headers = F.concat_ws(
        CRLF,
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    )
    return pages.select(
        "page_id",
        record_id(F.col("page_id"), F.col("url"), F.lit(date), payload).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def _field(name: str, value: Column) -> Column:
    """A named field, null (and so left out) where the value is null or empty.
    Line breaks in a value would start a field of their own."""
    value = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.when(value != "", F.concat(F.lit(f"{name}: "), value))


def derive(responses: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response.

    Adds to the columns of ``responses`` (clashing ones are replaced):
    ``warc_type, derived_id, refers_to, content_type, block, block_digest,
    payload_digest, content_length, header``. Two rows for each one; fields
    whose value is null or empty are left out of the headers; a null payload is
    an empty one. A ``payload_digest`` that a response brings is kept, else it is
    worked out. A response without a record id is given one from its target,
    date and payload.
    """
    payload = text_of("payload")
    headers = text_of("http_headers")
    source_id = F.coalesce("record_id", record_id(F.col("target_uri"), F.col("warc_date"), payload))
    source_digest = digest(payload)
    if "payload_digest" in responses.columns:
        source_digest = F.coalesce(F.col("payload_digest").cast("string"), source_digest)
    lines = F.filter(F.split(headers, "\r?\n"), lambda x: x != "")
    named = F.transform(
        lines,
        lambda x, i: F.when(i == 0, F.concat(F.lit("http-status-line: "), x)).otherwise(F.concat(F.lit("http-header-"), x)),
    )
    fields = F.concat_ws(
        CRLF,
        _field("via-record", source_id),
        _field("source-uri", F.col("target_uri")),
        _field("source-date", F.col("warc_date")),
        named,
        _field("payload-length", F.octet_length(payload)),
        _field("payload-digest", source_digest),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), F.concat(fields, F.lit(CRLF)).alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("_plain").alias("block")),
    )
    read = responses.withColumn("_plain", _plain_texts(payload)).withColumn("_record", F.explode(kinds))
    record = read.withColumns(
        {
            "warc_type": F.col("_record.kind"),
            "derived_id": record_id(source_id, F.col("_record.kind")),
            "refers_to": source_id,
            "content_type": F.col("_record.type"),
            "block": F.col("_record.block"),
            "block_digest": digest(F.col("_record.block")),
            "payload_digest": source_digest,
            "content_length": F.octet_length(F.col("_record.block")).cast("long"),
        }
    )
    header = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        _field("WARC-Type", F.col("warc_type")),
        _field("WARC-Record-ID", F.col("derived_id")),
        _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Date", F.col("warc_date")),
        _field("WARC-Source-Payload-Digest", F.col("payload_digest")),
        _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")),
        _field("Content-Length", F.col("content_length")),
    )
    return record.withColumn("header", header).drop("_plain", "_record")


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``header`` and ``block`` of each row as WARC files, one per partition,
    through Spark's own writer (any store Spark reaches, gzip per file)."""
    whole = F.concat(F.col("header"), F.lit(CRLF + CRLF), F.col("block")).alias("value")
    # Two line ends close a record, as the format asks.
    records.select(whole).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
