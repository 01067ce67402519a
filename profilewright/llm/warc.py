"""WARC derivatives: each response gives a linked metadata record and a plain-text conversion record."""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The date given to records of pages, which carry none.
PAGE_DATE = "2024-01-01T00:00:00Z"
SOURCE_HEADERS = "WARC-Source-Headers"
RESPONSE_SCHEMA = "record_id string, target_uri string, warc_date string, http_headers string, payload string"
RECORD_SCHEMA = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, source_headers string, block string"
)

_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is not markup, and of those the ones whose content is no text either.
_RAW = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template", "svg")}
_NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9]*\b")
_TITLE_END, _HEAD_END = re.compile(r"(?i)</title\s*>"), re.compile(r"(?i)</head\s*>")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z-]+)""")
_HREF = re.compile(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"']+))""")
_LONG_NUMBER = re.compile(r"&#0*([0-9]{8,});?")
_CONTROL = re.compile(r"[\x00-\x1F\x7F\x85\u2028\u2029]+")


def pieces(page: str) -> Iterator[tuple[str, int, int]]:
    """``(name, start, end)`` of the markup of a page, in order: tags by lower-case name (with ``/`` where they end an element), and ``!`` for comments, declarations and elements whose content is no text, up to their end.

    A tag ends at its first ``>``; without one it is text. One pass: what was looked for in vain is not looked for again.
    """
    at, n, no_more = 0, len(page), False
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            yield "!", start, at
            continue
        name = _NAME.match(page, start + 1)
        if no_more or not (name or page.startswith(("<!", "<?"), start)):
            continue
        close = page.find(">", start + 1)
        if close < 0:
            no_more = True
            continue
        at = close + 1
        kind = name.group().lower() if name else "!"
        if kind in _RAW:
            end = _RAW[kind].search(page, at)
            at, kind = end.end() if end else n, "!"
        yield kind, start, at


def unescaped(text: str) -> str:
    """Entities resolved; numbers of more than seven digits stand for no character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def plain_text(page: str) -> str:
    """Text of an HTML page: a line for each stretch between block elements, blanks run together, entities resolved; the head has none."""
    out, at, head_end = [], 0, 0
    for name, start, end in pieces(page):
        if start < head_end or start < at:
            continue
        out.append(page[at:start])
        at = end
        if name == "head":
            found = _HEAD_END.search(page, end)
            at = head_end = found.end() if found else len(page)
        out.append("\n" if name.lstrip("/") in _BLOCKS else " " if name in ("!", "head") else "")
    out.append(page[at:])
    lines = (" ".join(line.split()) for line in unescaped("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    """``sha1:`` and the base32 digest, as WARC files label blocks and payloads."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A urn:uuid made of the parts, so that reruns give the same records."""
    h = hashlib.md5("\x00".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def folded(value: str) -> str:
    """On one line: control characters, which would begin another field, become blanks."""
    return _CONTROL.sub(" ", value).strip()


def page_metadata(page: str) -> list[tuple[str, str]]:
    """Title, language and links; those of comments and scripts don't count."""
    title = lang = None
    links = []
    for name, start, end in pieces(page):
        if name == "title" and title is None:
            found = _TITLE_END.search(page, end)
            title = " ".join(unescaped(page[end : found.start()]).split()) if found else ""
        elif name == "html" and lang is None:
            lang = _LANG.search(page, start, end)
        elif name == "a" and (href := _HREF.search(page, start, end - 1)):
            links.append(("outlink", unescaped(next((x for x in href.groups() if x is not None), ""))))
    return ([("title", title)] if title else []) + ([("language", lang.group(1).lower())] if lang else []) + links


def derive(response: dict) -> list[dict]:
    """The two records of a response."""
    source, uri, date, headers = (response[k] or "" for k in ("record_id", "target_uri", "warc_date", "http_headers"))
    payload = response["payload"] or ""
    raw = payload.encode("utf-8", "surrogatepass")
    payload_digest = digest(raw)
    kept = [line.partition(":") for line in headers.replace("\r\n", "\n").split("\n")[1:] if ":" in line]
    fields = [("payload-digest", payload_digest), ("payload-length", str(len(raw)))] + [(f"source-{k.strip().lower()}", v.strip()) for k, _, v in kept] + page_metadata(payload)
    fields = [(folded(k), folded(v)) for k, v in fields]
    blocks = (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain; charset=utf-8", plain_text(payload)))
    out = []
    for kind, content_type, block in blocks:
        data = block.encode("utf-8", "surrogatepass")
        out.append({"warc_type": kind, "record_id": record_id(source, kind), "refers_to": source, "target_uri": uri, "warc_date": date, "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "payload_digest": payload_digest, "source_headers": headers, "block": block})
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows (``RECORD_SCHEMA``) for each row of ``responses`` (``RESPONSE_SCHEMA``; other columns are dropped).

    Both refer to the response's record by ``refers_to`` and carry its target, date, HTTP headers and payload digest; the metadata record
    also lists them, with title, language and links, as warc-fields, each on one line. Their ids follow from the response's.
    Nulls count as empty; an empty payload gives an empty conversion; repeated responses give repeated records. Rows are handled
    where they lie, in time that grows with their length, whatever the markup.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in range(0, len(frame), 256):
                found = [r for response in frame.iloc[i : i + 256].to_dict("records") for r in derive({k: None if v is None or v != v else v for k, v in response.items()})]
                yield pd.DataFrame(found, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])

    wanted = [c.split()[0] for c in RESPONSE_SCHEMA.split(", ")]
    return responses.select(*wanted).mapInPandas(rows, RECORD_SCHEMA)


def responses_of_pages(pages: DataFrame, date: str = PAGE_DATE) -> DataFrame:
    """Response records of ``page_id, url, html``; the record id follows from page_id and url."""
    h = F.md5(F.concat_ws("|", F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    cut = lambda i, n: F.substring(h, i, n)
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def serialized(records: DataFrame) -> DataFrame:
    """``record_id, record``: each record as the lines of a WARC file. The HTTP headers of the source stand in one extension field, with ``\\`` before r, n and itself for line ends and backslashes; other control characters become blanks."""
    def header(name: str, value: Column) -> Column:
        line = F.trim(F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0A-\x1F\x7F]+", " "))
        return F.when(line != "", F.concat(F.lit(name + ": "), line, F.lit("\r\n"))).otherwise("")

    escaped = F.replace(F.replace(F.replace(F.col("source_headers"), F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = [F.coalesce(header(n, F.col(c)), F.lit("")) for n, c in names] + [F.coalesce(header(SOURCE_HEADERS, escaped), F.lit(""))]
    return records.select("record_id", F.concat(F.lit("WARC/1.0\r\n"), *head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def source_headers(value: str) -> str:
    """The HTTP headers that ``serialized`` wrote in one field."""
    return re.sub(r"\\(.)", lambda m: {"r": "\r", "n": "\n"}.get(m.group(1), m.group(1)), value)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of a WARC file; the reverse of ``serialized``, for small files and tests."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        out.append((headers, block))
        at = end + 4 + len(block) + 4
    return out


def op6_warc_derivatives(spark, sf_dir):
    return derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
