"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is a row: its WARC headers, the HTTP head and the payload. Each gives two linked records: `metadata`
(application/warc-fields: what the response was, its digests, title and number of links) and `conversion` (text/plain:
the visible text). Both name the response in WARC-Refers-To and keep its target URI, date and payload digest."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.llm.storage import small_batches

RESPONSE = "source_id bigint, record_id string, target_uri string, warc_date string, http_head string, payload string, warc_headers array<struct<name:string,value:string>>"
RECORD = "source_id bigint, warc_type string, record_id string, refers_to string, target_uri string, headers array<struct<name:string,value:string>>, content_type string, content_length bigint, block string, block_digest string, payload_digest string"

#: Elements whose content isn't text of the page, and those of them that hold no tags and so end at their end tag only.
_HIDDEN, _RAW = {"script", "style", "template", "noscript"}, {"script", "style"}
#: Elements that may stand in a head; any other start tag, or text, ends it.
_IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "script", "style", "template", "head", "html"}
#: Elements that start and end a line.
_BLOCK = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside main blockquote pre hr title form dd dt dl figure figcaption".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"=\s*[\"']|>")
_HREF = re.compile(r"(?:^|[\s/\"'])href\s*=", re.I)
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


class Page:
    """Visible text, title (or None) and number of links of an HTML page, from one pass over its tags.

    Scripts, styles, templates, noscript and comments are left out, and so is a head, which ends at its end tag, at the
    first element that can't stand in it, or at text: its end tag may be missing. An end tag that never comes is looked for
    once only, so the time is proportional to the page whatever it holds. A tag that is never closed ends the page."""

    def __init__(self, page: str):
        self.page, self.title, self.links = page, None, 0
        self._parts: list[str] = []
        self._without: set[str] = set()
        self._head = False
        at = 0
        while (tag := page.find("<", at)) >= 0:
            self._text(page[at:tag])
            at = self._tag(tag)
        self._text(page[at:])
        self.text = _LINES.sub("\n", _SPACE.sub(" ", "".join(self._parts))).strip()

    def _text(self, text: str) -> None:
        if self._head and text and not text.isspace():
            self._head = False
        if text and not self._head:
            self._parts.append(html.unescape(text) if "&" in text else text)

    def _after(self, what: str, at: int, length: int) -> int:
        """The place behind the next `what`, or the page's end."""
        found = self.page.find(what, at)
        return found + length if found >= 0 else len(self.page)

    def _close(self, at: int) -> int:
        """The place of the > that ends a tag, outside quoted values; the page's length if there is none."""
        while (stop := _STOP.search(self.page, at)) is not None:
            if stop[0] == ">":
                return stop.start()
            quote = stop[0][-1]
            end = -1 if quote in self._without else self.page.find(quote, stop.end())
            if end < 0:
                self._without.add(quote)
            at = stop.end() if end < 0 else end + 1
        return len(self.page)

    def _end_tag(self, name: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the next end tag of that name."""
        if name in self._without:
            return None
        found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
        if found is None:
            self._without.add(name)
            return None
        return found.start(), self._close(found.end()) + 1

    def _tag(self, at: int) -> int:
        """Takes the tag at a < and returns the place behind it (and behind what it hides)."""
        page, start = self.page, page_at(self.page, at + 1)
        if start == "!" and page.startswith("<!--", at):
            return self._after("-->", at + 4, 3)
        if start and start in "!?":
            return self._after(">", at, 1)
        end = start == "/"
        name = _NAME.match(page, at + 1 + end)
        if name is None:
            if end:
                return self._after(">", at, 1)
            self._text("<")
            return at + 1
        word, close = name[0].lower(), self._close(name.end())
        behind = min(close + 1, len(page))
        if close == len(page):
            return behind
        if end:
            if word in ("head", "title") and self._head:
                self._head = word == "title"
            elif word in _BLOCK:
                self._text("\n")
            return behind
        if word == "head":
            self._head = True
        elif word not in _IN_HEAD:
            self._head = False
        if word == "a":
            self.links += _HREF.search(page, name.end(), close) is not None
        if word in _HIDDEN:
            found = self._end_tag(word, behind)
            self._text(" ")
            return found[1] if found else len(page) if word in _RAW else behind
        if word == "title" and (self._head or self.title is None):
            found = self._end_tag("title", behind)
            stop = found[0] if found else min(len(page), max(0, page.find("<", behind)) or len(page))
            if self.title is None:
                self.title = html.unescape(page[behind:stop])
            if self._head:
                return found[1] if found else stop
        if word in _BLOCK:
            self._text("\n")
        return behind


def page_at(page: str, at: int) -> str:
    return page[at : at + 1]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record's identifier from its content, so that a task that runs again gives the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def visible_text(page: str) -> str:
    """The text of a page (see Page)."""
    return Page(page).text


def _fields(pairs: list[tuple[str, str]]) -> str:
    """application/warc-fields; a value's line breaks become spaces."""
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in pairs)


def derive(source_id, rid: str | None, uri: str | None, date: str | None, head: str | None, payload: str | None, warc: list[dict] | None = None) -> list[tuple]:
    """The metadata and the conversion record of one response. A null identifier is made from the content; null
    headers are left out; a null payload is empty. Both records keep the response's HTTP headers, its other WARC headers
    and its digests; payload_digest is that of the source if it has one, else it is computed."""
    body = payload or ""
    raw = body.encode("utf-8", "surrogatepass")
    given = [(h["name"], h["value"]) for h in warc or [] if h and h["name"] and h["value"] is not None]
    paid = next((v for k, v in given if k.lower() == "warc-payload-digest"), None) or digest(raw)
    rid = rid or record_id("response", uri or "", head or "", paid)
    lines = [x for x in (head or "").replace("\r\n", "\n").split("\n") if x]
    status = lines[0] if lines else ""
    http = [tuple(p.strip() for p in x.split(":", 1)) for x in lines[1:] if ":" in x]
    page = Page(body)
    meta = [("response-status", status)] if status else []
    meta += [(f"source-{k.lower()}", v) for k, v in http]
    meta += [("payload-digest", paid), ("payload-length", str(len(raw)))]
    if page.title is not None:
        meta.append(("title", page.title))
    meta.append(("link-count", str(page.links)))
    kept = [(f"X-Source-{k}", v) for k, v in given if k.lower() not in ("warc-type", "warc-record-id", "content-length")]
    kept += [(f"X-Source-HTTP-{k}", v) for k, v in http]
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", _fields(meta)), ("conversion", "text/plain; charset=utf-8", page.text)):
        data = block.encode("utf-8", "surrogatepass")
        own = record_id(kind, rid, uri or "", paid)
        block_digest = digest(data)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", rid)]
        headers += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)] if uri is not None else []
        headers += [("WARC-Date", date), ("WARC-Refers-To-Date", date)] if date is not None else []
        headers += [("WARC-Block-Digest", block_digest), ("X-Source-Payload-Digest", paid), *kept, ("Content-Type", content), ("Content-Length", str(len(data)))]
        out.append((source_id, kind, own, rid, uri, [{"name": k, "value": v} for k, v in headers], content, len(data), block, block_digest, paid))
    return out


def serialise(headers: list[dict], block: str) -> bytes:
    """A record as it stands in a WARC file."""
    head = "WARC/1.1\r\n" + "".join(f"{h['name']}: {' '.join(h['value'].split())}\r\n" for h in headers)
    return head.encode() + b"\r\n" + block.encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def responses_of_pages(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of pages that were kept without their WARC and HTTP heads: status 200, text/html. The
    identifier is made from id, address and page, so wholly equal rows are one record that is there twice."""
    key = F.md5(F.concat_ws("\0", F.col(id_col).cast("string"), F.coalesce(url_col, F.lit("")), F.coalesce(html_col, F.lit(""))))
    part = lambda a, n: F.substring(key, a, n)
    rid = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(html_col), F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).cast("bigint").alias("source_id"), rid.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_head"), F.col(html_col).alias("payload"))


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records (columns of RECORD) for each row of responses (columns of RESPONSE, of which warc_headers may be missing;
    others are ignored), in the same task: nothing is shuffled. Repeated responses give repeated records, with the
    identifiers of the first; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [r for i in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True) for r in derive(*i)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    small_batches(responses.sparkSession)
    given = ["warc_headers"] if "warc_headers" in responses.columns else []
    return responses.select("source_id", "record_id", "target_uri", "warc_date", "http_head", "payload", *given).mapInArrow(run, RECORD)


_NAMES = ["source_id", "warc_type", "record_id", "refers_to", "target_uri", "headers", "content_type", "content_length", "block", "block_digest", "payload_digest"]
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_TYPES = [pa.int64(), *[pa.string()] * 4, _PAIRS, pa.string(), pa.int64(), *[pa.string()] * 3]


def warc_bytes(records: DataFrame) -> DataFrame:
    """source_id and `record`: each record's bytes, ready to be written one after another into WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [serialise(h, b) for h, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["source_id", "record"])

    return records.select("source_id", "headers", "block").mapInArrow(run, "source_id bigint, record binary")
