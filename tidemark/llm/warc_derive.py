"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

A record is a row with its serialised bytes, so reading, deriving and writing work on records alone.
For each response the builder makes

* a ``conversion`` record (text/plain) with the visible text of the page, and
* a ``metadata`` record (application/warc-fields) with what the text loses: title, language, outgoing
  links, HTTP status, the source's headers and its digests.

Both refer to the response by WARC-Refers-To, -Target-URI and -Date; a WARC-Refers-To that the response itself
has is kept as ``source-refers-to``. The digests of the response are copied, not taken anew, and are
verified first: a response whose block or payload differs from its digest is derived with
``digest-verified: no``.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .word_pool import slices

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # of responses built from a table without dates
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:warc")


@dataclass
class Record:
    """Named fields in order, and the block."""

    fields: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        name = name.lower()
        return next((v for k, v in self.fields if k.lower() == name), None)

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in [*self.fields, ("Content-Length", str(len(self.block)))])
        return f"{VERSION}\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """The record in ``raw``; folded field lines are joined, and the block is as long as stated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip())
        else:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    length = next((v for k, v in fields if k.lower() == "content-length"), None)
    if length is None or not length.isdigit() or int(length) > len(rest):
        raise ValueError("the block is shorter than stated")
    return Record([(k, v) for k, v in fields if k.lower() != "content-length"], rest[: int(length)])


def digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_id(*parts: str) -> str:
    """The same parts give the same id, so a repeated task writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def response(key: str, url: str | None, body: str | None, date: str = DATE) -> Record:
    """A response record for a fetched page; null url or body count as empty."""
    payload = (body or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", key, url or "")),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload)),
    ]
    return Record(fields, block)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], payload


def _unchunked(raw: bytes) -> bytes:
    """The content of a chunked body, as far as it goes; a body that is not chunked as it is."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        size = raw[at : max(end, at)].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return b"".join(out) if out else raw
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + n])
        at = end + 4 + n


def _inflated(raw: bytes, coding: str) -> bytes:
    """A gzip or deflate body unpacked, as far as it goes; other bytes as they are."""
    for bits in (31,) if coding in ("gzip", "x-gzip") else (15, -15):
        out, rest = [], raw
        while rest:
            packed = zlib.decompressobj(bits)
            try:
                for at in range(0, len(rest), 4096):
                    out.append(packed.decompress(rest[at : at + 4096]))
                    if packed.eof:
                        break
            except zlib.error:
                break
            rest = packed.unused_data + rest[at + 4096 :] if packed.eof else b""
        if any(out):
            return b"".join(out)
        if not rest and raw:
            return b""
    return raw


def content(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, bytes]:
    """The payload without its transfer codings, and that without its content codings.

    Bytes that are not in a stated coding, and codings other than chunked, gzip and deflate, stay.
    """
    stated = lambda name: [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",")]
    for coding in reversed(stated("transfer-encoding")):
        payload = _unchunked(payload) if coding == "chunked" else _inflated(payload, coding) if coding in ("gzip", "x-gzip", "deflate") else payload
    body = payload
    for coding in reversed(stated("content-encoding")):
        if coding not in ("gzip", "x-gzip", "deflate", "identity"):
            break
        body = _inflated(body, coding) if coding != "identity" else body
    return payload, body


_HEAD = re.compile(r"<head(?=[\s/>])[^>]*>", re.I)
_ELEMENT = re.compile(r"<(/?)([a-z][a-z0-9-]*)\b[^>]*>", re.I)
_END_TITLE = re.compile(r"</title\s*>", re.I)
_OF_HEAD = frozenset("html head title base basefont bgsound link meta noframes script style template noscript".split())
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|dl|dt|dd|form|hr|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<(?:[/a-zA-Z!?][^>]*)>")
_HIDING = {name: (re.compile(rf"<{name}\b[^>]*>", re.I), re.compile(rf"</{name}\s*>", re.I)) for name in ("script", "style", "template", "noscript", "title")}
_HTML = re.compile(r"<html\b[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def _uncommented(page: str) -> str:
    """A page without comments; one that stays open hides the rest."""
    out, at = [], 0
    while (start := page.find("<!--", at)) >= 0:
        out.append(page[at:start])
        end = page.find("-->", start + 4)
        at = len(page) if end < 0 else end + 3
    return "".join(out) + page[at:]


def _tagged(page: str) -> tuple[str, str]:
    """A page up to its last closing bracket, and the rest, which holds no tag. No pattern has to look for a bracket that is not there,
    so that each takes a time in proportion to the length of the page."""
    at = page.rfind(">") + 1
    return page[:at], page[at:]


def _without(page: str, name: str, to_end: bool) -> tuple[str, bool]:
    """A page without the elements of that name, and whether one stays open; that hides the rest, or nothing."""
    opening, closing = _HIDING[name]
    out, at = [], 0
    while start := opening.search(page, at):
        end = closing.search(page, start.end())
        if end is None and not to_end:
            break  # nor does any later one close
        out += [page[at : start.start()], " "]
        if end is None:
            return "".join(out), True
        at = end.end()
    return "".join(out) + page[at:], False


def _links(page: str) -> list[str]:
    found = (_HREF.search(tag[0]) for tag in _ANCHOR.finditer(_tagged(page)[0]))
    return [html.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def _title(page: str) -> str | None:
    start = _HIDING["title"][0].search(page)
    end = start and _END_TITLE.search(page, start.end())
    return page[start.end() : end.start()] if end else None


def _plain(marked: str) -> str:
    """Character references resolved, white space of each line as single spaces, empty lines gone."""
    lines = (" ".join(line.split()) for line in html.unescape(marked).split("\n"))
    return "\n".join(line for line in lines if line)


def _shown(page: str) -> str:
    """A page without comments, less scripts, styles and head. A head ends at its closing tag, or where a browser ends it: at
    the first text or tag of the body. A template or noscript that stays open hides nothing."""
    page, rest = _tagged(page)
    for name in ("script", "style", "template", "noscript"):
        page, stays_open = _without(page, name, name in ("script", "style"))
        rest = "" if stays_open else rest
    head = _HEAD.search(page)
    if head is None:
        return page + rest
    at = head.end()
    while tag := _ELEMENT.search(page, at):
        closing, name = bool(tag[1]), tag[2].lower()
        if page[at : tag.start()].strip():
            break
        if closing and name == "head":
            at = tag.end()
            break
        if name in ("body", "html", "br") if closing else name not in _OF_HEAD:
            at = tag.start()
            break
        at = tag.end()
        if name == "title" and not closing:
            end = _END_TITLE.search(page, at)
            at = end.end() if end else len(page)
    return f"{page[: head.start()]} {page[at:]}{rest}"


def visible_text(page: str) -> str:
    """The text of a page: a line for each block, without scripts, styles, head and comments."""
    shown, rest = _tagged(_shown(_uncommented(page)).replace("\r", " ").replace("\n", " "))
    return _plain(_TAG.sub("", _BREAK.sub("\n", shown)) + rest)


def derive(source: Record) -> list[Record]:
    """The conversion and the metadata record of a response; other records have none."""
    if source.get("WARC-Type") != "response":
        return []
    status, headers, payload = http_parts(source.block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = _CHARSET.search(kind)
    entity, body = content(headers, payload)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    own, uri, date = source.get("WARC-Record-ID") or "", source.get("WARC-Target-URI") or "", source.get("WARC-Date") or ""
    block_digest, payload_digest = source.get("WARC-Block-Digest"), source.get("WARC-Payload-Digest")
    good = block_digest in (None, digest(source.block)) and payload_digest in (None, digest(payload), digest(entity))
    links = [("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]

    def made(what: str, content_type: str, block: bytes, more: list[tuple[str, str]]) -> Record:
        fields = [("WARC-Type", what), ("WARC-Record-ID", record_id(what, own)), ("WARC-Date", date), ("WARC-Target-URI", uri), *links, *more]
        return Record([*fields, ("Content-Type", content_type), ("WARC-Block-Digest", digest(block))], block)

    conversion = made("conversion", "text/plain; charset=utf-8", visible_text(page).encode(), [])
    clean = _uncommented(page)
    title, root = _title(_tagged(clean)[0]), _HTML.search(_tagged(clean)[0])
    lang = root and _LANG.search(root[0])
    notes = [("conversion-record-id", conversion.get("WARC-Record-ID")), ("digest-verified", "yes" if good else "no")]
    notes += [(f"source-{n.lower()}", v) for n, v in (("Block-Digest", block_digest), ("Payload-Digest", payload_digest), ("Refers-To", source.get("WARC-Refers-To"))) if v]
    notes += [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers)]
    notes += [("title", _plain(title.replace("\n", " ")))] if title is not None else []
    notes += [("language", lang[1])] if lang else []
    notes += [("outlink", link) for link in _links(_shown(clean))]
    fields = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in notes).encode()
    return [conversion, made("metadata", "application/warc-fields", fields, [("WARC-Concurrent-To", conversion.get("WARC-Record-ID") or "")])]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, record): a serialised response of every row. Rows that repeat a page have equal records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = zip(*(c.to_pylist() for c in part.columns), strict=True)
                made = [response(str(key), url, body).to_bytes() for key, url, body in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.transform(in_arrow, work, f"page_id {kind}, record binary")


DERIVED = "record_type string, record_id string, refers_to string, target_uri string, n_bytes long, source_payload_digest string, block_sha256 string, record_sha256 string, record binary, error string"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response in (page_id, record): its conversion and its metadata record.

    record_sha256 and block_sha256 are lowercase hex. Rows that are null or no response give none; bytes that
    are no record give one row of record_type ``error`` that says why in ``error`` and has null elsewhere. Each record is worked
    on alone, so rows that repeat a page give equal rows; an empty table gives none.
    """
    names = ["page_id", *(f.split()[0] for f in DERIVED.split(", "))]
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 3 + [pa.binary(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys, rows = [], []
                for i, raw in enumerate(part.column(1).to_pylist()):
                    if raw is None:
                        continue
                    try:
                        source = parse_record(raw)
                    except ValueError as e:
                        keys.append(i)
                        rows.append(("error", *[None] * 8, str(e)))
                        continue
                    for r in derive(source):
                        done = r.to_bytes()
                        keys.append(i)
                        rows.append(
                            (
                                r.get("WARC-Type"),
                                r.get("WARC-Record-ID"),
                                r.get("WARC-Refers-To"),
                                r.get("WARC-Target-URI"),
                                len(done),
                                source.get("WARC-Payload-Digest"),
                                hashlib.sha256(r.block).hexdigest(),
                                hashlib.sha256(done).hexdigest(),
                                done,
                                None,
                            )
                        )
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int64())), *columns], names=names)

    kind = records.schema["page_id"].dataType.simpleString()
    return records.select("page_id", "record").transform(in_arrow, work, f"page_id {kind}, {DERIVED}")
