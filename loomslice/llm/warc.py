"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A response gives two records that name it in WARC-Refers-To: ``conversion`` holds the page's text and
``metadata`` its outlinks, title, language and the source's HTTP headers. Both carry the source's target
URI, date and payload digest; each has its own block digest. Record ids are derived from the source's id,
so a task that is run again writes the same records.

A null payload counts as empty; a missing source digest is computed. A null URI leaves the header out; a
null source id does too, and the record ids come from URI, date and digest then. Pages are read whole, in
time linear in their length, however broken. A
payload of markup alone gives an empty text. Repeated rows give repeated records with the same ids, and
an empty table gives none. All is done within a row; there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, tidy

RECORDS = "source_id string, record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, payload_digest string, source_digest string, block_digest string, headers string, block string"
_NAMESPACE = uuid.UUID("6d1f1c1e-3a3f-5e0c-9a55-0f4d7f2f7a10")

_BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav aside main blockquote pre hr dd dt dl figure form".split())
_HIDDEN = frozenset("script style noscript template svg head".split())
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)|<[!/?]")
_BLANK = re.compile(r"[^\S\n]+")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]+")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def markup(page: str, hidden: frozenset[str] = _HIDDEN) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of each tag, name without a slash in front for opening ones; a comment or a hidden element is one, named ``!``.

    Each search goes on from where the last one ended, and an end that a page lacks is sought once, so the
    time is linear in the page. What isn't closed isn't hidden; what has no ``>`` is text.
    """
    ends: dict[str, re.Pattern[str]] = {}
    lacking: set[str] = set()
    at = 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if "-->" not in lacking and page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end >= 0:
                yield start, (at := end + 3), "!"
                continue
            lacking.add("-->")
        m = _NAME.match(page, start)
        if not m:
            continue
        close = page.find(">", start)
        if close < 0:
            return
        name, at = (m[1] or "?").lower(), close + 1
        opening = "/" not in m[0]
        if opening and name in hidden and name not in lacking:
            end = ends.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, at)
            if end:
                yield start, (at := end.end()), "!"
                continue
            lacking.add(name)
        yield start, at, name if opening else f"/{name}"


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as web archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text: a line for each block, white space joined, entities decoded."""
    parts, at = [], 0
    for start, end, name in markup(page):
        parts += [page[at:start], " " if name == "!" else "\n" if name.lstrip("/") in _BLOCKS else ""]
        at = end
    parts.append(page[at:])
    lines = (_BLANK.sub(" ", line).strip() for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line)


def describe(page: str, headers: dict) -> dict:
    """Title, language and outlinks, in their order; those in comments and scripts don't count."""
    title = lang = began = None
    links = []
    for start, end, name in markup(page, _HIDDEN - {"head"}):
        if name == "title" and began is None:
            began = end
        elif name == "/title" and began is not None and title is None:
            title = html.unescape(page[began:start]).strip()
        elif name == "html" and lang is None and (m := _LANG.search(page, start, end)):
            lang = m[1]
        elif name == "a" and (m := _HREF.search(page, start, end)):
            links.append(html.unescape(next(g for g in m.groups() if g is not None)))
    return {"title": title, "language": lang, "outlinks": links, "source_headers": headers}


def header_block(fields: list[tuple[str, str | None]]) -> str:
    """A record's header; a control character in a value, such as a line's end, becomes a space."""
    return "WARC/1.1\r\n" + "".join(f"{k}: {_CONTROL.sub(' ', v)}\r\n" for k, v in fields if v is not None) + "\r\n"


def derive(source: dict) -> list[dict]:
    """The two records of a response: source_id, uri, date, headers (JSON), digest and payload."""
    page = source["payload"] or ""
    own = source["digest"] or digest(page.encode())
    try:
        kept = json.loads(source["headers"] or "{}")
    except ValueError:
        kept = {"raw": source["headers"]}
    name = source["source_id"] if source["source_id"] is not None else json.dumps([source["uri"], source["date"], own])
    out = []
    for kind, mime, block in (("conversion", "text/plain", plain_text(page)), ("metadata", "application/json", json.dumps(describe(page, kept), ensure_ascii=False, sort_keys=True))):
        data = block.encode("utf-8", "surrogatepass")
        rid = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name} {kind}')}>"
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", source["source_id"]), ("WARC-Target-URI", source["uri"]), ("WARC-Date", source["date"]), ("WARC-Refers-To-Target-URI", source["uri"]),
            ("WARC-Refers-To-Date", source["date"]), ("WARC-Source-Payload-Digest", own), ("WARC-Block-Digest", digest(data)), ("WARC-Payload-Digest", digest(data)), ("Content-Type", mime), ("Content-Length", str(len(data))),
        ]
        out.append({"source_id": source["source_id"], "record_id": rid, "record_type": kind, "refers_to": source["source_id"], "target_uri": source["uri"], "date": source["date"], "content_type": mime, "payload_digest": digest(data), "source_digest": own, "block_digest": digest(data), "headers": header_block(fields), "block": block})
    return out


def derivatives(responses: DataFrame, *, id_col: str = "record_id", uri_col: str = "target_uri", date_col: str = "date", headers_col: str = "http_headers", digest_col: str = "payload_digest", payload_col: str = "payload") -> DataFrame:
    """RECORDS: a conversion and a metadata record for every response."""
    rows = pick(responses, source_id=id_col, uri=uri_col, date=date_col, headers=headers_col, digest=digest_col, payload=payload_col)
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                made = [r for source in batch.slice(i, 256).to_pylist() for r in derive(source)]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in made], pa.string()) for n in names})

    return rows.select([F.col(c).cast("string") for c in rows.columns]).mapInArrow(tidy(run), RECORDS)


def responses_of_pages(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages as response records: ids derived from page id and URL, one date, a payload digest to be computed."""
    rows = pick(pages, page_id=id_col, url=uri_col, html=html_col)
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    urn = F.concat(F.lit("<urn:uuid:"), F.substr(h, F.lit(1), F.lit(8)), *[F.concat(F.lit("-"), F.substr(h, F.lit(a), F.lit(n))) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))], F.lit(">"))
    return rows.select(
        "page_id", urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit('{"Content-Type": "text/html; charset=utf-8", "Status": "200 OK"}').alias("http_headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.col("html").alias("payload"),
    )


def warc_text(records: DataFrame) -> DataFrame:
    """A column with the serialised record, ready to be written by Spark's text writer or joined to files."""
    return records.select("record_id", F.concat("headers", "block", F.lit("\r\n\r\n")).alias("record"))
