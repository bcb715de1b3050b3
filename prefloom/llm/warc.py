"""WARC derivatives: a metadata record and a plain-text conversion record for every response record.

Both name their response in WARC-Refers-To and carry its WARC-Target-URI and WARC-Date; the metadata record holds, as
JSON, the response's WARC and HTTP headers, its digests, the page's title and its links; the conversion record holds
the visible text.  Record ids are version-5-style UUIDs of the source id and the record type, so a rerun after a lost
executor gives the same ids.  Digests are ``sha1:`` plus base32, as crawlers write them.
As bytes, both records carry the response's payload digest and, as JSON, its headers.

Each response is read by itself: the plan has no shuffle, so a host with a third of all pages is no hot key.  The HTML
scanner goes over a page once.

Defined results: a null payload is an empty one and gives a conversion record of length 0; null urls or dates stay
null; null or repeated ids give equal rows; columns other than the named ones are not looked at; no rows, no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_lib
import json
import re
import uuid
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = "page_id long, record_id string, target_uri string, date string, headers map<string,string>, http_headers string, payload binary"
DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, "
    "block_digest string, payload_digest string, source_headers map<string,string>, title string, links array<struct<url:string,text:string>>, block string"
)
#: Elements whose content is no text, and those that end a line of text.
SILENT = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title"}
BREAKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
INSIDE = re.compile(r"""[>"']""")
ATTR = re.compile(r"""(?:^|[\s"'/])(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    h = hashlib.sha256("\x1f".join("" if p is None else str(p) for p in parts).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h[:16], version=5)}>"


def joined_url(base: str | None, url: str) -> str:
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


class TagEnds:
    """Where tags end: the first > outside quotes.  Places passed before are known, so that all scans of a page together pass over it a few times."""

    def __init__(self, page: str):
        self.page, self.known, self.unclosed = page, {}, {}

    def __call__(self, at: int) -> int:
        """The place of the tag's >, or -1 where quotes or the page end before it."""
        passed, end = [], -1
        while True:
            if at in self.known:
                end = self.known[at]
                break
            passed.append(at)
            m = INSIDE.search(self.page, at)
            if not m or m[0] == ">":
                end = m.start() if m else -1
                break
            if m.start() >= self.unclosed.get(m[0], len(self.page)):
                break
            close = self.page.find(m[0], m.end())
            if close < 0:
                self.unclosed[m[0]] = m.start()
                break
            at = close + 1
        self.known.update(dict.fromkeys(passed, end))
        return end


def scan_html(page: str, base: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """Title, visible text (a line per block, spaces collapsed) and links of a page."""
    text: list[str] = []
    links: list[tuple[str, str]] = []
    title, lower, open_link, based = "", None, None, False
    at, n, ends = 0, len(page), TagEnds(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        end = ends(m.end()) if m else -1
        if end < 0:
            text.append("<")
            at = lt + 1
            continue
        at, closing, name, inside = end + 1, m[1], m[2].lower(), page[m.end() : end]
        if name == "base" and not closing and not based:
            based = True
            for a in ATTR.finditer(inside):
                if a[1].lower() == "href":
                    base = joined_url(base, html_lib.unescape(a[2] or a[3] or a[4] or "").strip())
                    break
        if not closing and name in SILENT and not inside.endswith("/"):
            if lower is None:
                lower = page.lower() if len(page.lower()) == n else page.translate({c: c + 32 for c in range(65, 91)})
            end = lower.find("</" + name, at)
            if name == "title" and not title:
                title = " ".join(html_lib.unescape(page[at : n if end < 0 else end]).split())
            gt = -1 if end < 0 else page.find(">", end)
            at = n if gt < 0 else gt + 1
            continue
        if name in BREAKS:
            text.append("\n")
        if name in ("a", "img", "link", "area", "iframe") and not closing:
            for a in ATTR.finditer(inside):
                if a[1].lower() == ("src" if name in ("img", "iframe") else "href"):
                    links.append((joined_url(base, html_lib.unescape(a[2] or a[3] or a[4] or "").strip()), ""))
                    open_link = (len(links) - 1, len(text)) if name == "a" else open_link
                    break
        elif name == "a" and open_link:
            k, since = open_link
            links[k] = (links[k][0], " ".join(html_lib.unescape("".join(text[since:])).split()))
            open_link = None
    lines = (" ".join(x.split()) for x in html_lib.unescape("".join(text)).split("\n"))
    return title, "\n".join(x for x in lines if x), links


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html); `date` is the crawl's WARC-Date, as the table has none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for pid, url, page in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                pid = None if pd.isna(pid) else int(pid)
                body = (page or "").encode("utf-8", "surrogatepass")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                rid = record_id("response", pid, url, hashlib.sha256(body).hexdigest())
                head = {"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(body)), "WARC-Block-Digest": sha1_digest(http.encode() + body), "WARC-Payload-Digest": sha1_digest(body)}
                if url is not None:
                    head["WARC-Target-URI"] = url
                rows.append((pid, rid, url, date, head, http, body))
            yield pd.DataFrame(rows, columns=["page_id", "record_id", "target_uri", "date", "headers", "http_headers", "payload"]).astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(run, RESPONSE)


def charset_of(http: str, payload: bytes) -> str:
    found = re.search(r"charset=[\"']?([\w.:-]+)", http or "", re.I) or re.search(r"charset=[\"']?([\w.:-]+)", payload[:1024].decode("latin-1"), re.I)
    try:
        return "".encode(found[1]) is not None and found[1] if found else "utf-8"
    except LookupError:
        return "utf-8"


def derive(source: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records, as RESPONSE describes them."""

    def run(batches):
        import pandas as pd

        names = [c.split(" ")[0] for c in DERIVED.replace("array<struct<url:string,text:string>>", "x").replace("map<string,string>", "x").split(", ")]
        for pdf in batches:
            rows = []
            for pid, rid, uri, date, headers, http, payload in zip(*(pdf[c] for c in ("page_id", "record_id", "target_uri", "date", "headers", "http_headers", "payload")), strict=True):
                payload = bytes(payload) if payload is not None else b""
                pid = None if pd.isna(pid) else int(pid)
                headers = dict(headers) if headers is not None else {}
                digest = headers.get("WARC-Payload-Digest") or sha1_digest(payload)
                title, text, links = scan_html(payload.decode(charset_of(http, payload), "replace"), uri)
                fields = [x.split(":", 1) for x in (http or "").split("\r\n")[1:] if ":" in x]
                meta = json.dumps({"WARC-Header-Metadata": headers, "HTTP-Response-Metadata": {"Status-Line": (http or "").split("\r\n")[0], "Headers": {k.strip(): v.strip() for k, v in fields}, "Payload-Digest": digest}, "HTML-Metadata": {"Title": title, "Links": [{"url": u, "text": t} for u, t in links]}}, ensure_ascii=False, sort_keys=True)
                for kind, mime, block in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
                    raw = block.encode("utf-8", "replace")
                    rows.append((pid, kind, record_id(kind, rid), rid, uri, date, mime, len(raw), sha1_digest(raw), digest, headers, title if kind == "metadata" else None, links if kind == "metadata" else None, raw.decode()))
            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return source.select("page_id", "record_id", "target_uri", "date", "headers", "http_headers", "payload").mapInPandas(run, DERIVED)


# -- the record format --------------------------------------------------------------------------------------


def to_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """One record, gzipped as a member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def parse_records(data: bytes):
    """(headers, block) of the records of a .warc or .warc.gz file's bytes; a record that is cut off ends the list."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
        size = int(headers.get("Content-Length") or 0)
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        yield headers, block
        at = end + 4 + size


def derivative_bytes(derived: DataFrame) -> DataFrame:
    """The records of derive() as gzip members, column `warc`; a partition's members after each other are a WARC file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                head = {"WARC-Type": row.record_type, "WARC-Record-ID": row.record_id, "WARC-Refers-To": row.refers_to, "WARC-Target-URI": row.target_uri, "WARC-Date": row.date, "Content-Type": row.content_type, "Content-Length": str(row.content_length), "WARC-Block-Digest": row.block_digest, "WARC-Payload-Digest": row.payload_digest, "X-Source-Headers": json.dumps(dict(row.source_headers), sort_keys=True)}
                out.append((row.record_id, to_bytes(head, row.block.encode())))
            yield pd.DataFrame(out, columns=["record_id", "warc"])

    return derived.mapInPandas(run, "record_id string, warc binary")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files; page_id is null, as files have none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for headers, block in parse_records(bytes(content)):
                    if headers.get("WARC-Type") == "response":
                        http, _, body = block.partition(b"\r\n\r\n")
                        rows.append((None, headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), headers, http.decode("latin-1") + "\r\n\r\n", body))
                yield pd.DataFrame(rows, columns=["page_id", "record_id", "target_uri", "date", "headers", "http_headers", "payload"]).astype({"page_id": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RESPONSE)


def derivatives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    return derive(responses(pages, date))
