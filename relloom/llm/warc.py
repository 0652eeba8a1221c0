"""WARC derivatives: metadata and plain-text conversion records of HTML responses.

Every response yields two records that refer to it by its identifier, its address, its
date, its HTTP headers and its digests. Responses are independent: one map.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import Batches, map_batches, steps

CRLF = "\r\n"
#: Elements whose content is not text, and those that begin and end a line (fixed values).
HIDDEN = ("script", "style", "noscript", "template", "iframe", "svg")
LINES = set(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr li main nav ol option p pre section table td th title tr ul".split()
)
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
LANG = re.compile(r"""\slang\s*=\s*["']?([A-Za-z-]+)""", re.IGNORECASE)
CLOSING = {name: re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE) for name in HIDDEN}
BLANK = re.compile(r"[^\S\n]+")


class Page:
    """Text, title, language and links of an HTML text, read in one pass."""

    def __init__(self, source: str):
        out: list[str] = []
        self.links: list[str] = []
        self.title, self.lang = "", ""
        title_from, at, size = None, 0, len(source)
        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                out.append(source[at:])
                break
            out.append(source[at:begin])
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                at = size if end < 0 else end + 3
                continue
            tag = NAME.match(source, begin)
            if not tag:
                if source.startswith(("<!", "<?"), begin):
                    end = source.find(">", begin)
                    at = size if end < 0 else end + 1
                else:
                    out.append("<")
                    at = begin + 1
                continue
            rest = REST.match(source, tag.end())
            end = rest.end() if rest else source.find(">", tag.end()) + 1
            if not end:
                break
            name, opens = tag[1].lower(), source[begin + 1] != "/"
            attributes = source[tag.end() : end]
            if opens and name in CLOSING:
                closing = CLOSING[name].search(source, end)
                at = closing.end() if closing else size
                continue
            if name == "title":
                if opens:
                    title_from = len(out)
                elif title_from is not None:
                    if not self.title:
                        self.title = " ".join(html.unescape("".join(out[title_from:])).split())
                    del out[title_from:]
                    title_from = None
            elif opens and name in ("a", "area") and (href := HREF.search(attributes)):
                self.links.append(html.unescape(next(g for g in href.groups() if g is not None)).strip())
            elif opens and name == "html" and (lang := LANG.search(attributes)):
                self.lang = lang[1]
            if name in LINES:
                out.append("\n")
            at = end
        lines = (BLANK.sub(" ", line).strip() for line in html.unescape("".join(out)).split("\n"))
        self.text = "\n".join(line for line in lines if line)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: object) -> str:
    """A record identifier that equal parts always get."""
    raw = hashlib.sha1("\x1f".join("" if p is None else str(p) for p in parts).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=5)}>"


def header(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields if v not in (None, ""))


def record(head: str, block: str) -> bytes:
    """The bytes of a whole record."""
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block.encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records of concatenated WARC bytes as (fields, block)."""
    out, at = [], 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8", "surrogatepass").split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = split + 4
        end = begin + int(fields["Content-Length"])
        out.append((fields, data[begin:end]))
        at = end + 4
    return out


def response(url: str | None, payload: str | None, key: object, date: str, headers: str | None) -> tuple[str, str, str, str]:
    """Identifier, HTTP header, payload digest and block digest of a response."""
    raw = (payload or "").encode("utf-8", "surrogatepass")
    http = headers or f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(raw)}{CRLF}"
    body = digest(raw)
    return identifier("response", key, url, date, body), http, body, digest(http.encode() + b"\r\n" + raw)


def derive(url: str | None, payload: str | None, key: object, date: str, headers: str | None) -> list[tuple]:
    """The metadata record and the conversion record of a response, as rows."""
    source, http, body, whole = response(url, payload, key, date, headers)
    page = Page(payload or "")
    text_id, about_id = identifier("conversion", source), identifier("metadata", source)
    links = []
    for link in page.links:
        try:
            links.append(urljoin(url or "", link))
        except ValueError:
            links.append(link)
    status, *lines = [x for x in http.split(CRLF) if x]
    about = [("title", page.title), ("language", page.lang), ("source-status", status)]
    about += [(f"source-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    about += [("source-payload-digest", body), ("source-block-digest", whole), ("conversion", text_id)]
    about += [("outlink", " ".join(x.split())) for x in links]
    block = "".join(f"{k}: {v}{CRLF}" for k, v in about if v)
    rows = []
    for kind, own, content, media in (
        ("metadata", about_id, block, "application/warc-fields"), ("conversion", text_id, page.text, "text/plain; charset=utf-8")
    ):
        raw = content.encode("utf-8", "surrogatepass")
        made = digest(raw)
        head = header([
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date),
            ("WARC-Block-Digest", made), ("Content-Type", media), ("Content-Length", len(raw)),
        ])
        rows.append((kind, own, source, url, body, made, len(raw), len(links), head, content))
    return rows


FIELDS = [
    ("warc_type", pa.string(), "string"), ("record_id", pa.string(), "string"), ("refers_to", pa.string(), "string"),
    ("target_uri", pa.string(), "string"), ("source_digest", pa.string(), "string"), ("block_digest", pa.string(), "string"),
    ("content_length", pa.int64(), "long"), ("n_links", pa.int64(), "long"), ("header", pa.string(), "string"),
    ("block", pa.string(), "string"),
]


def _derive(batches: Batches, date: str) -> Batches:
    for batch in batches:
        for part in steps(batch, "html"):
            keys, rows = [], []
            for key, url, payload, day, headers in zip(*(part[k].to_pylist() for k in range(5)), strict=True):
                made = derive(url, payload, key, day or date, headers)
                keys += [key] * len(made)
                rows += made
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *(pa.array(c, f[1]) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True))],
                names=["page_id", *(f[0] for f in FIELDS)],
            )


def derivatives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date_col: str | None = None, headers_col: str | None = None, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Two rows per response: its metadata record and its conversion record.

    ``header`` and ``block`` are a record's two parts, see :func:`record`. Without date or
    header columns, ``date`` and the header of a plain 200 response stand in. A null page
    is an empty one, a null address leaves its fields out, and both records still exist.
    Identifiers are made from the content, so repeated rows repeat their records.
    """
    read = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
        (F.col(f"`{date_col}`") if date_col else F.lit(None)).cast("string").alias("date"),
        (F.col(f"`{headers_col}`") if headers_col else F.lit(None)).cast("string").alias("headers"),
    )
    schema = "page_id long, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS)
    return map_batches(read, lambda b: _derive(b, date), schema)


def _records(batches: Batches) -> Batches:
    for batch in batches:
        for part in steps(batch, "block"):
            made = [record(h, b) for h, b in zip(part["header"].to_pylist(), part["block"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["page_id"], pa.array(made, pa.binary())], names=["page_id", "record"])


def as_records(made: DataFrame) -> DataFrame:
    """The bytes of every record, ready to be concatenated."""
    return map_batches(made.select("page_id", "header", "block"), _records, "page_id long, record binary")
