"""WARC derivatives: from response records to linked metadata records and plain-text conversion records.

``respond`` writes each page as a response record of WARC/1.1 (named fields, HTTP head, payload).
``derive`` reads response records and makes two records of each: ``metadata``, a JSON envelope of the
source's named fields, its HTTP status line and headers (as pairs in their order), and what the HTML head and links say; and
``conversion``, the plain text. Both carry ``WARC-Refers-To`` the response, its target and date, and
digests of their own block; the metadata record also keeps the source's payload digest.

Record ids are name-based UUIDs of what a record holds, so a recomputed task writes the same records.

Plain text: comments, scripts, styles, heads and templates go (a head without an end tag ends at the first
thing that can't stand in one; a template, noscript, svg or iframe closed by "/>" is empty), block elements end a line, entities are
decoded, white space within a line becomes one space, blank lines go.

Markup is read in one forward pass, so a broken page takes time in proportion to its length, too: what has no end is
text (a tag) or goes on to the end of the page (a comment, a silent element). Links within comments, scripts and
styles are none.

Defined results: null html is an empty payload and gives an empty text; a null url leaves the target
field out; control characters and spaces in a url are percent-encoded; null ids pass through; repeated
rows give equal records; a block that is not a response record gives null derivatives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture

# Elements whose content is no text, and elements that end a line.
SILENT = "head script style template noscript svg iframe".split()
BLOCK = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table td th tr ul body html title option"
).split()

#: Elements whose content is no markup either.
RAW = "script style iframe".split()
# What may stand in a head.
HEAD_RAW = "script style template noscript noframes".split()
HEAD_VOID = "title meta link base basefont bgsound".split()
LINKED = {"a": "href", "img": "src", "link": "href", "script": "src", "iframe": "src", "area": "href"}

_TAG_END = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+>""")
_OPEN = re.compile(r"(/?)(?:([a-zA-Z]\w*+)|[!?])")
_CLOSERS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in {*SILENT, *HEAD_RAW, "title"}} | {"]]>": re.compile(r"\]\]>")}
_SPACE = re.compile(r"[^\S\n]+")
_ATTR = re.compile(r"""(?<![\w:-])([\w:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']\S*+))""")
_EMPTY = re.compile(r"""(?:^\w+|[\s"'])/$""")
#: Character references beyond any character; a digit too many for ``int`` must not stop a page.
_BEYOND = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{8,}+);?")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, *parts: bytes) -> str:
    h = hashlib.sha1(kind.encode())
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def serialize(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a file, gzipped by record or plain."""
    if blob[:2] == b"\x1f\x8b":
        blob = gzip.decompress(blob)
    at = 0
    while blob.startswith(b"WARC/", at):
        end = blob.index(b"\r\n\r\n", at)
        lines = blob[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["Content-Length"])
        yield fields, blob[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def response(url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = [] if url is None else [("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))]
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", (url or "").encode(), payload)), *target,
        ("WARC-Date", DATE), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return serialize(fields, block)


def _unescape(text: str) -> str:
    return entities.unescape(_BEYOND.sub("\ufffd", text))


class Page:
    """One forward pass over a page's markup: ``text`` (not yet decoded), ``title``, ``metas`` and ``links``.

    No place is scanned again from its start: a tag, comment or silent element is left at its end, an end that is
    not there is looked for once, and the ends of tags behind an open quote come from one table. So time is linear.
    """

    def __init__(self, html: str) -> None:
        self.html, self.out = html, []
        self.title: str | None = None
        self.metas: list[dict[str, str]] = []
        self.links: list[dict[str, str]] = []
        self._closers: dict[str, tuple[int, int] | None] = {}
        self._ends: dict[int, int] | None = None
        self._scan()
        self.text = "".join(self.out)

    def _tag_end(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name begins at ``at``, quotes skipped; -1 if there is none."""
        if self._ends is None:
            found = _TAG_END.match(self.html, at)
            if found:
                return found.end() - 1
            # from the last mark to the first: a ">" ends here, a quote goes on behind its partner
            marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", self.html)]
            self._marks, self._ends, after, partner = [p for p, _ in marks], {}, {}, {}
            following = -1  # the mark behind this one
            for p, c in reversed(marks):
                end = p if c == ">" else after.get(partner[c], -1) if c in partner else -1
                self._ends[p] = end
                after[p] = self._ends[following] if following >= 0 else -1
                if c != ">":
                    partner[c] = p
                following = p
        k = bisect.bisect_left(self._marks, at)
        return self._ends[self._marks[k]] if k < len(self._marks) else -1

    def _closer(self, name: str, at: int) -> tuple[int, int] | None:
        """Begin and end of the first end tag of ``name`` (or "]]>") from ``at`` on."""
        last = self._closers.get(name, (-1, -1))
        if last is not None and last[0] < at:
            found = _CLOSERS[name].search(self.html, at)
            last = self._closers[name] = found.span() if found else None
        return last

    def _attributes(self, name: str, begin: int, end: int) -> None:
        pairs = ((k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(self.html, begin, end))
        if name == "meta":
            self.metas.append(dict(pairs))
            return
        url = next((v for k, v in pairs if k in ("href", "src")), None)
        if url is not None:
            self.links.append({"path": f"{name.upper()}@/{LINKED[name]}", "url": _unescape(url)})

    def _scan(self) -> None:
        html, out = self.html, self.out
        at, head, silent = 0, False, -1  # within a head; up to where tags only give links
        while True:
            lt = html.find("<", at)
            text = html[at : lt if lt >= 0 else len(html)]
            if text and at >= silent and (not head or text.strip()):
                head = False
                out.append(text)
            if lt < 0:
                return
            if html.startswith("!", lt + 1):
                if html.startswith("--", lt + 2):
                    end = html.find("-->", lt + 4)
                    at = end + 3 if end >= 0 else len(html)
                    out.append(" " if not head else "")
                    continue
                if not head and html.startswith("[CDATA[", lt + 2) and (close := self._closer("]]>", lt)):
                    at = close[1]
                    out.append(" ")
                    continue
            opened = _OPEN.match(html, lt + 1)
            gt = self._tag_end(opened.end()) if opened else -1
            if gt < 0:  # no tag
                at = lt + 1
                if lt >= silent:
                    head = False
                    out.append("<")
                continue
            at = gt + 1
            closing, name = opened[1], (opened[2] or "").lower()
            if not closing and (name in LINKED or name == "meta"):
                self._attributes(name, opened.end(), gt)
            if not closing and name == "title" and self.title is None and (close := self._closer(name, at)):
                self.title = html[at : close[0]]
            if lt < silent:
                continue
            if not closing and name == "head":
                head = True
                out.append(" ")
                continue
            if head:
                if closing:
                    if name not in ("head", "body", "html", "br"):
                        continue
                    head = False
                    if name == "head":
                        continue
                elif name in HEAD_RAW or name == "title":
                    close = self._closer(name, at)
                    if close or name != "title":
                        at = close[1] if close else len(html)
                    continue
                elif name in HEAD_VOID or not name:
                    continue
                head = False
            if not closing and name in SILENT:
                out.append(" ")
                if name in ("script", "style") or not _EMPTY.search(html[lt + 1 : gt]):
                    close = self._closer(name, at)
                    if name in RAW:
                        at = close[1] if close else len(html)
                    else:
                        silent = close[0] if close else len(html)
            elif name in BLOCK:
                out.append("\n")


def plain_text(html: str) -> str:
    return _lines(Page(html).text)


def _lines(text: str) -> str:
    lines = (_SPACE.sub(" ", x).strip() for x in _unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def _split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order (repeated ones as often as they stand there), payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in " \t" and headers:  # a folded line goes on with the one before
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}".strip())
        else:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return first, headers, payload


def envelope(fields: dict[str, str], status: str, headers: list[tuple[str, str]], payload: bytes, page: Page) -> dict:
    """What the metadata record says of its source."""
    return {
        "WARC-Header-Metadata": fields,
        "Payload-Metadata": {
            "HTTP-Response-Metadata": {
                "Response-Message": status,
                "Headers": headers,
                "HTML-Metadata": {"Title": None if page.title is None else _unescape(page.title).strip(), "Metas": page.metas, "Links": page.links},
                "Entity-Length": len(payload),
                "Entity-Digest": fields.get("WARC-Payload-Digest") or digest(payload),
            }
        },
    }


def derivatives(record: bytes) -> dict | None:
    """Metadata and conversion of one response record; None if it is none."""
    fields, block = next(parse(record), ({}, b""))
    if fields.get("WARC-Type") != "response":
        return None
    source = fields["WARC-Record-ID"]
    status, headers, payload = _split_http(block)
    page = Page(payload.decode("utf-8", "replace"))
    told = envelope(fields, status, headers, payload, page)
    meta = json.dumps(told, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    text = _lines(page.text)
    plain = text.encode("utf-8", "replace")
    shared = [(k, fields[k]) for k in ("WARC-Target-URI", "WARC-Date") if k in fields] + [("WARC-Refers-To", source)]
    out = {"response_id": source, "target_uri": fields.get("WARC-Target-URI"), "date": fields.get("WARC-Date")}
    out["payload_digest"] = told["Payload-Metadata"]["HTTP-Response-Metadata"]["Entity-Digest"]
    out["n_links"] = len(told["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"])
    for kind, body, content in (("metadata", meta, "application/json"), ("conversion", plain, "text/plain; charset=utf-8")):
        rid = record_id(kind, source.encode(), body)
        own = [("WARC-Type", kind), ("WARC-Record-ID", rid), *shared, ("WARC-Block-Digest", digest(body))]
        if kind == "metadata":
            own.append(("WARC-Source-Payload-Digest", out["payload_digest"]))
        out[f"{kind}_record"] = serialize([*own, ("Content-Type", content)], body)
        out |= {f"{kind}_id": rid, f"{kind}_refers_to": source, f"{kind}_digest": digest(body)}
    return out | {"metadata": meta.decode(), "text": text}


_FIELDS = pa.schema(
    [(n, pa.string()) for n in ("response_id", "target_uri", "date", "payload_digest")] + [("n_links", pa.int64())]
    + [(f"{k}_{n}", pa.string()) for k in ("metadata", "conversion") for n in ("id", "refers_to", "digest")]
    + [("metadata", pa.string()), ("text", pa.string()), ("metadata_record", pa.binary()), ("conversion_record", pa.binary())]
)
_DDL = ", ".join(f"{f.name} {'binary' if pa.types.is_binary(f.type) else 'long' if pa.types.is_int64(f.type) else 'string'}" for f in _FIELDS)


def respond(pages: DataFrame) -> DataFrame:
    """page_id, record: each page as a response record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(u, h) for u, h in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array(made, pa.binary())], ["page_id", "record"])

    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, record binary")


def derive(records: DataFrame) -> DataFrame:
    """page_id and, for each response record, the fields, blocks and bytes of its two derivatives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = dict.fromkeys(_FIELDS.names)
        for b in batches:
            ids, blobs = b["page_id"], b["record"]
            for i in range(0, len(b), 500):
                made = [derivatives(r) or none if r is not None else none for r in blobs.slice(i, 500).to_pylist()]
                part = pa.RecordBatch.from_pylist(made, schema=_FIELDS)
                yield pa.RecordBatch.from_arrays([ids.slice(i, 500), *part.columns], ["page_id", *_FIELDS.names])

    return map_batches(records, run, f"page_id long, {_DDL}")


def files(records: DataFrame, column: str) -> DataFrame:
    """part, content: the records of each partition as one file, each record a gzip member of its own."""
    from pyspark import TaskContext

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, members, size, n = TaskContext.get().partitionId(), [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [f"{part:05d}-{n:05d}.warc.gz"], "content": [b"".join(members)]})

        for b in batches:
            for r in b[column].to_pylist():
                if r is not None:
                    members.append(gzip.compress(r, 6, mtime=0))
                    size += len(members[-1])
                if size >= 64 << 20:
                    yield row()
                    members, size, n = [], 0, n + 1
        if members:
            yield row()

    return map_batches(records.select(column), run, "part string, content binary")
