"""WARC derivative builder: from each archived response one ``metadata`` record (title and
links) and one ``conversion`` record (plain text), linked to it.

Both name the response in WARC-Refers-To, keep its WARC-Target-URI and WARC-Date, and
carry digests of their own blocks; the metadata record also tells the response's payload
digest and header fields. Record ids are name-based, so reruns agree. ``write_warc`` packs
records into files, each record a gzip member of its own, a file a task.

``pages`` holds no archived headers, so ``responses`` states one date and plain HTTP headers.

Defined results: a response without body (null or empty) gives records with empty text;
a null URL stays empty, in id and headers; ids depend on page_id, URL, date and payload, so two captures
of a URL have ids of their own and equal rows have equal ids; an empty table gives none; further
columns are ignored; unclosed tags, comments and elements end with the page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder

DATE = "2024-01-01T00:00:00Z"
#: Elements that stand on lines of their own.
_BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table article section header footer nav title head body html blockquote pre".split())
#: Spaces and line ends that are not yet single.
_SPACE = re.compile(r"[ \t\r\f\v]{2,}|[\t\r\f\v]")
_LINES = re.compile(r" ?\n[ \n]+| \n")
#: Markup by the rules of HTML tokenization: tags (name, attributes), the title with its text, then elements whose content is
#: not shown, comments and broken markup. A quote counts only after an equals sign, so a > within a quoted value
#: does not end the tag. An unclosed comment, element or tag ends with the page.
_ATTRS = r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+"
_RAW, _TITLE = r"(?i:script|style|noscript|template)", r"(?i:title)"
_MARKUP = re.compile(
    rf"<(/?(?!(?:{_RAW}|{_TITLE})[\s/>])[a-zA-Z][^\s/>]*+)({_ATTRS})(?:>|\Z)"
    rf"|<{_TITLE}(?=[\s/>])[^>]*+>(.*?)(?:</{_TITLE}(?=[\s/>])[^>]*+>?|\Z)"
    rf"|<(?:({_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</(?i:\4)(?=[\s/>])[^>]*+>?|\Z)|!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/[^a-zA-Z>][^>]*+>?|/>|/?(?:{_RAW}|{_TITLE})[^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def page_facts(page: str, url: str) -> dict:
    """text (a line for each block element), title (the first) and links (href of anchors, in order, joined
    to the page's URL) of a page."""
    tokens = _MARKUP.split(page)  # text, then name, attributes, title, raw name, text of each markup
    parts, links, title = [tokens[0]], [], None
    for i in range(1, len(tokens), 5):
        name, attrs, head, _, after = tokens[i : i + 5]
        if name is not None:
            if name.removeprefix("/").lower() in _BLOCKS:
                parts.append("\n")
            elif name in ("a", "A"):
                for key, *value in _ATTR.findall(attrs):
                    if key.lower() == "href":
                        links.append(html.unescape(value[0] or value[1] or value[2]))
                        break
        elif head is not None:
            parts += ["\n", head, "\n"]
            title = head if title is None else title
        else:
            parts.append(" ")
        parts.append(after)
    joined = []
    for x in links:
        try:
            joined.append(urljoin(url, x))
        except ValueError:
            joined.append(x)
    text = _LINES.sub("\n", _SPACE.sub(" ", html.unescape("".join(parts)))).strip()
    return {"text": text, "title": " ".join(html.unescape(title or "").split()), "links": joined}


def plain_text(page: str) -> str:
    return page_facts(page, "")["text"]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages (page_id, url, html) as response records: page_id, record_id, target_uri, date,
    http_headers, payload."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [u or "" for u in batch.column("url").to_pylist()]
            bodies = [h or "" for h in batch.column("html").to_pylist()]
            ids = batch.column("page_id")
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([record_id(f"response {i} {u} {date} {digest(b.encode())}") for i, u, b in zip(ids.to_pylist(), urls, bodies)]),
                    pa.array(urls),
                    pa.array([date] * len(urls)),
                    pa.array([f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(b.encode())}" for b in bodies]),
                    pa.array(bodies),
                ],
                ["page_id", "record_id", "target_uri", "date", "http_headers", "payload"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        wrap, "page_id bigint, record_id string, target_uri string, date string, http_headers string, payload string"
    )


def derive(records: DataFrame) -> DataFrame:
    """Two derived records for each response: page_id, record_type, record_id, refers_to,
    target_uri, date, content_type, source_headers, payload_digest (of the response), block_digest,
    content_length, block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "payload_digest", "block_digest", "content_length", "block"]
        kinds = [pa.int64(), *[pa.string()] * 9, pa.int64(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                payload = digest(r["payload"].encode())
                facts = page_facts(r["payload"], r["target_uri"])
                lines = [f"title: {facts['title']}", *(f"outlink: {x}" for x in facts["links"]), f"response-headers: {json.dumps(r['http_headers'])}", f"response-payload-digest: {payload}"]
                for kind, content, block in (
                    ("metadata", "application/warc-fields", "\r\n".join(x.replace("\r", " ").replace("\n", " ") for x in lines) + "\r\n"),
                    ("conversion", "text/plain", facts["text"]),
                ):
                    raw = block.encode()
                    out.append((r["page_id"], kind, record_id(f"{kind} {r['record_id']}"), r["record_id"], r["target_uri"], r["date"], content, r["http_headers"], payload, digest(raw), len(raw), block))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 12, kinds)], names)

    return records.mapInArrow(
        build,
        "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_headers string, payload_digest string, block_digest string, content_length bigint, block string",
    )


def write_warc(derived: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes gzip files of the records and returns file, n_records and n_bytes of each."""
    folder = folder or new_folder(derived.sparkSession, "warc")
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"derived-{task.partitionId():06d}.warc.gz"
        where, top = pafs.FileSystem.from_uri(folder)
        passing, n, size = f"{top}/_{name}.{task.taskAttemptId()}", 0, 0
        with where.open_output_stream(passing) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    raw = r["block"].encode()
                    source = "".join(f"X-Source-{line}\r\n" for line in (r["source_headers"] or "").splitlines()[1:] if line)
                    head = (
                        f"WARC/1.1\r\nWARC-Type: {r['record_type']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Refers-To: {r['refers_to']}\r\n"
                        f"WARC-Target-URI: {r['target_uri']}\r\nWARC-Refers-To-Target-URI: {r['target_uri']}\r\n"
                        f"WARC-Refers-To-Date: {r['date']}\r\nWARC-Date: {r['date']}\r\nWARC-Block-Digest: {r['block_digest']}\r\nX-Source-Payload-Digest: {r['payload_digest']}\r\n{source}"
                        f"Content-Type: {r['content_type']}\r\nContent-Length: {len(raw)}\r\n\r\n"
                    )
                    member = gzip.compress(head.encode() + raw + b"\r\n\r\n", mtime=0)
                    out.write(member)
                    n, size = n + 1, size + len(member)
        where.move(passing, f"{top}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "n_records", "n_bytes"])

    return derived.mapInArrow(write, "file string, n_records bigint, n_bytes bigint").withColumn("folder", F.lit(folder))


def read_warc(files: DataFrame) -> DataFrame:
    """record_type, record_id, headers (a map) and block of every record in the files that ``write_warc`` told."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for r in batch.to_pylist():
                system, base = pafs.FileSystem.from_uri(r["folder"])
                with system.open_input_file(f"{base}/{r['file']}") as raw, gzip.open(raw) as f:
                    while line := f.readline():
                        heads = {}
                        while line := f.readline().rstrip(b"\r\n"):
                            key, _, value = line.decode().partition(": ")
                            heads[key] = value
                        block = f.read(int(heads["Content-Length"])).decode()
                        f.read(4)
                        row = (heads["WARC-Type"], heads["WARC-Record-ID"], list(heads.items()), block)
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["record_type", "record_id", "headers", "block"])

    return files.select("folder", "file").mapInArrow(read, "record_type string, record_id string, headers map<string,string>, block string")


def records_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    return derive(responses(pages, date))

