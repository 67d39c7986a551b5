"""WARC derivatives: a metadata record and a plain-text conversion record for every response.

Both records refer to the response by ``WARC-Refers-To`` and keep its target, date and payload digest; the metadata record
also keeps the source's HTTP status and headers, in order. Record ids are name-based UUIDs of the source id and the kind,
so a task that runs again writes the same bytes and records can be joined without a lookup table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.htmltext import plain_text

VERSION = "WARC/1.1"
#: What each derivative row holds; ``record`` is the record's bytes, ready to be compressed as one member.
SCHEMA = "kind string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, block binary, record binary"


_CONTROL = re.compile(r"[\x00-\x1f\x7f\x85\u2028\u2029]+")
#: Header fields of a source record that its metadata record repeats.
SOURCE_FIELDS = ("WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Truncated", "WARC-IP-Address", "WARC-Identified-Payload-Type", "WARC-Warcinfo-ID", "WARC-Concurrent-To")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_uri(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(parts))}>"


def one_line(value: str) -> str:
    """A header value without line ends and other control characters: each run of them is a space."""
    return _CONTROL.sub(" ", value).strip()


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, header fields, an empty line, the block and two line ends. No value can start a line of its own."""
    clean = [(one_line(k).replace(":", ""), one_line(v)) for k, v in headers]
    return b"".join([VERSION.encode(), b"\r\n", *[f"{k}: {v}\r\n".encode() for k, v in clean], b"\r\n", block, b"\r\n\r\n"])


def split_http(message: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order (continuation lines joined) and payload; a message without an empty line is all
    payload."""
    for end in (b"\r\n\r\n", b"\n\n"):
        head, found, payload = message.partition(end)
        if found:
            break
    else:
        return "", [], message
    lines = head.decode("latin-1").splitlines()
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0] if lines else "", fields, payload


def _inflated(data: bytes, wbits: int) -> bytes:
    """What can be decompressed of ``data``; a cut or broken end is left out."""
    out, stream = [], zlib.decompressobj(wbits)
    try:
        while data:
            out.append(stream.decompress(data))
            if not stream.eof:
                break
            data, stream = stream.unused_data, zlib.decompressobj(wbits)
    except zlib.error:
        pass
    return b"".join(out)


def unchunked(data: bytes) -> bytes:
    """The body of a message in chunked transfer coding, as far as it is well-formed; other data stay as they are."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else data
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out) if out else data


def body_of(fields: list[tuple[str, str]], payload: bytes) -> bytes | None:
    """The payload without its transfer and content codings; None where a coding is not known (brotli and others)."""
    kind = {k.lower(): v.lower() for k, v in fields}
    if "chunked" in kind.get("transfer-encoding", ""):
        payload = unchunked(payload)
    for coding in reversed([c.strip() for c in kind.get("content-encoding", "").split(",") if c.strip()]):
        if coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31)
        elif coding == "deflate":
            payload = _inflated(payload, 15) or _inflated(payload, -15)
        elif coding != "identity":
            return None
    return payload


def _text_of(fields: list[tuple[str, str]], payload: bytes) -> str:
    body = body_of(fields, payload)
    if body is None:
        return ""
    content = {k.lower(): v for k, v in fields}.get("content-type", "text/html").lower()
    charset = content.partition("charset=")[2].strip(" \"'").split(";")[0].strip(" \"'") or "utf-8"
    try:
        text = body.decode(charset, "replace")
    except (LookupError, ValueError, UnicodeError):
        text = body.decode("utf-8", "replace")
    if "html" in content:
        return plain_text(text)
    return text if content.startswith("text/") else ""


def derive(record_id: str | None, target: str | None, date: str | None, message: bytes | None, headers: str | None = None) -> list[dict]:
    """The two derivative records of one response, as rows of ``SCHEMA``. ``headers`` are the source record's, a line each: the
    metadata record repeats those of SOURCE_FIELDS, and a payload digest among them is kept as the source's own."""
    record_id, target, date, message = record_id or "", target or "", date or "", message or b""
    status, fields, payload = split_http(message)
    given = [(k.strip(), one_line(v)) for k, _, v in (x.partition(":") for x in (headers or "").splitlines()) if k.strip()]
    stated = {k.lower(): v for k, v in given}
    own_digest = digest(payload)
    source = stated.get("warc-payload-digest") or own_digest
    wanted = {f.lower() for f in SOURCE_FIELDS}
    lines = [f"http-status: {one_line(status)}", *[f"http-header: {one_line(k)}: {one_line(v)}" for k, v in fields], f"payload-length: {len(payload)}", f"payload-digest: {own_digest}"]
    lines += [f"source-header: {one_line(k)}: {v}" for k, v in given if k.lower() in wanted]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{x}\r\n" for x in lines).encode()),
        "conversion": ("text/plain; charset=utf-8", _text_of(fields, payload).encode("utf-8", "replace")),
    }
    rows = []
    for kind, (content_type, block) in blocks.items():
        own, block_digest = record_uri(record_id, kind), digest(block)
        fields_ = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", record_id),
            ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", block_digest), ("Content-Type", content_type), ("Content-Length", str(len(block))),
        ]
        rows.append(
            dict(
                kind=kind, record_id=own, refers_to=record_id, target_uri=target, date=date, content_type=content_type, content_length=len(block),
                block_digest=block_digest, source_payload_digest=source, block=block, record=serialise(fields_, block),
            )
        )
    return rows


def derivatives(responses: DataFrame, record_id: str = "record_id", target: str = "target_uri", date: str = "date", message: str = "message", key: str | None = None) -> DataFrame:
    """Two rows of ``SCHEMA`` per response, led by the column ``key`` if one is named.

    A column ``headers`` of ``responses`` has the source records' own headers, a line each. A null id, target, date or header is
    an empty one; a null message is an empty response; line ends in values become spaces. Repeated rows give repeated
    records; other columns are ignored. A narrow stage: memory is one batch of responses. An empty table gives an empty result.
    """
    names = [f.partition(" ")[0] for f in SCHEMA.split(", ")]
    lead = [key] if key else []
    kind = f"`{key}` {responses.schema[key].dataType.simpleString()}, " if key else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [r for row in zip(*[c.to_pylist() for c in part.columns[:5]], strict=True) for r in derive(*row)]
                columns = [pa.array([r[n] for r in rows], {"content_length": pa.int64(), "block": pa.binary(), "record": pa.binary()}.get(n, pa.string())) for n in names]
                first = [part.column(5).take(pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64()))] if key else []
                yield pa.record_batch([*first, *columns], names=[*lead, *names])

    source = [F.col(f"`{record_id}`").cast("string"), F.col(f"`{target}`").cast("string"), F.col(f"`{date}`").cast("string"), F.col(f"`{message}`").cast("binary")]
    source += [F.col("headers").cast("string") if "headers" in responses.columns else F.lit(None).cast("string"), *[F.col(f"`{c}`") for c in lead]]
    return responses.select(*[c.alias(f"c{i}") for i, c in enumerate(source)]).mapInArrow(run, kind + SCHEMA)


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzipped file, or the whole of a plain one. After a corrupt member reading goes on at the next."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, out, to = zlib.decompressobj(31), [], at
        try:
            while not member.eof and to < len(data):
                out.append(member.decompress(view[to : to + 65536]))
                to = min(to + 65536, len(data))
            yield b"".join(out)
            at = to - len(member.unused_data)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 3)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file, gzipped by member or plain. Names keep the case they have first, and
    are found in any case. A record whose length is missing, negative or no number has an empty block; a cut last record
    and a corrupt member are left out."""
    for part in members(data):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = part[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = Fields((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
            stated = headers.get("Content-Length", "0")
            length = int(stated) if stated.isascii() and stated.isdigit() else 0
            if end + 4 + length > len(part):
                break
            yield headers, part[end + 4 : end + 4 + length]
            at = end + 4 + length


class Fields(dict):
    """Header fields, looked up without regard to case; of a repeated name the first value counts."""

    def __init__(self, pairs):
        super().__init__()
        self.names: dict[str, str] = {}
        for name, value in pairs:
            if name.lower() not in self.names:
                self.names[name.lower()] = name
                self[name] = value

    def __missing__(self, name: str) -> str:
        return dict.__getitem__(self, self.names[name.lower()])

    def get(self, name: str, default=None):
        known = self.names.get(name.lower())
        return default if known is None else self[known]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, target_uri, date, message, headers) of the response records in WARC files; ``headers`` are all of the record's, a
    line each. One task reads whole files, so files should have the usual size of up to a gigabyte."""
    names = ["record_id", "target_uri", "date", "message", "headers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.record_batch([pa.array(c, pa.binary() if n == "message" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for headers, block in parse(batch.column(0)[i].as_py()):
                    if headers.get("WARC-Type", "").lower() == "response":
                        held.append((*[headers.get(n) for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date")], block, "\n".join(f"{k}: {v}" for k, v in headers.items())))
                        size += len(block)
                    if size > 4 << 20:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_id string, target_uri string, date string, message binary, headers string")


def page_responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as the responses that a crawler would have stored: (key, record_id, target_uri, date, message)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, bodies = (c.to_pylist() for c in batch.columns)
            messages = []
            for body in bodies:
                payload = (body or "").encode()
                messages.append(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload)
            names = [record_uri("response", str(i)) for i in ids]
            yield pa.record_batch([batch.column(0), pa.array(names), pa.array(urls, pa.string()), pa.array([date] * len(ids)), pa.array(messages, pa.binary())], names=[key, "record_id", "target_uri", "date", "message"])

    return pages.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{url}`").alias("u"), F.col(f"`{html}`").alias("h")).mapInArrow(run, f"`{key}` long, record_id string, target_uri string, date string, message binary")
