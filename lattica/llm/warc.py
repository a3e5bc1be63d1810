"""WARC archives: a distributed writer with revisit records, and a sequential streaming reader.

``write`` gives every page one record in a gzip member of its own. Pages of equal payloads (SHA-1 and length, at least
``least`` bytes) are one response, that with the largest page_id, and revisits of it, which keep the HTTP header but not
the payload. Each task writes files of about ROLL bytes under names of its own and reports them in a manifest table, so a
task that runs twice leaves unlisted files, never double records. A payload that many pages share is salted: pages meet its largest id first
per salt, then one row a salt gives the largest of all, and the way back to the pages is over (payload, salt).

``read`` takes the manifest's files, each read once from its first byte to its last: gzip members are inflated as the
bytes come, the WARC header is parsed at its blank line, Content-Length bounds the block, and SHA-1 digests run along. Memory is bounded by
READ bytes and a header, whatever the size of a record.

Defined results: null html is an empty payload; an odd url is percent-encoded, a null or missing one replaced by the record's id; null page_ids
are smaller than any other and come back as null (record ids hold page ids percent-encoded, and a name of its own for null, so no string can be
taken for it); rows that repeat the largest id are responses each; an empty table gives no records; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.shared import bound_batches, fresh_path, materialize

from .storage import open_input, open_output

ROLL = 32 << 20
READ = 1 << 18
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 32
_NULL = "<urn:no-page>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return _NULL if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, payload_digest: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit's block is the HTTP header alone, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = record_id(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else name[1:-1]}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _writer(folder: str, roll: int):
    def run(batches):
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            done = []
            for page_id, url, html, keeper, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper", "first")), strict=True):
                payload = (html or "").encode()
                packed = member(record(page_id, url, payload, keeper, not first))
                if out is None:
                    name, size, n = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_output(name)
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= roll:
                    out.close()
                    done.append((name, size, n))
                    out = None
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), x, strict=True)) for x in done], _MANIFEST)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "bytes": size, "records": n}], _MANIFEST)

    return run


_MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def write(pages: DataFrame, least: int = 0, roll: int = ROLL, salts: int = SALTS) -> DataFrame:
    """Archive pages (page_id, html, and url if there is one); the manifest: path, bytes, records."""
    bound_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).alias("salt")
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("len")).select("*", salt)
    salted = rows.filter(F.col("len") >= least).groupBy("sha", "len", "salt").agg(F.max("page_id").alias("most"))
    keepers = salted.select("sha", "len", "salt", F.max("most").over(Window.partitionBy("sha", "len")).alias("keeper"))  # a row per salt at most
    joined = rows.join(keepers, ["sha", "len", "salt"], "left")
    first = (F.col("len") < least) | F.col("page_id").eqNullSafe(F.col("keeper"))
    to_write = joined.select("page_id", "url", "html", "keeper", first.alias("first"))
    return materialize(to_write.mapInArrow(_writer(fresh_path(pages.sparkSession, "warc"), roll), "path string, bytes long, records long"), "warc-manifest")


class Reader:
    """Records of one gzip WARC stream in order; each item has the WARC header and what the block was found to hold."""

    def __init__(self, stream, chunk: int = READ):
        self.stream, self.chunk, self.left = stream, chunk, b""

    def _raw(self) -> bytes:
        got, self.left = self.left or self.stream.read(self.chunk), b""
        return got

    def _member(self) -> Iterator[bytes]:
        """Inflated pieces of the member that begins here."""
        unpack = zlib.decompressobj(31)
        pending = b""
        while not unpack.eof:
            raw = pending or self._raw()
            if not raw:
                raise EOFError("a record ends within its gzip member")
            piece = unpack.decompress(raw, self.chunk)
            pending = unpack.unconsumed_tail
            if piece:
                yield piece
        self.left = unpack.unused_data

    def __iter__(self) -> Iterator[dict]:
        while True:
            self.left = self._raw()
            if not self.left:
                return
            yield self._record()

    def _record(self) -> dict:
        pieces, buffer = self._member(), b""
        while b"\r\n\r\n" not in buffer:
            buffer += next(pieces)
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(header["content-length"])
        block, payload, http, seen, n_payload = hashlib.sha1(), hashlib.sha1(), b"", 0, 0
        in_payload, tail = False, b""
        while True:
            part = buffer[: length - seen]
            tail += buffer[len(part) :]
            seen += len(part)
            block.update(part)
            if in_payload:
                payload.update(part)
                n_payload += len(part)
            else:
                http += part
                if b"\r\n\r\n" in http:
                    http, _, part = http.partition(b"\r\n\r\n")
                    in_payload = True
                    payload.update(part)
                    n_payload += len(part)
            buffer = next(pieces, None)
            if buffer is None:
                break
        if seen != length or tail != b"\r\n\r\n":
            raise ValueError("the block does not end where Content-Length says")
        told = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]))
        sha = lambda h: base64.b32encode(h.digest()).decode()
        revisit = header["warc-type"] == "revisit"
        good = header["warc-block-digest"] == "sha1:" + sha(block) and (revisit or header["warc-payload-digest"] == "sha1:" + sha(payload))
        return header | {"payload_bytes": int(told["content-length"]) if revisit else n_payload, "verified": good}


def _of_id(value: str | None):
    return None if value is None or value == _NULL else unquote(value[len("<urn:page:") : -1])


_READ = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("verified", pa.bool_())])


def _reader(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            with open_input(path) as stream:
                for r in Reader(stream):
                    rows.append(
                        {
                            "page_id": _of_id(r["warc-record-id"]),
                            "payload_bytes": r["payload_bytes"],
                            "payload_digest": r["warc-payload-digest"].removeprefix("sha1:"),
                            "record_type": r["warc-type"],
                            "refers_to": _of_id(r.get("warc-refers-to")),
                            "url": r["warc-target-uri"],
                            "verified": r["verified"],
                        }
                    )
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _READ)


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives, digests verified."""
    files = max(1, manifest.count())
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, verified boolean"
    return manifest.repartition(files, "path").select("path").mapInArrow(_reader, schema)
