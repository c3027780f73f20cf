"""WARC archives: one gzip member per record, written and read sequentially.

A record's block is an HTTP response: head, empty line, payload. Of records with equal
payloads of at least ``shortest`` bytes, the one with the smallest key is a response; the
others are revisits, whose block is the HTTP head alone and whose header names the response
and the digest of the full payload. Every task streams its rows into archives of bounded
size and returns manifest rows, so archives of lost or repeated attempts are never read.

The reader decompresses incrementally, takes as many bytes as Content-Length says, checks
that the record and its gzip member end there, and verifies block and payload digests. It
holds one chunk at a time, a header of any length, and a payload only where payloads are asked for.

Defined results: a NULL payload is empty; NULL keys are read back as NULL and are responses
only if their group has no other key; equal keys with equal payloads are all responses; an
empty table gives no archive and no rows; addresses are percent-encoded where a header
could not hold them; other columns are not stored. Damaged archives raise ``WarcError``.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, opened, shared_folder

CHUNK = 1 << 16
#: Compressed size after which a task starts its next archive.
ARCHIVE_BYTES = 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAFE = "%/:?#[]@!$&'()*+,;=~-._"


class WarcError(ValueError):
    """An archive is cut off, badly framed, or its digests do not match."""


def with_revisits(pages: DataFrame, key: str, payload: str, shortest: int) -> DataFrame:
    """(key, payload bytes, digest, first): ``first`` is the response of a revisit, else NULL."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("order"), body.alias("body"), "url").withColumn(
        "digest", F.sha2("body", 256)
    )
    # One row per digest and task before the shuffle, and only digests that occur twice are joined.
    groups = (
        rows.where(F.octet_length("body") >= shortest)
        .groupBy(F.col("digest").alias("copied"))
        .agg(F.min("order").alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("copied", F.col("least").cast("string").alias("least"))
    )
    joined = rows.join(groups, F.col("digest") == F.col("copied"), "left")
    other = F.col("least").isNotNull() & ~F.col("key").eqNullSafe(F.col("least"))
    return joined.select("key", "url", "body", "digest", F.when(other, F.col("least")).alias("first"))


def record(key: str | None, url: str | None, body: bytes, digest: str, first: str | None) -> bytes:
    """One record, not yet compressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    if first is None:
        block += body
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{quote(key or '')}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(first)}>", f"WARC-Profile: {PROFILE}"]
    head += [
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", shortest: int = 100, level: int = 4) -> DataFrame:
    """Write archives below ``folder``; returns the manifest (file, n_records)."""
    rows = with_revisits(pages, key, payload, shortest)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, name, written, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "body", "digest", "first")), strict=True):
                if out is None:
                    name = attempt_name(f"{folder}/part-{part:06d}-{len(done):04d}", ".warc.gz")
                    fs, where = opened(name)
                    out, written, records = fs.open_output_stream(where), 0, 0
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(record(*row)) + member.flush()
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        if done:
            files, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"file": list(files), "n_records": list(counts)})

    files = rows.mapInArrow(run, "file string, n_records long").collect()  # one row per archive
    return pages.sparkSession.createDataFrame(files, "file string, n_records long")


class Records:
    """Iterates over the records of one archive stream."""

    def __init__(self, stream):
        self.stream, self.raw, self.plain, self.member = stream, b"", b"", None

    def _more(self) -> bool:
        """Decompress one more chunk of the current member; False at the member's end."""
        if self.member.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise WarcError("archive ends inside a record")
        try:
            self.plain += self.member.decompress(self.raw, CHUNK)
        except zlib.error as e:
            raise WarcError(str(e)) from None
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def _line_block(self) -> bytes:
        """Bytes up to and without the next empty line."""
        seen = 0
        while (at := self.plain.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.plain) - 3)
            if not self._more():
                raise WarcError("record without the end of its header")
        out, self.plain = self.plain[:at], self.plain[at + 4 :]
        return out

    def _chunks(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if not self.plain and not self._more():
                raise WarcError("record shorter than its Content-Length")
            piece, self.plain = self.plain[:n], self.plain[n:]
            n -= len(piece)
            if piece:
                yield piece

    def __iter__(self):
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    return
            self.member, self.plain = zlib.decompressobj(31), b""
            yield self._record_head()
            # Whoever iterates has taken the block through ``block()``.
            if b"".join(self._chunks(4)) != b"\r\n\r\n" or self.plain:
                raise WarcError("record longer than its Content-Length")
            while self._more():
                if self.plain:
                    raise WarcError("more than one record in a gzip member")

    def _record_head(self) -> dict[str, str]:
        lines = self._line_block().decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("not a WARC record")
        self.head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        return self.head

    def block(self, keep: bool) -> tuple[int, str, bytes | None]:
        """(payload bytes, payload digest, payload) of the current record, verified."""
        try:
            size = int(self.head["content-length"])
        except (KeyError, ValueError):
            raise WarcError("no Content-Length") from None
        whole, body, parts, head, taken = hashlib.sha256(), hashlib.sha256(), [], b"", 0
        in_body = False
        for piece in self._chunks(size):
            whole.update(piece)
            if not in_body:
                head += piece
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_body, piece, head = True, head[at + 4 :], head[:at]
            body.update(piece)
            taken += len(piece)
            if keep:
                parts.append(piece)
        if not in_body:
            raise WarcError("block without an HTTP head")
        if f"sha256:{whole.hexdigest()}" != self.head.get("warc-block-digest"):
            raise WarcError("block digest does not match")
        lines = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
        declared = int({k.strip().lower(): v for k, _, v in lines}.get("content-length", -1))
        digest = self.head.get("warc-payload-digest", "")
        if self.head.get("warc-type") == "revisit":
            if taken:
                raise WarcError("revisit with a payload")
            return declared, digest.removeprefix("sha256:"), None
        if declared != taken or f"sha256:{body.hexdigest()}" != digest:
            raise WarcError("payload does not match its digest or length")
        return taken, body.hexdigest(), b"".join(parts) if keep else None


def _key(urn: str | None) -> str | None:
    from urllib.parse import unquote

    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) or None if urn else None


def read(manifest: DataFrame, key: str = "page_id", key_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """(key, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) per record."""
    names = ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers", *(["payload"] if payloads else [])]
    schema = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers string"
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]

    def run(batches):
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, where = opened(name)
                rows, total, held = [], 0, 0
                with fs.open_input_stream(where) as stream:
                    records = Records(stream)
                    for head in records:
                        size, digest, body = records.block(payloads)
                        row = (_key(head.get("warc-record-id")), head.get("warc-target-uri"), size, digest, head.get("warc-type"), _key(head.get("warc-refers-to")))
                        rows.append((*row, body) if payloads else row)
                        total, held = total + 1, held + len(body or b"")
                        if len(rows) == 4096 or held > 1 << 24:
                            yield _batch(rows, names, types)
                            rows, held = [], 0
                if total != n:
                    raise WarcError(f"{name}: {total} records instead of {n}")
                if rows:
                    yield _batch(rows, names, types)

    count = max(1, manifest.count())
    rows = manifest.repartition(min(count, 4096), "file").mapInArrow(run, schema + (", payload binary" if payloads else ""))
    return rows.select(
        F.col("key").cast(key_type).alias(key),
        "url",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers").cast(key_type).alias("refers_to"),
        *(["payload"] if payloads else []),
    )


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def written(pages: DataFrame, **options) -> DataFrame:
    """``write`` into a fresh folder below the shared one."""
    return write(pages, shared_folder(pages.sparkSession, "warc"), **options)
