"""WARC archives, index first.

Writing: every task writes one archive of gzip members (one per record) under a name of its own and
returns an index row per record: archive, offset, length, URL, payload digest.  The checkpointed
index is the commit: a retried task writes another file, and only files in the index are read.

Reading: the selected index rows are dealt by archive, sorted by offset, and neighbouring ranges are
coalesced into single reads of bounded size.

Of records with equal payloads of at least ``least_bytes`` the one with the largest id is the response
and the others revisit it.  Digests are computed by Spark; the table of repeated digests is broadcast
only where its counted size allows, else joined by a shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_root

INDEX = "id bigint, url string, digest string, kind string, archive string, offset bigint, length bigint, slot bigint"
_INDEX = pa.schema([("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("kind", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("slot", pa.int64())])
#: Fixed value: the profile that WARC 1.1 names for revisits of identical payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(text: str) -> str:
    """A header value on one line: percent-encoded control characters and percent signs."""
    return "".join(f"%{b:02X}" if b < 0x20 or b == 0x25 or b == 0x7F else chr(b) for b in text.encode()).encode("latin-1").decode("utf-8")


def record(id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit without."""
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:sigloom:page:{'null' if id is None else id}>", f"WARC-Target-URI: {_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:sigloom:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of another length")
    return fields, rest[:n]


def write_archives(pages: DataFrame, *, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000, broadcast_rows: int = 50_000, level: int = 1) -> DataFrame:
    """Write every row as a record; returns the index (columns of ``INDEX``).

    A null payload or URL is empty; a null id is written as ``null`` and is never referred to; rows that
    repeat an id are records of their own, and if they tie for the largest id of a payload each is a
    response; an empty table writes nothing.
    """
    folder = f"{shared_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    base = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    again = base.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    again = cut(again)
    side = F.broadcast(again) if again.count() <= broadcast_rows else again
    rows = base.join(side, "digest", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, slot = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name, at = f"part-{slot:06d}-{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            made = []
            for i, u, p, d, r in zip(*(batch.column(k).to_pylist() for k in range(5))):
                raw = gzip.compress(record(i, u, p.encode(), d, r), level, mtime=0)
                out.write(raw)
                made.append((i, u, d, "response" if r is None else "revisit", f"{folder}/{name}", at, len(raw), slot))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, INDEX))


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads: begin, end, first range, last range + 1."""
    out = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= gap and max(out[-1][1], offset + length) - out[-1][0] <= most:
            begin, end, first, _ = out[-1]
            out[-1] = (begin, max(end, offset + length), first, i + 1)
        else:
            out.append((offset, offset + length, i, i + 1))
    return out


def read_records(index: DataFrame, *, gap: int = 64 << 10, most: int = 8 << 20, stretch: int = 32 << 20) -> DataFrame:
    """The records of the selected index rows, checked against their digests.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).  Rows
    are dealt by archive and stretch of ``stretch`` bytes, about one stretch of selected bytes to a task, and read in order
    of offset; ranges at most ``gap`` apart share a read of up to ``most`` bytes.  A response whose payload does not match its digest raises an error.
    """
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
    number = lambda s: None if s == "null" else int(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            at = 0
            while at < len(rows):
                archive = rows[at][0]
                stop = at
                while stop < len(rows) and rows[stop][0] == archive:
                    stop += 1
                if archive != held:
                    if file is not None:
                        file.close()
                    fs, path = pafs.FileSystem.from_uri(archive)
                    held, file = archive, fs.open_input_file(path)
                own = rows[at:stop]
                for begin, end, first, last in coalesced([r[1:3] for r in own], gap, most):
                    block, made = memoryview(file.read_at(end - begin, begin)), []
                    for _, offset, length, url in own[first:last]:
                        fields, body = parse(zlib.decompress(block[offset - begin : offset - begin + length], 31))
                        digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match")
                        of = lambda key: number(fields[key].removeprefix("<urn:sigloom:page:").removesuffix(">"))  # noqa: E731, B023
                        made.append((of("WARC-Record-ID"), url, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], of("WARC-Refers-To") if revisit else None, None if revisit else body.decode()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), kind)], schema=kind)
                at = stop
        if file is not None:
            file.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / stretch)
    dealt = index.select("archive", "offset", "length", "url").repartition(max(1, -(-total // stretch), index.sparkSession.sparkContext.defaultParallelism), "archive", part).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string")
