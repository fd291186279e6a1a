"""Operator 9: WARC archives, written with revisit records and read in splits."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

#: The gzip magic number, which starts each member.
MAGIC = b"\x1f\x8b\x08"
#: Bytes of records that a task holds at a time.
HELD = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _gzip(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte: its last byte is the high one of the size, and an empty member follows where that isn't zero."""

    def member(x: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    out = member(data)
    return out if out[-1] == 0 else out + member(b"")


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: an HTTP response with the payload, or, without one, the headers of a revisit; size is the full payload's."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}"] + ([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A row of READ from a record; payload and its length and digest are those of the full payload, which a revisit states only."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if k in fields else None
    url = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        size, payload = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), None
    else:
        size, real = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if real != stated:
            raise ValueError(f"payload digest {real} of a record that states {stated}")
    return number("X-Page-ID"), url, payload, size, stated, fields["WARC-Type"], number("X-Refers-To-Page-ID")


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes a record per row of pages (page_id, url, html) to archives below path, each a series of gzip members.

    Of rows with equal payloads (UTF-8 html; null: empty) of at least `least` bytes, one with the smallest page_id (nulls
    last) is a response and the others are revisits of it; of rows that repeat that page_id, one of the smallest url is.
    An empty table writes archives without records. Other columns of pages are not read. Archives are written by Spark's
    text writer, whose committer lets only whole tasks' files appear, on any file system: a member's last byte, zero, is
    its line separator. Payloads are joined with the few digests that occur twice, so copies meet there in one row; rows
    that repeat page_id, url and html are counted where they are read, and one payload from each partition travels.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    each = rows.filter(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "n")).alias("first")
    copied = written(each.groupBy("digest").agg(F.sum("n").alias("rows"), first).filter("rows > 1").select("digest", "first"))
    rows = rows.join(copied, "digest", "left")
    is_first = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first.page_id"))
    out = ["page_id", "url", "payload", "size", "digest", "refers_to"]
    shape = lambda df, response: df.withColumns({"payload": F.when(response, F.col("payload")), "refers_to": F.col("first.page_id")}).select(*out)
    if copied.filter("first.n > 1").isEmpty():
        rows = shape(rows, is_first)
    else:  # of rows that repeat the smallest page_id, one is the response
        tie = is_first & F.coalesce(F.col("first.n") > 1, F.lit(False))
        ties = rows.filter(tie).groupBy("digest", "page_id", "url", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"), F.first("size").alias("size"))
        ties = written(ties)
        lead = ties.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull(), "url", "part")).alias("lead"))
        ties = ties.join(lead, "digest").withColumn("leads", F.col("url").eqNullSafe(F.col("lead.url")) & (F.col("part") == F.col("lead.part")))
        refers = ties.withColumn("refers_to", F.col("page_id"))
        again = F.explode(F.sequence(F.lit(1), (F.col("n") - F.col("leads").cast("int")).cast("int")))
        more = refers.filter("n > 1 or not leads").withColumns({"again": again, "payload": F.lit(None).cast("binary")})
        rows = shape(rows.filter(~tie), is_first).union(refers.filter("leads").select(*out)).union(more.select(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, u, p, n, d, to in zip(*[batch.column(k) for k in range(6)], strict=True):
                digest = base64.b32encode(bytes.fromhex(d.as_py())).decode()
                out.append(_gzip(record(i.as_py(), u.as_py(), p.as_py(), n.as_py(), digest, to.as_py()))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    rows.mapInArrow(run, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


class Range:
    """The members of a range of an archive, from the pieces between the magic numbers that start in it.

    A magic number is a candidate only: it counts if what follows decodes to a WARC header; pieces are joined until the
    member ends, and its checksum is verified. Where a member holds a magic number of its own just behind the end of a
    range, its rest lies in the next one: then tail has this range's part of it, and head what the next range can't place.
    """

    def __init__(self):
        self.head, self.tail = b"", b""
        self.begun = False  # whether a member has started here

    def add(self, piece: bytes) -> bytes | None:
        """The record that this piece completes; None if it doesn't, b"" for an empty member."""
        if self.tail:
            self.tail += MAGIC + piece
        elif not self.begun and not starts(MAGIC + piece):
            self.head += MAGIC + piece
            return None
        else:
            self.begun, self.tail = True, MAGIC + piece
        z = zlib.decompressobj(31)
        data = z.decompress(self.tail)
        if not z.eof:
            return None
        if z.unused_data:
            raise ValueError("bytes between the members of an archive")
        self.tail = b""
        return data


def starts(member: bytes) -> bool:
    """Whether bytes that begin with the magic number are the start of a record, or an empty member."""
    z = zlib.decompressobj(31)
    try:
        data = z.decompress(member, 64)
    except zlib.error:
        return False
    return data.startswith(b"WARC/1.") or z.eof and not data


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below path: page_id, url, payload (null without `payloads`), payload_bytes, payload_digest, record_type, refers_to.

    Spark's text source, with the magic number for its line separator, deals byte ranges to tasks on any file system that
    it can read: a task scans its range for the number and has the pieces that start inside. Members are validated by
    decoding them. What a false magic number leaves between two ranges is joined by archive afterwards.
    """
    pieces = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    names = [x.split()[0] for x in READ.split(", ")] + ["path", "start", "head", "tail", "begun"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]

    def row(data: bytes) -> tuple:
        out = parse(data)
        return out if payloads else (*out[:2], None, *out[3:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, at, here = 0, None, Range()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*map(list, zip(*rows, strict=True))], kinds, strict=True)], names=names)
            rows.clear()
            return out

        def ended() -> None:
            if at and (here.head or here.tail):
                rows.append((*[None] * 7, *at, here.head, here.tail, here.begun))

        for batch in batches:
            for piece, p, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (p, start) != at:
                    ended()
                    at, here = (p, start), Range()
                    if not start:  # what is before a file's first magic number
                        if len(piece.as_buffer()):
                            raise ValueError(f"{p} doesn't start with a gzip member")
                        continue
                if data := here.add(piece.as_py()):
                    rows.append((*row(data), *at, None, None, None))
                    held += len(data)
                    if held > HELD:
                        yield made()
                        held = 0
        ended()
        if rows:
            yield made()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, rest = [], b""
        for head, tail, begun in pdf.sort_values("start")[["head", "tail", "begun"]].itertuples(index=False):
            here = Range()
            here.begun = True
            for piece in (rest + head).split(MAGIC)[1:]:
                if data := here.add(piece):
                    rows.append(row(data))
            if begun and here.tail:
                raise ValueError("an archive's member has no end")
            rest = here.tail + tail
        if rest:
            raise ValueError("an archive's member has no end")
        return pd.DataFrame(rows, columns=names[:7]).astype({"page_id": "Int64", "refers_to": "Int64"})

    out = written(pieces.mapInArrow(run, f"{READ}, path string, start long, head binary, tail binary, begun boolean"))
    between = out.filter("start is not null and record_type is null").select("path", "start", "head", "tail", "begun").groupBy("path").applyInPandas(joined, READ)
    return out.filter("record_type is not null").select(*names[:7]).union(between)


def round_trip(pages: DataFrame, least: int = 0, payloads: bool = True) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; see write() and read()."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.warc.gz"
    write(pages, path, least)
    return read(spark, path, payloads)
