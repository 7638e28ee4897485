"""Web archives: one gzip member per record, written and read by Spark tasks.

Every task writes archives of its own below a shared folder and returns a row for each; the rows of tasks that succeeded
are the manifest, so files of lost or repeated attempts are never read. Readers deal byte ranges to tasks: a task looks
for the gzip magic, decodes a candidate to see whether a record's header follows, and owns the records that start
inside its range, whose rest it reads beyond it.

The folder must be one that pyarrow can open in all executors (a mounted path, or an hdfs, s3 or gs address).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm.common import shuffle_width
from reelmill.session import broadcast_if_small, cut_lineage

MAGIC = b"\x1f\x8b\x08"
SPLIT = 32 << 20
FILE_BYTES = 1 << 30  # a further archive is begun beyond this
SALTS = 16  # parts of a group of copies when they are joined to their response
DATE = "1970-01-01T00:00:00Z"  # the tables tell no time of retrieval
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("file string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, payload binary")
_URN = "urn:page:"
_BLOCK = 1 << 20  # read at once
_PIECE = 1 << 14  # decoded at once
_FIRST = b"WARC/1."
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def record_id(page_id: str | None) -> str:
    return f"<{_URN}{'' if page_id is None else 'id:' + quote(page_id, safe='')}>"


def page_of(name: str | None) -> str | None:
    """The page id in a record id; none for that of a null id and for foreign names."""
    found = re.fullmatch(f"<{_URN}id:(.*)>", name or "")
    return unquote(found[1]) if found else None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, response: str | None, revisit: bool) -> bytes:
    """The member of a page: its response, or a revisit that names the response and keeps the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _UNSAFE.sub(lambda m: quote(m[0]), url)),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("WARC-Refers-To", record_id(response) if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _member(headers, http if revisit else http + payload)


def _info() -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
               ("Content-Type", "application/warc-fields")]
    return _member(headers, b"format: WARC File Format 1.1\r\n")


def _archived(folder: str, file_bytes: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        out, name, size, n, done = None, "", 0, 0, []

        def close():
            out.close()
            done.append((f"{folder}/{name}", size, n))

        for batch in batches:
            for page_id, url, payload, response, revisit in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if out is None or size > file_bytes:
                    if out is not None:
                        close()
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    size = out.write(_info())
                size += out.write(page_record(page_id, url, payload, response, revisit))
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "n"])

    return of


def write_archives(df: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   text_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row below ``path`` and returns the manifest ``file, bytes, n``.

    Among rows of equal payloads of at least ``min_bytes`` bytes, that of the largest id is the response and the others are
    revisits of it; rows that repeat this id are responses too. Smaller payloads are responses. Null text: an empty
    payload; null url: no target; null ids sort below all others and have a name without id. Blanks and control characters of a
    url are written percent-encoded. An empty table gives no archives.
    """
    spark = df.sparkSession
    system, root = _opened(path)
    system.create_dir(f"{root}/archives", recursive=True)
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    alike = pages.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n"))
    alike = cut_lineage(alike.filter("n > 1").select("digest", "response"))
    # groups of copies may be large: their rows are spread over salts where the join shuffles them
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    told = alike.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grouped = salted.join(broadcast_if_small(told), ["digest", "salt"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")) & (F.octet_length("payload") >= min_bytes)
    rows = grouped.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("response").cast("string").alias("response"),
                          revisit.alias("revisit"))
    written = rows.mapInArrow(_archived(f"{path.rstrip('/')}/archives", file_bytes), "file string, bytes long, n long")
    written.write.parquet(f"{path.rstrip('/')}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, n`` of the archives that were completed below ``path``."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


class _Bytes:
    """Blocks of a file by offset, the last one kept."""

    def __init__(self, file: pa.NativeFile, block: int = _BLOCK):
        self.file, self.block, self.first, self.data = file, block, 0, memoryview(b"")

    def at(self, offset: int, n: int) -> memoryview:
        """Up to n bytes from an offset; none at the end of the file."""
        if not self.first <= offset < self.first + len(self.data):
            self.first, self.data = offset, memoryview(self.file.read_at(self.block, offset))
        return self.data[offset - self.first : offset - self.first + n]

    def find(self, offset: int, stop: int) -> int:
        """The first magic that starts in [offset, stop), else ``stop``."""
        while offset < stop:
            block = bytes(self.at(offset, _PIECE))
            if len(block) < len(MAGIC):  # across the end of a block
                block = self.file.read_at(len(MAGIC), offset)
                if len(block) < len(MAGIC):
                    return stop
            found = block.find(MAGIC)
            if found >= 0:
                return min(offset + found, stop)
            offset += len(block) - len(MAGIC) + 1
        return stop


def _begins(block: memoryview) -> bool:
    """Whether a gzip member starts here whose content begins as a record."""
    try:
        return zlib.decompressobj(31).decompress(block, len(_FIRST)) == _FIRST
    except zlib.error:
        return False


def _decoded(source: _Bytes, offset: int) -> tuple[bytes, int] | None:
    """The record of the member at an offset and where the member ends; None if no record's header can be decoded there.

    A member that begins as a record but is broken later is an error, not a loss.
    """
    if not _begins(source.at(offset, _PIECE)) and not _begins(memoryview(source.file.read_at(_PIECE, offset))):  # a block may end early
        return None
    unpacker, parts, at = zlib.decompressobj(31), [], offset
    while not unpacker.eof:
        block = source.at(at, _PIECE)
        try:
            if not block:
                raise zlib.error("the file ends inside a member")
            parts.append(unpacker.decompress(block))
        except zlib.error as broken:
            raise ValueError(f"broken member at byte {offset}") from broken
        at += len(block) - len(unpacker.unused_data)
    return b"".join(parts), at


def owned(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records whose members start in [start, stop)."""
    source, at = _Bytes(file), start
    while (at := source.find(at, stop)) < stop:
        found = _decoded(source, at)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError(f"record {fields.get('warc-record-id')} is shorter than its length")
    return fields, rest[:n]


def _row(file: str, offset: int, record: bytes, with_payload: bool) -> tuple | None:
    fields, block = parsed(record)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:"), len(payload)
    if kind == "revisit":  # the full payload is the response's; its length is in the HTTP header
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, payload = int(told[1]) if told else None, None
    elif digest and digest != _digest(payload):
        raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    return (file, offset, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            digest or (_digest(payload) if payload is not None else None), size, payload if with_payload else None)


def _scanned(with_payload: bool, portion: int = 4 << 20):
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for ranges in batches:
            for file, start, stop in zip(*(ranges.column(c).to_pylist() for c in ("file", "start", "stop"))):
                system, name = _opened(file)
                with system.open_input_file(name) as source:
                    for offset, record in owned(source, start, stop):
                        row = _row(file, offset, record, with_payload)
                        if row is None:
                            continue
                        rows.append(row)
                        size += 200 + (len(row[-1]) if row[-1] else 0)
                        if size > portion:
                            yield batch(rows)
                            rows, size = [], 0
        yield batch(rows)

    return of


def read_archives(files: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The responses and revisits of archives ``file, bytes``: ``RECORDS``, the payload null where it is not asked for.

    Ranges of ``split`` bytes are dealt to tasks, so one large archive is read by many. Other kinds of records are skipped; a
    broken member or a payload that differs from its digest ends the job. No files give no rows.
    """
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = files.filter("bytes > 0").select("file", "bytes", start.alias("start")).select(
        "file", "start", F.least(F.col("start") + split, "bytes").alias("stop"))
    # a fixed number of partitions, or adaptive execution packs the short list of ranges into one task
    dealt = ranges.repartition(shuffle_width(files.sparkSession), "file", "start")
    return dealt.mapInArrow(_scanned(with_payload), RECORDS)


def page_rows(records: DataFrame, id_type: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records, ids from their names."""
    id_of = F.udf(page_of) if id_type == "string" else lambda c: F.regexp_extract(c, f"^<{_URN}id:(.*)>$", 1)
    number = lambda c: F.when(F.col(c).contains(f"{_URN}id:"), id_of(F.col(c)).cast(id_type))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          number("refers_to").alias("refers_to"))
