"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing gives one index row per record: archive, offset, length, URL, digest and kind. Each record is a gzip
member of its own, so any byte range of the index can be read alone. Reading sorts the selected index rows by
archive and offset, joins neighbouring ranges into larger reads, and checks each payload against its digest.

An archive's name is new for each attempt of a task, and only names in the written index count, so a lost
executor or a repeated attempt leaves at most a file that nobody reads. Archives lie in the shared folder, which
pyarrow.fs opens by its URI (file, hdfs, s3, gs); pages themselves are read by Spark alone.

Defined cases: a null html is an empty payload; a null or odd URL is written escaped; of equal payloads of at
least `least_bytes`, rows with the smallest page_id are responses (all of them if it repeats), and a null
page_id is larger than any; smaller payloads are responses always; an empty table gives no archive; other
columns are ignored, but for `fetched_at` (a timestamp), which gives records their date where it is there.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.scratch import Scratch

LEAST_BYTES, ARCHIVE_BYTES, READ_BYTES, READ_GAP, TASK_BYTES, LEVEL = 100, 256 << 20, 8 << 20, 64 << 10, 16 << 20, 4
DATE = "2024-01-01T00:00:00Z"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
_INDEX_SQL = "page_id long, url string, archive string, offset long, length long, digest string, record_type string"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_RECORD_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def escaped_url(url: str | None) -> str:
    """A URL as one header line: bytes that no URI may hold are percent-encoded, what is encoded already stays."""
    return "".join(c if "!" <= c <= "~" and c not in '"<>\\^`{|}' else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def exact_url(url: str) -> str:
    """The same with % itself encoded, so that it can be read back."""
    return escaped_url(url.replace("%", "\0")).replace("%00", "%25") if "\0" not in url else "".join(f"%{b:02X}" for b in url.encode())


def read_url(value: str) -> str:
    return unquote(value, errors="strict")


def _headed(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    return _headed(["WARC-Type: warcinfo", f"WARC-Record-ID: {new_id()}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"software: skarn\r\nformat: WARC file version 1.1\r\n")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None, date: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has HTTP headers only and says what it repeats."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = escaped_url(url)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {new_id()}",
        f"WARC-Date: {date or DATE}",
        f"WARC-Target-URI: {target or 'urn:skarn:none'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Target-URI: {escaped_url(refers_url) or 'urn:skarn:none'}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([] if page_id is None else [f"X-Page: {page_id}"]),
        *([] if url is None else [f"X-URL: {exact_url(url)}"] if target != url or "%" in url or not url else []),
        *(["X-No-URL: 1"] if url is None else []),
        "Content-Type: application/http; msgtype=response",
    ]
    return _headed(lines, http if revisit else http + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; a record of another kind has its block as payload."""
    lines = lambda x: {k: v.lstrip(" ") for k, v in (h.split(":", 1) for h in x.decode().split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    warc = lines(head)
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than its header says")
    if not warc["Content-Type"].startswith("application/http"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, lines(http), payload


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _member(raw: bytes, level: int) -> bytes:
    """A gzip member of its own."""
    press = zlib.compressobj(level, wbits=31)
    return press.compress(raw) + press.flush()


def _writer(root: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        offset = 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to, refers_url, date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= archive_bytes:
                    if out:
                        out.close()
                    store, path = _open(root)
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    first = _member(info(name), level)
                    out.write(first)
                    offset = len(first)
                raw = _member(record(page_id, url, (html or "").encode(), digest, refers_to, refers_url, date), level)
                out.write(raw)
                rows.append((page_id, url, name, offset, len(raw), digest, "response" if refers_to is None else "revisit"))
                offset += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_INDEX)], schema=_INDEX)
        if out:
            out.close()

    return run


def write(spark: SparkSession, pages: DataFrame, root: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write a record for each row under root; returns the index, which is written beside the archives."""
    store, path = _open(root)
    store.create_dir(f"{path}/archives", recursive=True)
    html = F.col("html").cast("string")
    date = F.date_format(F.to_utc_timestamp(F.col("fetched_at").cast("timestamp"), spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "fetched_at" in pages.columns else F.lit(None).cast("string")
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.coalesce(html, F.lit("")), 256).alias("digest"), date.alias("date"))
    # Written before it is joined: the join then lies right on its two exchanges, where a hot digest can be split.
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    one.groupBy("digest").agg(least.alias("least")).select("digest", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url")).write.parquet(f"{root}/first")
    first = spark.read.schema("digest string, first long, first_url string").parquet(f"{root}/first")
    large = F.octet_length("html") >= least_bytes
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed = one.join(first, "digest").select("page_id", "url", "html", "digest", refers.alias("refers_to"), "first_url", "date")
    index = typed.mapInArrow(_writer(f"{root}/archives", archive_bytes, level), _INDEX_SQL)
    index.write.parquet(f"{root}/index")
    return spark.read.schema(_INDEX_SQL).parquet(f"{root}/index")


def coalesced(ranges: list[tuple[str, int, int]], most: int, gap: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (archive, offset, length) rows as larger reads (archive, start, end, rows of it)."""
    name, start, end, rows = None, 0, 0, []
    for i, (archive, offset, length) in enumerate(ranges):
        if rows and archive == name and 0 <= offset - end <= gap and offset + length - start <= most:
            rows.append(i)
        else:
            if rows:
                yield name, start, end, rows
            name, start, rows = archive, offset, [i]
        end = offset + length
    if rows:
        yield name, start, end, rows


def _reader(root: str, most: int, gap: int, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(root)
        opened, name = None, None
        for batch in batches:
            ranges = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for archive, start, end, which in coalesced(ranges, most, gap):
                if archive != name:
                    if opened:
                        opened.close()
                    opened, name = store.open_input_file(f"{path}/{archive}"), archive
                opened.seek(start)
                data = opened.read(end - start)
                rows = []
                for i in which:
                    at = ranges[i][1] - start
                    warc, http, payload = parse_record(zlib.decompress(data[at : at + ranges[i][2]], wbits=31))
                    told = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = warc["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"the payload at {archive}:{ranges[i][1]} does not match its digest")
                    number = lambda k, h=warc: int(h[k]) if k in h else None
                    size = int(http["Content-Length"])
                    if not revisit and len(payload) != size:
                        raise ValueError(f"the payload at {archive}:{ranges[i][1]} has another length than its header says")
                    rows.append((number("X-Page"), None if "X-No-URL" in warc else read_url(warc["X-URL"]) if "X-URL" in warc else warc["WARC-Target-URI"], size, told, warc["WARC-Type"], number("X-Refers-To-Page"), payload if with_payload and not revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_RECORD)], schema=_RECORD)
        if opened:
            opened.close()

    return run


def read(index: DataFrame, root: str, with_payload: bool = True, most: int = READ_BYTES, gap: int = READ_GAP, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records that the rows of index name, dealt to tasks by the bytes that they will read."""
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    where = index.select("archive", "offset", "length").repartitionByRange(1 + total // task_bytes, "archive", "offset").sortWithinPartitions("archive", "offset")
    return where.mapInArrow(_reader(f"{root}/archives", most, gap, with_payload), _RECORD_SQL)


def resolved(spark: SparkSession, records: DataFrame) -> DataFrame:
    """records with the payloads, sizes and digests of revisits taken from the responses that they refer to.

    A revisit whose response is missing has nulls there. A response that many revisits name is a hot key of a join
    that lies right on its two exchanges, so it can be split.
    """
    revisits, own = records.where("record_type = 'revisit'"), records.where("record_type = 'response'")
    named = own.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("is")).agg(F.first("payload_bytes").alias("bytes"), F.first("payload").alias("content"))
    named = Scratch(spark, "warc-named").cut(named, "named")
    told = revisits.join(named, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("is")), "left")
    return own.unionByName(told.select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("is").alias("payload_digest"), "record_type", "refers_to", F.col("content").alias("payload")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records, and read back; what a revisit says is that of the response it names."""
    scratch = Scratch(spark, "warc")
    index = write(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.root)
    records = scratch.cut(read(index, scratch.root, with_payload=False), "records")
    return resolved(spark, records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
