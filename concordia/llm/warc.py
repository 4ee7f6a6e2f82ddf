"""WARC archives with an index first: every record's place is written before anything is read, and selected records come
back through coalesced byte ranges.

Writers append one gzip member a record to archives in a shared folder, each attempt to files of its own, so a retried
task leaves only files that no index row names. Files are opened through ``pyarrow.fs`` and may be in any store that it
knows (the folder's URI says which).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.common import fresh_path, materialize

INDEX = "archive string, offset long, length long, url string, payload_digest string, payload_length long, record_type string, page_id long, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_length long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed when it has so many bytes; a range read has at most about RANGE_BYTES, over gaps of at most GAP_BYTES.
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 64 << 10
#: Compressed bytes that a task reads back: TASK_BYTES, or down to LEAST_BYTES where all cores aren't busy otherwise.
TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _uri(url: str) -> str:
    """A header value must stay on its line: control characters are percent-encoded, and so is the percent sign of such URLs."""
    if not re.search(r"[\x00-\x1f\x7f]|^\s|\s$|%00!", url):
        return url
    return "%00!" + re.sub(r"[\x00-\x20%\x7f\x85\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _url(value: str | None) -> str | None:
    if value is None or not value.startswith("%00!"):
        return value
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value[4:].encode()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, not compressed: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_digest, payload_length, payload of one record; checks a response's digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    found, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
    if kind == "response" and (len(payload) != n or digest(payload) != found):
        raise ValueError(f"record {h['warc-record-id']}: the payload doesn't have its digest")
    return _page(h["warc-record-id"]), _url(h.get("warc-target-uri")), kind, _page(h.get("warc-refers-to")), found, n, payload if kind == "response" else None


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """sha1, n, first: payloads of at least min_bytes that several rows have, with the least page_id among them.

    Computed from digests alone; counts are aggregated before the shuffle, so a very common payload is no hot spot.
    """
    return pages.groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) & (F.col("n") >= min_bytes) & F.col("first").isNotNull()).select("sha1", "n", "first")


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) to archives in folder; the index is a shared table.

    Of rows with equal payloads of at least min_bytes that with the least page_id is the response, the others are
    revisits of it; repeated rows of that page_id are all responses. A null html is an empty payload, a null url has no
    target URI, a null page_id stays null and never stands for others. A record is compressed and read back whole, so a
    very long page needs memory for itself alone. Only page_id, url and html are read, so other columns cannot clash;
    an empty table writes no archive.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = materialize(revisits(rows.select("page_id", "sha1", "n"), min_bytes), "revisits")
    marked = rows.join(first, ["sha1", "n"], "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first")).alias("refers_to"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, rows = None, "", 0, []
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                sha = digest(payload)
                member = gzip.compress(record(page_id, url, payload, sha, refers, date), 6, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), url, sha, len(payload), "response" if refers is None else "revisit", page_id, refers))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out = None
            if rows:
                if out is not None:
                    out.flush()
                yield flush()
        if out is not None:
            out.close()

    return materialize(marked.mapInArrow(run, INDEX), "warc-index")


def _tasks(selected: DataFrame) -> int:
    """Tasks for reading the selected records, by their bytes: the few bytes of the index say nothing about the work."""
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = selected.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // TASK_BYTES), min(4 * cores, -(-total // LEAST_BYTES)))


def ranges(selected: DataFrame, *, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """archive, start, end, records [(offset, length)]: the selected index rows in byte order, neighbours in one range.

    A range ends at a gap of more than gap_bytes and at every multiple of range_bytes. Archives are bounded, so the
    sort of one archive's rows is, too. A record that is selected twice is read once and returned twice.
    """
    w = Window.partitionBy("archive").orderBy("offset", "length")
    end = F.col("offset") + F.col("length")
    parts = selected.select("archive", "offset", "length").withColumn("__end", F.lag(end).over(w)).withColumn("__part", F.lag(F.expr(f"offset div {range_bytes}")).over(w))
    new = F.when(F.col("__end").isNull() | (F.col("offset") - F.col("__end") > gap_bytes) | (F.expr(f"offset div {range_bytes}") != F.col("__part")), 1).otherwise(0)
    numbered = parts.withColumn("__range", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("archive", "__range").agg(F.min("offset").alias("start"), F.max(end).alias("end"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("__range")


def read_records(selected: DataFrame, folder: str, **how) -> DataFrame:
    """The records of the selected index rows, read by coalesced ranges and parsed; a revisit's payload is null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for archive, start, end, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{archive}") as f:
                    raw = f.read_at(end - start, start)
                rows = [parse(gzip.decompress(raw[r["offset"] - start : r["offset"] - start + r["length"]])) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    tasks = _tasks(selected)
    if tasks <= 4 * selected.sparkSession.sparkContext.defaultParallelism:  # small ranges, so that every task has some
        how.setdefault("range_bytes", LEAST_BYTES)
    return ranges(selected, **how).repartition(tasks, "archive", "start").mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, **how) -> DataFrame:
    """write_archives() into a fresh folder of the shared one, then read_records() of the whole index."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, **how), folder)
