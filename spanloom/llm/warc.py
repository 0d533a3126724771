"""WARC archives with an index that comes first.

Writing yields one index row for each record: archive, offset, length, URL, digest. Archives have names of their own for
each attempt of a task, and only an index that was written whole says which count, so a lost executor leaves at most a
file that nothing refers to. Reading takes any selection of index rows, sorts them by archive and offset, joins near
byte ranges into one read, and parses the records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_limits, lookup, materialize, scratch_path, tidy

#: Records nearer than GAP bytes are read together, up to SPAN bytes; an archive is closed after ROLL bytes.
GAP, SPAN, ROLL = 1 << 16, 8 << 20, 1 << 30
#: Archive bytes that one task reads, about.
TASK_BYTES = 64 << 20
_LINE = re.compile(r"[\x00-\x20\x7f]")
INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(uri: str):
    """(file system, path within it) of a folder or file named by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    """One record as a gzip member: a response with the payload, or a revisit that names the response of equal payload.
    Blanks and control characters in a URL are percent-encoded."""
    target = _LINE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(head).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse_record(member: bytes) -> dict:
    """The fields of one record; the payload of a revisit is empty, its size and digest are the full payload's."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a WARC record's payload doesn't match its digest")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", field.get(name, ""))) else None
    return {"page_id": number("WARC-Record-ID"), "url": field["WARC-Target-URI"], "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": digest, "payload": payload}


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the largest page_id of the rows with this payload, where it is another one and the payload
    has at least `min_bytes` bytes. Digests are written once; only those that occur twice are looked up, a common one by
    broadcast. Where the table of revisits is too large to broadcast, the last join shuffles the payloads once."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    digests = materialize(keyed.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha"), "digests")
    copies = materialize(digests.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1"), "copies")
    slim = lookup(digests, copies, ["sha"], "n").where("page_id is null or page_id <> first").select("page_id", "sha", "first").distinct()
    slim = materialize(slim, "revisits")
    same = keyed.alias("k").join(slim.alias("s"), F.col("k.page_id").eqNullSafe(F.col("s.page_id")) & (F.col("k.sha") == F.col("s.sha")), "left")
    return same.select("k.page_id", "k.url", "k.payload", F.col("s.first").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3, roll: int = ROLL) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into archives in `folder`; returns the index, written.

    Null html is an empty payload; a null url an empty target; a null page_id never is the response that others name,
    unless all of its payload are null. Rows that repeat the largest page_id of a payload are responses all; other
    rows that repeat a page_id are marked each by its own payload. Other columns are not looked at. Every row
    has a record; an empty table has an empty index.
    """
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                    page_id, url, payload, refers = page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py()
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        else:
                            store.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    digest = payload_digest(payload)
                    member = record_bytes(page_id, url, payload, digest, refers, date, level)
                    out.write(member)
                    rows.append((page_id, url, "response" if refers is None else "revisit", refers, len(payload), digest, name, at, len(member)))
                    at += len(member)
                if out is not None:
                    out.flush()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return materialize(mark_revisits(pages, min_bytes).mapInArrow(tidy(run), INDEX), "warc-index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
_RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_RECORD_TYPES = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]] for x in RECORD.split(", ")]


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) pairs as reads (from, to, the pairs within)."""
    reads: list[list] = []
    for offset, length in ranges:
        if reads and offset - reads[-1][1] <= gap and max(reads[-1][1], offset + length) - reads[-1][0] <= span:
            reads[-1][1] = max(reads[-1][1], offset + length)
            reads[-1][2].append((offset, length))
        else:
            reads.append([offset, offset + length, [(offset, length)]])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of the selected index rows, read and parsed; each payload is checked against its digest. Without
    `payloads` that column is null. Index rows are dealt by stretches of `task_bytes` bytes of an archive, so tasks follow
    the size of the archives, not of the index."""
    arrow_limits(index.sparkSession)
    rows = index.select("archive", "offset", "length", F.floor(F.col("offset") / task_bytes).alias("stretch"))
    stretches = rows.select("archive", "stretch").distinct().count()
    sorted_rows = rows.repartition(max(2 * stretches, 1), "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        name, source = None, None
        for b in batches:
            todo: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                todo.setdefault(archive, []).append((offset, length))
            for archive, ranges in todo.items():
                if archive != name:
                    name, source = archive, store.open_input_file(f"{path}/{archive}")
                for start, end, inside in coalesce_ranges(ranges, gap, span):
                    data = source.read_at(end - start, start)
                    got = [parse_record(data[o - start : o - start + n]) for o, n in inside]
                    if not payloads:
                        got = [r | {"payload": None} for r in got]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in zip(_RECORD_NAMES, _RECORD_TYPES, strict=True)], _RECORD_NAMES)

    return sorted_rows.mapInArrow(tidy(run), RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as its archive has it."""
    folder = folder or scratch_path(pages.sparkSession, "archives")
    index = write_archives(pages.select("page_id", "url", "html"), folder, **how)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
