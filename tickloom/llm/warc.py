"""Pages as WARC archives with an index, and reads of selected records by coalesced byte ranges.

Writing: a task writes archive files of its own, each record a gzip member, and gives back one index row per
record: file, offset, length, URL, digest and what it is. Only the index of tasks that succeeded is kept, so a
file left behind by a lost or repeated attempt is never read. Reading: index rows are chosen first, dealt by
file and stretch of a file, sorted by offset, and neighbouring ranges are fetched by one read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged
from tickloom.session import shared_folder

LEAST_REVISITED = 100  # payloads of fewer bytes are always stored
HOT_DIGESTS = 1_000  # payloads with the most copies, joined by broadcast; a row of it has fixed size
FILE_BYTES = 256 << 20  # a task begins a new archive file beyond this
STRETCH_BYTES = 64 << 20  # of a file, read by one task
GAP_BYTES = 64 << 10  # ranges this near are read in one go
READ_BYTES = 8 << 20  # at most, in one go, unless a single record is longer
SLICE_ROWS = 64  # rows turned into records at a time
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # of records, where the input has no time; the same input gives the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "file string, offset long, length long, url string, digest string, page_id long, row long, record_type string, "
    "payload_bytes long, refers_to long, first_row long"
)


@dataclass
class Archive:
    """``folder`` holds the WARC files, ``index`` one row per record (columns of ``INDEX``)."""

    folder: str
    index: DataFrame


# --- records, inside the tasks ---


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None).encode("utf-8")


def _one_line(url: str | None) -> str | None:
    """A URL as a header value: control characters and line ends are percent-encoded, the rest stays."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def record(url: str | None, payload: bytes, digest: str, page_id: int | None, row: int, refers: tuple[int | None, int] | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of the page ``refers`` without one.

    A revisit keeps the HTTP head, whose Content-Length is that of the payload it does not repeat.
    """
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if refers else http + payload
    head = b"WARC/1.1\r\n" + _head([
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", _record_id(page_id, row)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if refers else None),
        ("WARC-Refers-To", _record_id(*refers) if refers else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ])
    return head + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {n.strip().lower(): v.strip() for n, v in pairs}


def parse_record(data: bytes) -> dict:
    """Fields and payload of one record; raises ValueError where lengths do not fit."""
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields["content-length"])
    if not head.startswith(b"WARC/") or not found or len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not one whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = int(_fields(http)["content-length"])
    revisit = fields["warc-type"] == "revisit"
    if not revisit and stated != len(payload):
        raise ValueError("payload shorter or longer than its head says")
    refers = fields.get("warc-refers-to")
    page, row = refers[len("<urn:page:") : -1].split(":") if refers else ("", "")
    return {
        "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "payload": None if revisit else payload,
        "payload_bytes": stated, "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "refers_to": int(page) if page else None, "first_row": int(row) if row else None,
    }


# --- roles ---


def with_roles(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """``pages`` (``row``, ``page_id``, ``digest``, ``bytes`` and more) with the page a record revisits.

    ``first_id`` and ``first_row`` are null for what is stored. Of equal payloads of at least ``least`` bytes
    the smallest page id is stored (null ids last, of one id the first row). Copies are counted before
    anything is joined; the payloads with most copies are joined by broadcast, the others by shuffle.
    """
    firsts = staged(
        pages.filter(F.col("bytes") >= least).groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min(F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "row")).alias("first"))
        .filter("copies > 1")
        .select("digest", "copies", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    hot = F.broadcast(staged(firsts.orderBy(F.desc("copies"), "digest").limit(HOT_DIGESTS).drop("copies")))
    rest = firsts.join(hot.select("digest"), "digest", "left_anti").drop("copies")
    often = pages.join(hot, "digest")
    seldom = pages.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left")
    other = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row")) & (F.col("bytes") >= least)
    return often.unionByName(seldom).withColumns(
        {"revisits": other, "first_id": F.when(other, F.col("first_id")), "first_row": F.when(other, F.col("first_row"))}
    )


# --- writing and reading ---


def write_warc(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, least: int = LEAST_REVISITED
) -> Archive:
    """One record per row of ``pages`` in archives below ``folder`` (by default in the shared folder), with an index.

    A null html is an empty payload, a null URL leaves the header out, repeated rows are records of their
    own, other columns are not written. An empty table gives an empty index. A long page is one record.
    """
    spark = pages.sparkSession
    folder = (folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    # Written first: the row numbers that name records have to stay what they are when a task is run again.
    rows = staged(
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
        .select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"),
                F.octet_length("payload").cast("long").alias("bytes"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        out, name, place = None, None, 0
        try:
            for part in (batch.slice(i, SLICE_ROWS) for batch in batches for i in range(0, len(batch), SLICE_ROWS)):
                index = []
                for r in part.to_pylist():
                    if out is None or place >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        # A name no other attempt has: a repeated task leaves the file of the first one unread.
                        name, place = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    refers = (r["first_id"], r["first_row"]) if r["revisits"] else None
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record(r["url"], r["payload"], r["digest"], r["page_id"], r["row"], refers)) + packer.flush()
                    out.write(data)
                    index.append((name, place, len(data), r["url"], r["digest"], r["page_id"], r["row"],
                                  "revisit" if refers else "response", r["bytes"], r["first_id"], r["first_row"]))
                    place += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), _INDEX_TYPES)], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    named = with_roles(rows, least).select("row", "page_id", "url", "payload", "digest", "bytes", "revisits", "first_id", "first_row")
    named.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return open_archive(spark, folder)


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in INDEX.split(", ")]


def open_archive(spark: SparkSession, folder: str) -> Archive:
    return Archive(folder.rstrip("/"), spark.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/index"))


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, places) of reads that cover sorted (offset, length) ranges, near ones together."""
    start = end = 0
    places: list[int] = []
    for i, (offset, length) in enumerate(ranges):
        if places and (offset - end > gap or offset + length - start > most):
            yield start, end, places
            places = []
        if not places:
            start, end = offset, offset
        places.append(i)
        end = max(end, offset + length)
    if places:
        yield start, end, places


RECORDS = "page_id long, row long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, first_row long"


def read_records(archive: Archive, chosen: Column | None = None, check: bool = True) -> DataFrame:
    """The records whose index rows ``chosen`` keeps (all by default), as ``RECORDS``; revisits have no payload.

    What a record says of itself is returned, not what the index says: a response's length and, with
    ``check``, its SHA-256 are taken from the bytes read, and a mismatch fails. Work and memory go with the
    chosen records: unchosen stretches of a file are not read, at most ``READ_BYTES`` (or one longer
    record) is held at a time.
    """
    folder = archive.folder
    index = archive.index if chosen is None else archive.index.filter(chosen)
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    ranges = (
        index.select("file", "offset", "length", "page_id", "row", stretch.alias("stretch"))
        .repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            begin = 0
            while begin < len(rows):
                until = begin
                while until < len(rows) and rows[until]["file"] == rows[begin]["file"]:
                    until += 1
                own, begin = rows[begin:until], until
                if own[0]["file"] != name:
                    if source is not None:
                        source.close()
                    name = own[0]["file"]
                    source = store.open_input_file(f"{root}/{name}")
                for start, end, places in coalesced([(r["offset"], r["length"]) for r in own]):
                    data = source.read_at(end - start, start)
                    out, held = [], 0
                    for i in places:
                        if held > READ_BYTES:  # what was packed well may be far larger than what was read
                            yield pa.RecordBatch.from_pylist(out, _RECORD_SCHEMA)
                            out, held = [], 0
                        at = own[i]["offset"] - start
                        found = parse_record(zlib.decompress(data[at : at + own[i]["length"]], 31))
                        if check and found["payload"] is not None and hashlib.sha256(found["payload"]).hexdigest() != found["payload_digest"]:
                            raise ValueError(f"payload of row {own[i]['row']} in {name} does not have its digest")
                        held += len(found["payload"] or b"")
                        out.append({"page_id": own[i]["page_id"], "row": own[i]["row"], **found})
                    yield pa.RecordBatch.from_pylist(out, _RECORD_SCHEMA)
        if source is not None:
            source.close()

    return ranges.mapInArrow(read, RECORDS)


_RECORD_SCHEMA = pa.schema(
    [(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")]
)


def with_payloads(records: DataFrame) -> DataFrame:
    """``records`` whose revisits have the payload of the response they name, where that was read too.

    Adaptive execution splits the revisits of a response that very many of them name.
    """
    stored = records.filter("record_type = 'response'").select(F.col("row").alias("first_row"), F.col("payload").alias("stored"))
    responses, revisits = records.filter("record_type = 'response'"), records.filter("record_type = 'revisit'")
    filled = revisits.join(stored, "first_row", "left").withColumn("payload", F.col("stored")).drop("stored")
    return responses.unionByName(filled.select(*responses.columns))
