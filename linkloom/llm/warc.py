"""WARC archives with revisit records for repeated payloads.

Headers (page, digest, length) are shuffled by payload digest; of equal payloads one record is
the response and the others revisit it. Archives are Spark text files in the shared folder, one
record a row with the record separator as line separator, gzipped; the reader goes by
Content-Length, so a payload may hold anything. A file holds at most FILE_RECORDS records and
about FILE_BYTES of payloads: pages are written by classes of their payload's size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder

MIN_PAYLOAD = 1000
#: Records in a file, and bytes of its payloads: what a reader holds of an archive at once.
FILE_RECORDS, FILE_BYTES = 500, 32 << 20
#: Greatest payloads of the classes of pages but the last, which has a file for each page.
CLASSES = (64 << 10, 1 << 20, 16 << 20)
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """pages (page_id, url, html) with row, payload_bytes, payload_digest, record_type, refers_to, refers_to_row.

    Null html counts as empty. Of equal payloads of at least min_payload bytes the largest
    page_id is the response; rows that repeat that page_id are responses too, and a null page_id
    refers to the largest like the others (it is a response if there is no page_id at all). An
    empty table gives an empty one; other columns are not carried. row numbers the rows of pages,
    so that repeated rows' records can be told apart.
    Only headers meet by digest; payloads move once, by page_id.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    heads = cut(base.where(F.col("payload_bytes") >= min_payload).select("page_id", "payload_digest", "row"))
    # Cut, so that the join has an exchange on either side and a hot payload's partition can be split.
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", (-F.col("row")).alias("row"))))
    first = cut(heads.groupBy("payload_digest").agg(last.alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("payload_digest", F.col("last.page_id").alias("refers_to"), (-F.col("last.row")).alias("refers_to_row")))
    again = heads.join(first, "payload_digest").where("page_id is null or page_id <> refers_to").select("page_id", "payload_digest", "refers_to", "refers_to_row").distinct()
    # Built on: a row of headers for each repeated page in the partition, far less than the pages.
    again = again.toDF("_w_page", "_w_digest", "refers_to", "refers_to_row").hint("shuffle_hash")
    joined = base.join(again, base["page_id"].eqNullSafe(again["_w_page"]) & (base["payload_digest"] == again["_w_digest"]), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.select("page_id", "url", "html", "row", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to", "refers_to_row")


def records(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """One column, record: WARC 1.1 text without the separator that ends it. date: when the
    records were made, now if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    clean = lambda c: F.regexp_replace(c, r"[\r\n]+", "%0A")  # noqa: E731  a header is one line
    name = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("payload_digest"), F.lit(":"), row.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name(F.col("page_id"), F.col("row"))), F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", clean("url")), line("X-Page-ID", F.col("page_id").cast("string")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", name(F.col("refers_to"), F.col("refers_to_row"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return resolved.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD, date: str | None = None) -> None:
    """Gzipped archives in subfolders of folder, one for each class of payload sizes that occurs.
    A class reads and moves its own pages only; equal payloads are of one class."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    size = F.octet_length(F.coalesce("html", F.lit("")))
    bounds = [-1, *CLASSES, None]
    several = pages.agg(*(F.count_if((size > a) & (size <= z if z is not None else F.lit(True))) for a, z in zip(bounds, bounds[1:]))).first()
    for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
        if several[i] or not i:
            own = pages if several[i] == sum(several) else pages.where((size > a) & (size <= z) if z is not None else size > a)
            most = max(1, min(FILE_RECORDS, FILE_BYTES // z)) if z is not None else 1
            records(resolve(own, min_payload), date).write.option("lineSep", END).option("maxRecordsPerFile", most).option("compression", "gzip").text(f"{folder}/{i}")


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", begin)
        fields = dict(x.split(b": ", 1) for x in data[begin:stop].split(b"\r\n")[1:])
        at = stop + 4 + int(fields[b"Content-Length"])
        yield fields, data[stop + 4 : at]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_id", "record_type", "refers_to_id", "url", "payload_digest", "payload_bytes"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64()]
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            rows = []
            for f, block in parse(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                said = lambda k: f[k].decode() if k in f else None  # noqa: B023, E731
                response = f[b"WARC-Type"] == b"response"
                digest = hashlib.sha1(payload).hexdigest() if response else None
                if response and f.get(b"WARC-Payload-Digest") != b"sha1:" + digest.encode():
                    raise ValueError(f"the payload of {said(b'WARC-Record-ID')} has another digest than its header says")
                rows.append((int(f[b"X-Page-ID"]) if b"X-Page-ID" in f else None, said(b"WARC-Record-ID"), said(b"WARC-Type"), said(b"WARC-Refers-To"), said(b"WARC-Target-URI"),
                             digest, len(payload) if response else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    Digests and lengths are those of the payloads found in the archives (a payload that doesn't
    have its header's digest is an error); a revisit has those of the response it refers to, which
    must be there.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder).select("content")
    rows = cut(found.mapInArrow(_read, "page_id long, record_id string, record_type string, refers_to_id string, url string, payload_digest string, payload_bytes long"))
    # By page and digest: the last part of a name only tells repeated rows apart.
    name = lambda c: F.substring_index(c, ":", 4)
    original = rows.where("record_type = 'response'").groupBy(name("record_id").alias("name")).agg(F.max("page_id").alias("refers_to"), F.max("payload_digest").alias("d"), F.max("payload_bytes").alias("n"))
    responses = rows.where("record_type = 'response'").select("page_id", "url", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    revisits = rows.where("record_type = 'revisit'").withColumn("name", name("refers_to_id")).join(original, "name", "left").select("page_id", "url", "record_type", F.col("n").alias("payload_bytes"), F.coalesce("d", F.raise_error("a revisit record refers to no response")).alias("payload_digest"), "refers_to")
    return responses.union(revisits)


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD, folder: str | None = None) -> DataFrame:
    """Writes pages as deduplicated archives (to a new shared folder unless one is named) and
    reads them back. An empty table gives an empty result."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, min_payload)
    return read_archives(pages.sparkSession, folder)
