"""WARC archives and the resolution of repeated payloads to revisit records.

Archives are written by Spark's text writer, one record a row, each ended by the two line breaks that the format asks for, and each file
compressed as a whole; so the writer's commit protocol covers lost executors. Spark's text reader streams them back, cut
at those line breaks wherever they stand, and the lengths in the headers tell where a record ends: a task holds one record
and a batch, however large a file is. To deduplicate, only headers are shuffled, by payload digest; each repeat then joins
the record that stays, and new archives are written with fresh headers: every record has an id of its own there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import release, shared_folder, table

#: Payloads with fewer bytes are always stored.
LEAST_BYTES = 100
#: Records of one archive file at most, and bytes of records that a reading task sends on at once.
FILE_ROWS, SEND_BYTES = 20_000, 4_000_000
CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, url string, record_id string, record_type string, digest string, payload_bytes long, refers_to string, date string"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(archive: str, of: Column) -> Column:
    """An id that an archive alone gives to a record, the same if a lost task writes it again."""
    h = F.sha2(F.concat(F.lit(f"{archive}:"), of.cast("string")), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def plain(value: Column) -> Column:
    """A header value: without line breaks."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\\r\\n]", " ")


def headers(pairs: list[tuple[str, Column]]) -> Column:
    lines = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise("") for k, v in pairs]
    return F.concat(*lines)


def record(ident: Column, kind: Column, page_id: Column, url: Column, date: Column, digest: Column, size: Column, body: Column, refers: Column, refers_url: Column) -> Column:
    """The text of a record; ``size`` is that of the full payload, ``body`` what is stored of it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))
    head = headers(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", ident),
            ("WARC-Target-URI", plain(url)),
            ("WARC-Date", date),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            ("WARC-Profile", F.when(kind == "revisit", PROFILE)),
            ("WARC-Refers-To", refers),
            ("WARC-Refers-To-Target-URI", plain(refers_url)),
            ("X-Page-ID", page_id.cast("string")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        ]
    )
    return F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF), http, body)


def write(records: DataFrame, name: str) -> str:
    """Writes the column ``record`` as archives of a new folder in the shared one."""
    path = f"{shared_folder(records.sparkSession).rstrip('/')}/agora-{name}-{uuid.uuid4().hex}"
    records.select("record").write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)
    return path


def parse(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of archives that are cut at ``CRLF CRLF``.

    A record's first piece are its headers; its block is joined from the next ones until it has the length they give.
    What follows a block up to the next record are the line breaks that end it.
    """
    end = (CRLF + CRLF).encode()
    for head in lines:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        version, *rest = head.decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {head[:40]!r}")
        fields = dict(x.split(": ", 1) for x in rest)
        size, parts, have = int(fields["Content-Length"]), [], 0
        while have < size:
            parts.append(next(lines) + end)
            have += len(parts[-1])
        yield fields, b"".join(parts)[:size]


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and payload of a record's block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:]), body


def read(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """The archives' headers, and the payloads, too, if asked for."""
    schema = T.StructType.fromDDL(HEADERS + (", payload binary" if payloads else ""))
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for head, block in parse(line for batch in batches for line in batch.column(0).to_pylist()):
            http, body = payload_of(block)
            page = head.get("X-Page-ID")
            row = (None if page is None else int(page), head.get("WARC-Target-URI", ""), head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"]), head.get("WARC-Refers-To"), head["WARC-Date"])
            rows.append((*row, body) if payloads else row)
            held += 200 + len(body) * payloads
            if held >= SEND_BYTES:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)

    return spark.read.option("lineSep", CRLF + CRLF).text(path).select(F.col("value").cast("binary")).mapInArrow(run, schema)


def archive(pages: DataFrame, date: str | None = None) -> str:
    """One response record for every row of ``pages`` (page_id, url, html); a null html is an empty payload.

    Every row has a record of its own, also rows that repeat a page_id or have none. The date is that of the call unless given.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    none = F.lit(None).cast("string")
    ident = record_id(uuid.uuid4().hex, F.monotonically_increasing_id())
    made = record(ident, F.lit("response"), F.col("page_id"), F.col("url"), F.lit(date or now()), F.sha2("html", 256), F.octet_length("html"), F.col("html"), none, none)
    return write(rows.select(made.alias("record")), "warc")


def resolve(found: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """record_id of each repeat (of headers), original and original_url: the record that it refers to.

    Of the records with one digest, those of the smallest page_id stay, all of them if rows repeat it; the others refer to
    one of these. Records without a page_id always stay.
    """
    large = found.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "record_id", "url")).alias("first"), F.max("page_id").alias("last")).where("first.page_id < last")
    first = first.select(F.col("digest").alias("digest_"), F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("original"), F.col("first.url").alias("original_url"))
    joined = large.join(first, F.col("digest") == F.col("digest_")).where(F.col("page_id") > F.col("first_page"))
    return joined.select(F.col("record_id").alias("repeat"), "original", "original_url")


def deduplicate(spark: SparkSession, path: str, least: int = LEAST_BYTES, date: str | None = None) -> str:
    """Archives in which repeated payloads are revisit records, from the archives in ``path``; headers are all fresh.

    Only headers meet by digest; the payloads stay where they are read and join the decision on their record.
    """
    headers_ = table(read(spark, path, payloads=False).select("page_id", "url", "record_id", "digest", "payload_bytes"), "headers")
    decided = table(resolve(headers_, least), "revisits")
    full = read(spark, path, payloads=True).withColumn("body", F.col("payload").cast("string"))
    joined = full.join(decided, F.col("record_id") == F.col("repeat"), "left")
    again = F.col("original").isNotNull()
    own = uuid.uuid4().hex
    made = record(record_id(own, F.col("record_id")), F.when(again, F.lit("revisit")).otherwise("response"), F.col("page_id"), F.col("url"), F.lit(date or now()), F.col("digest"), F.col("payload_bytes"), F.when(again, F.lit("")).otherwise(F.col("body")), F.when(again, record_id(own, F.col("original"))), F.col("original_url"))
    made = write(joined.select(made.alias("record")), "warc-dedup")
    release(headers_, decided)
    return made


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of every record of the archives.

    The digest and size of a stored payload are taken from the payload itself; a revisit record has those of the payload
    it refers to. refers_to is found by the id of the record that is referred to.
    """
    stored = F.col("record_type") == "response"
    found = table(read(spark, path, payloads=True).select("page_id", "record_id", "record_type", "refers_to", F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"), F.when(stored, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest")), "records")
    named = found.where("record_type = 'response' and page_id is not null").select(F.col("record_id").alias("record_"), F.col("page_id").alias("page_"))
    referred = found.where("refers_to is not null").select("refers_to").distinct()
    named = named.join(referred, F.col("record_") == F.col("refers_to"), "left_semi")
    revisits = found.where("record_type = 'revisit'").join(named, F.col("refers_to") == F.col("record_"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("page_").alias("refers_to"))
    both = found.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
    done = table(both, "resolved")
    release(found)
    return done
