"""Content-addressed WARC archive: payload bytes once, exact record headers beside them.

An archive is a folder with two tables.  ``payloads`` has each different payload once under
its address, SHA-256 and length; ``records`` has one row per record with its header block as
written and the address it needs.  Joins give the original records back, and every read checks
the bytes against their address.  Records can be exported to WARC files and parsed from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut, scratch_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: 160 bits are four groups of eight digits."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    """A name-based identifier: the same record has the same one in every attempt."""
    h = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
                    F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                  id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes ``path``/payloads and ``path``/records.

    One record per row, payload the UTF-8 text (null: empty).  Of records with equal payloads of ``min_bytes`` or
    more, the smallest page is the response and the others revisit it; shorter payloads are all
    responses.  Rows repeated under one id: one is the response, the rest revisit that id.  A
    null id sorts after all others, a null url is left empty; line breaks in urls become %0D and %0A.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    narrow = cut(rows.select("page_id", "url", F.octet_length("payload").cast("long").alias("n_bytes"),
                             F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"))
                 .withColumn("_row", F.monotonically_increasing_id()), "warc-rows")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("_row").alias("_row"))
    first = cut(narrow.groupBy("sha256", "n_bytes").agg(
        F.min(order).alias("first"), F.min("sha1").alias("a"), F.max("sha1").alias("b")), "warc-first")
    # Two digests have to agree before bytes count as equal.
    first = first.select("sha256", "n_bytes", F.col("first.page_id").alias("first_page"), F.col("first._row").alias("first_row"),
                         F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.lit("payload digests disagree"))).alias("_same"))
    joined = narrow.join(first.where("_same"), ["sha256", "n_bytes"])
    response = (F.col("_row") == F.col("first_row")) | (F.col("n_bytes") < min_bytes)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    record_id = _uuid(F.col("page_id").cast("string"), F.col("_row").cast("string"), F.col("url"))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", digest),
        F.when(response, F.lit("")).otherwise(F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To-Page", F.coalesce(F.col("first_page").cast("string"), F.lit(""))))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("n_bytes")).otherwise(F.lit(0)).cast("string")), F.lit(CRLF))
    joined.select("page_id", header.alias("header"), "sha256", "n_bytes").write.mode("overwrite").parquet(f"{path}/records")
    # The bytes of the first row of each address.  The narrow side is built and payloads stream past it;
    # rows repeated as a whole are merged in the same partitioning.
    page, none = F.coalesce("page_id", F.lit(-1)), F.col("page_id").isNull()
    keys = ["page", "none", "sha256", "n_bytes"]
    wanted = first.select(F.coalesce("first_page", F.lit(-1)).alias("page"), F.col("first_page").isNull().alias("none"), "sha256", "n_bytes")
    stored = rows.select(page.alias("page"), none.alias("none"), F.sha2("payload", 256).alias("sha256"),
                         F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    (stored.join(wanted.hint("shuffle_hash"), keys, "left_semi").distinct().select("sha256", "n_bytes", "payload")
     .write.mode("overwrite").parquet(f"{path}/payloads"))


def _verified(payloads: DataFrame) -> DataFrame:
    """Payloads whose bytes have their address; anything else fails the job."""
    ok = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    return payloads.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))))


def header_field(header: Column, name: str) -> Column:
    """The value of a named field of a header block; null if it has none or an empty one."""
    value = F.regexp_extract(header, rf"(?m)^\Q{name}\E: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) per record.

    Types and references come from the headers, sizes and digests from the stored and verified bytes.
    """
    records = spark.read.parquet(f"{path}/records")
    facts = _verified(spark.read.parquet(f"{path}/payloads")).select(
        "sha256", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"))
    head = F.col("header")
    return records.join(facts, ["sha256", "n_bytes"], "left").select(
        header_field(head, "X-Page-ID").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        header_field(head, "WARC-Type").alias("record_type"),
        header_field(head, "WARC-Refers-To-Page").cast("long").alias("refers_to"), header_field(head, "WARC-Target-URI").alias("url"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, record): the original records, bytes restored by a join.

    ``payload`` is the full payload, of revisits too; ``record`` is what a WARC file holds of
    it: header, block (empty for revisits), blank lines.
    """
    payloads = _verified(spark.read.parquet(f"{path}/payloads"))
    block = F.when(header_field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return spark.read.parquet(f"{path}/records").join(payloads, ["sha256", "n_bytes"]).select(
        "page_id", "header", "payload", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(spark: SparkSession, archive: str, path: str, records_per_file: int = 2000) -> None:
    """WARC files of the archive's records; a record's closing blank lines are the writer's line ends."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)")
    (read_records(spark, archive).select(body.cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header block, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        size = int(next(x.split(b":", 1)[1] for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        yield header.decode("utf-8", "replace"), data[end:end + size]
        at = end + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of the records of uncompressed WARC files; a task holds one file at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = list(parse_warc(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()),
                                                  pa.array([b for _, b in found], pa.binary())], names=["header", "block"])

    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
            .mapInArrow(run, "header string, block binary"))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes an archive of ``pages`` to the shared folder and reads it back, as ``read_archive`` does."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, **options)
    return read_archive(spark, path)
