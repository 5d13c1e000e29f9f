"""Content-addressed web archive.

``archive`` turns rows of (id, url, payload) into two tables below one folder:

* ``payloads``: each distinct payload once, under its SHA-256;
* ``headers``: the exact header block of every record, with the SHA-256 that
  names its payload.

``restore`` joins them back into whole WARC records and verifies every payload
against its digest while reading; a corrupt payload raises. ``parsed`` reads a
record as any reader of such files would, and recomputes the digest of its payload;
one that differs from the header raises. Everything is expressed with SQL
functions, so no payload passes through Python.

Payload bytes are shuffled once to be stored once (grouped by digest, combined
on the map side first) and once to be restored. A payload that a third of all rows
share costs one partial aggregate per task in both choices. Records find their
response by ``common.looked_up``, which broadcasts those of the hot digests. In
restoring, a digest with many records is spread: ``fan`` of its header rows says
over how many copies of its payload they are dealt, ``FAN_ROWS`` records each.

Defined results
* null payload: empty payload; null url: the header line is left out; in a url
  every control character and line or paragraph separator (also Unicode's) is
  percent-encoded as its UTF-8 bytes, so a url can't add header lines;
* equal payloads of at least ``min_bytes`` bytes: the record with the largest
  id is the response, the others revisit it; smaller payloads are all responses;
* repeated rows (same id, same payload): one of them is the response and the
  others revisit that id; a null id counts as smallest and its header says
  ``urn:row:null``;
* very long payloads are one value each, as Spark holds them (2 GB at most);
* empty table: no records. Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: RFC 4648 alphabet (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
#: Records that a copy of a payload serves in restoring.
FAN_ROWS = 20_000
#: What may not stand in a header line: C0 and C1 controls, DEL, and separators.
_BREAKS = r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of 20 bytes given as 40 hex digits: 5 hex digits are 4 letters."""
    def letter(i: Column) -> Column:
        part = F.conv(F.substring(hex40, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("long")
        value = F.floor(part / F.pow(F.lit(2), (3 - i % 4) * 5)).cast("long") % 32
        return F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:row:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def one_line(url: Column) -> Column:
    """``url`` with control characters and separators percent-encoded."""
    letters = F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(url, i, F.lit(1)))
    coded = F.transform(letters, lambda c: F.when(c.rlike(_BREAKS), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(url.rlike(_BREAKS), F.array_join(coded, "")).otherwise(url)


def archive(rows: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", fan_rows: int = FAN_ROWS) -> None:
    """Write the archive of ``rows`` below ``path``."""
    spark = rows.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = rows.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))

    index = common.stored(base.select("id", "url", F.monotonically_increasing_id().alias("row"), F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), f"{path}/_index")
    fan = F.ceil(F.count("*") / fan_rows).cast("int").alias("fan")
    chosen = common.stored(index.groupBy("key").agg(F.max(F.struct("id", "row")).alias("best"), fan, F.count("*").alias("n")).where("n > 1").drop("n"), f"{path}/_chosen")
    found = common.looked_up(index, chosen, "key")
    revisit = F.col("best").isNotNull() & (F.col("best.row") != F.col("row")) & (F.col("bytes") >= min_bytes)
    lines = F.concat_ws(
        END,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), one_line(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("best.id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    )
    copies = F.coalesce("fan", F.lit(1))
    (found.select("id", "key", copies.alias("fan"), F.pmod(F.xxhash64("row"), copies).cast("int").alias("copy"), F.concat(lines, F.lit(END + END)).alias("header"))
        .write.mode("overwrite").parquet(f"{path}/headers"))
    (base.groupBy(F.sha2("payload", 256).alias("key")).agg(F.first("payload").alias("payload"), fan)
        .write.mode("overwrite").parquet(f"{path}/payloads"))
    common.discard(spark, f"{path}/_index")
    common.discard(spark, f"{path}/_chosen")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, payload, record): every record as it would stand in a WARC
    file, the payload (also of a revisit, which has none in its record) beside it."""
    kept = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("key")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("key"))).cast("binary"))
    kept = kept.select("key", checked.alias("payload"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("copy"))
    body = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return (spark.read.parquet(f"{path}/headers").join(kept, ["key", "copy"])
        .select("id", "header", "payload", F.concat(F.col("header").cast("binary"), body, F.lit((END + END).encode())).alias("record")))


def field(header: Column, name: str) -> Column:
    """A header field's value; null where the header lacks it. Only a line feed
    ends a line, as one_line() leaves none inside a value."""
    found = F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) from the bytes of
    ``record``; for a revisit, which has no body, the payload beside it counts."""
    head = F.substring_index(F.col("record").cast("string"), END + END, 1)
    rows = records.select("record", F.col("payload").alias("beside"), head.alias("head"))
    size = field(F.col("head"), "Content-Length").cast("int")
    body = F.substring("record", F.octet_length("head") + 5, size)
    rows = rows.withColumn("body", F.when(field(F.col("head"), "WARC-Type") == "response", body).otherwise(F.col("beside")))
    digest, told = base32_of_hex(F.sha1("body")), F.regexp_replace(field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")
    return rows.select(
        row_of(field(F.col("head"), "WARC-Record-ID")).alias("id"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.when(digest == told, digest).otherwise(F.raise_error(F.concat(F.lit("wrong digest of "), field(F.col("head"), "WARC-Record-ID"))).cast("string")).alias("payload_digest"),
        field(F.col("head"), "WARC-Type").alias("record_type"),
        row_of(field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
    )


def row_of(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"<urn:row:(-?\d+)>", 1)
    return F.when(digits != "", digits.cast("long"))


def op2_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back and report what it holds."""
    path = common.shared_dir(spark)
    archive(common.table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    return parsed(restore(spark, path)).withColumnRenamed("id", "page_id")
