import base64
import hashlib

import pytest

from tapeworks.llm import common, warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    big = "é" * 300_000
    rows = [(1, "http://a", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "http://c\r\nEvil: 1", ""), (4, "http://d", None), (7, "http://e", big), (8, "http://f", "one"), (8, "http://f", "one"), (None, "http://g", "one"), (None, "http://h", None)]
    path = common.shared_dir(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS key", "1 AS payload", "2 AS id")
    warc.archive(df, "page_id", "url", "html", path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # each payload once
    back = warc.restore(spark, path).collect()
    assert len(back) == len(rows)
    seen = sorted((warc_id(r.header), bytes(r.payload)) for r in back)
    assert seen == sorted((str(i) if i is not None else "null", (t or "").encode()) for i, _, t in rows)
    for r in back:
        head = dict(line.split(": ", 1) for line in r.header.split("\r\n")[1:] if line)
        body = bytes(r.payload) if head["WARC-Type"] == "response" else b""
        assert int(head["Content-Length"]) == len(body) and bytes(r.record) == r.header.encode() + body + b"\r\n\r\n"
        assert head["WARC-Payload-Digest"] == "sha1:" + digest(bytes(r.payload)) and "Evil" not in head
        assert ("WARC-Target-URI" in head) == (warc_id(r.header) != "3")


def warc_id(header):
    return header.split("<urn:row:")[1].split(">")[0]


def pages(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_content_archive(spark, str(tmp_path)).collect()}


def test_query(spark, tmp_path):
    got = pages(spark, tmp_path, [(1, "u", "x"), (9, "u", "x"), (4, "u", None), (6, "u", "")])
    x, e = digest(b"x"), digest(b"")
    assert got == {(1, 1, x, "revisit", 9), (9, 1, x, "response", None), (4, 0, e, "revisit", 6), (6, 0, e, "response", None)}


def test_empty_table(spark, tmp_path):
    assert pages(spark, tmp_path, []) == set()


def test_small_payloads_need_no_revisit(spark):
    path = common.shared_dir(spark)
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "i long, u string, p string")
    warc.archive(df, "i", "u", "p", path, min_bytes=3)
    assert [("revisit" in r.header) for r in warc.restore(spark, path).collect()] == [False, False]


def test_corrupt_payload_raises(spark):
    path = common.shared_dir(spark)
    warc.archive(spark.createDataFrame([(1, "u", "ab")], "i long, u string, p string"), "i", "u", "p", path)
    good = spark.read.parquet(f"{path}/payloads").collect()
    spark.createDataFrame([(r.key, bytearray(b"zz")) for r in good], "key string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="corrupt payload"):
        warc.restore(spark, path).collect()


def test_urls_cannot_add_header_lines(spark, tmp_path):
    evil = "WARC-Refers-To: <urn:row:99>", "WARC-Payload-Digest: sha1:EVIL", "WARC-Type: revisit"
    rows = [(i, f"http://h/{c}{e}{c}", f"body {i}") for i, (c, e) in enumerate((c, e) for c in ("\u2028", "\u2029", "\u0085", "\r\n", "\n", "\x0b", "\x0c", "\x1e", "\x7f", "\r\n\r\n") for e in evil)]
    got = pages(spark, tmp_path, rows)
    assert got == {(i, len(t), digest(t.encode()), "response", None) for i, _, t in rows}


def test_encoded_urls_keep_the_rest(spark):
    from pyspark.sql import functions as F

    rows = [("a\u2028\U0001f600é%20\n",), ("plain é",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(warc.one_line(F.col("u"))).collect()]
    assert got == ["a%E2%80%A8\U0001f600é%20%0A", "plain é", None, ""]


def test_hot_payloads_are_spread(spark):
    rows = [(i, "u", "" if i % 3 == 0 else f"p{i % 50}") for i in range(300)]
    path = common.shared_dir(spark)
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", path, fan_rows=10)
    assert spark.read.parquet(f"{path}/headers").where("key = sha2('', 256)").select("copy").distinct().count() > 5
    got = {r.id: r for r in warc.parsed(warc.restore(spark, path)).collect()}
    assert len(got) == 300
    for i, _, t in rows:
        last = max(j for j, _, u in rows if u == t)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(t), digest(t.encode()), None if i == last else last)


def test_a_corrupt_archive_is_an_error(spark):
    path = common.shared_dir(spark)
    warc.archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), "page_id", "url", "html", path)
    changed = warc.restore(spark, path).withColumn("record", warc.F.expr("cast(replace(cast(record AS string), 'body', 'evil') AS binary)"))
    with pytest.raises(Exception, match="wrong digest"):
        warc.parsed(changed).collect()
