"""WARC round trips with ids of any type, and the number of tasks that read."""

import pytest
from pyspark.sql import functions as F

from stepwise.llm import warc
from stepwise.session import scratch_path


@pytest.mark.parametrize("kind", ["int", "smallint", "bigint", "string", "decimal(12,2)", "date"])
def test_ids_come_back_in_their_type(spark, kind):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
    pages = spark.range(40).select(F.when(F.col("id") != 39, day).alias("page_id"), F.concat(F.lit("http://a.org/"), F.col("id") % 5).alias("url"),
                                   F.repeat(F.lit("<p>text</p>"), (F.col("id") % 4 * 10).cast("int")).alias("html"))
    got = warc.round_trip(spark, pages)
    assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == kind
    # a page is read once for each capture of its url's key
    ids = {r["page_id"] for r in got.collect()}
    assert ids == {r["page_id"] for r in pages.collect()}
    first = {r["html"]: r["first"] for r in pages.where(F.octet_length("html") >= 100).groupBy("html").agg(F.min("page_id").alias("first")).collect()}
    want = {(r["page_id"], None if first.get(r["html"], r["page_id"]) == r["page_id"] else first[r["html"]]) for r in pages.collect()}
    assert {(r["page_id"], r["refers_to"]) for r in got.collect()} == want


def test_reading_is_dealt_out_by_bytes(spark, monkeypatch):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.concat(F.col("id"), F.lit(" "), F.sha2(F.col("id").cast("string"), 512)).alias("html"))
    folder = scratch_path(spark, "warc")
    captures = warc.write(pages.coalesce(1), folder)
    monkeypatch.setattr(warc, "CHUNK", 1 << 13)
    monkeypatch.setattr(warc, "READ_TOGETHER", 1 << 12)
    size = captures.agg(F.sum("length")).first()[0]
    got = warc.read(captures, folder)
    assert got.rdd.getNumPartitions() == -(-size // (1 << 13)) > 8
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 600 and len(sizes) > 8 and max(sizes) < 300
