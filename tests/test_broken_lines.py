"""Broken JSON lines, byte bounds of broadcasts and the skewed gather."""

import os

import pytest
from pyspark.sql import functions as F

from stepwise.operators import common, vectors
from stepwise.sources import files as src
from stepwise.sources.files import STEP_LOG_SCHEMA

LINES = ['{"run_id":"1","split":"train","epoch":1,"step":1,"time":"2024-01-01 00:00:00.000001","loss":0.5}', '{"run_id":"1","step":2,"loss":0.', "not json", '{"run_id":"2","step":"x"}',
         "", '{"run_id":"2","step":3,"loss":null,"other":1}', '{"step":4']


@pytest.fixture()
def path(tmp_path):
    folder = tmp_path / "run_id=9"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(LINES) + "\n")
    return str(tmp_path)


def test_broken_lines_fail_are_skipped_and_are_kept_apart(spark, path):
    with pytest.raises(Exception, match="broken line in .*a.jsonl"):
        src.read_run_logs(spark, path).collect()
    with pytest.raises(Exception, match="broken line"):
        src.read_run_logs(spark, path).count()
    with pytest.raises(Exception, match="broken line"):
        src.read_run_logs(spark, path).select("loss").collect()
    good = src.read_run_logs(spark, path, on_error="skip")
    assert set(good.columns) == set(STEP_LOG_SCHEMA.fieldNames()) and {r["run_id"] for r in good.collect()} == {"9"} and sorted(r["step"] for r in good.collect()) == [1, 3] and good.count() == 2
    bad = src.broken_lines(spark, path, STEP_LOG_SCHEMA)
    assert bad.count() == 4 and sorted(r["line"] for r in bad.select("line").collect()) == sorted(LINES[i] for i in (1, 2, 3, 6))
    assert all(os.path.basename(r["file"]) == "a.jsonl" and r["split_start"] == 0 for r in bad.collect())
    assert src.read_run_logs(spark, path, on_error="null").count() >= 6
    with pytest.raises(ValueError):
        src.read_run_logs(spark, path, on_error="maybe")


def test_whole_files_read_as_before(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(LINES[0] + "\n")
    assert [r["loss"] for r in src.read_run_logs(spark, str(tmp_path)).collect()] == [0.5]
    assert src.broken_lines(spark, str(tmp_path), STEP_LOG_SCHEMA).count() == 0


def test_broadcasts_are_bounded_in_bytes(spark, capsys):
    few = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(1.0)).alias("a"))
    for rows, size, sent in ((1000, 1 << 20, True), (1000, 50_000, False), (50, 1 << 20, False)):
        got = common.bounded_broadcast(few, rows, size)
        assert (got is not few) == sent
    size = few.agg(F.sum(common.row_bytes(few))).first()[0]
    assert 100 * 1000 < size < 100 * 1100


def test_skewed_gather_equals_the_broadcast_one_and_spreads_hot_ids(spark, capsys):
    enc = spark.range(300).select("id", F.when(F.col("id") == 5, F.lit(None)).when(F.col("id") == 6, F.array().cast("array<int>")).otherwise(
        F.concat(F.array_repeat(F.lit(7), 200), F.sequence(F.lit(0), (F.col("id") % 50).cast("int")))).cast("array<int>").alias("ids"))
    table = spark.range(60).select("id", F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    a = vectors.embed_tokens(enc, "ids", "id", table, "id", "v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = vectors.embed_tokens(enc, "ids", "id", table, "id", "v", max_broadcast_bytes=0)
        b.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        sizes = [len(p) for p in b.rdd.glom().map(lambda rows: [1] * len(rows)).collect() if p]
        assert max(sizes) < sum(sizes) / 4
        with pytest.raises(Exception, match="without an embedding: 8"):
            vectors.embed_tokens(enc, "ids", "id", table.where("id <> 8"), "id", "v", max_broadcast_bytes=0).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
