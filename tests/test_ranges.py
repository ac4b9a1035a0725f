"""Ranks in key order by fixed splitters: exact with nulls, ties and hot keys, without a checkpoint."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from stepwise.operators import rank as rk
from stepwise.operators.ranges import Splitters, sortable, splitters

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    data = []
    for i in range(700):
        hot = rnd.random() < 0.4  # one day holds much of the rows
        t = datetime(2024, 3, 31) + (timedelta(0) if hot else timedelta(seconds=rnd.randint(-10**6, 10**6), microseconds=rnd.randint(0, 999_999)))
        data.append((None if i % 90 == 0 else t, rnd.choice(["a", "B", "é", "z'\\", None]), rnd.choice([None, float("nan"), -0.5, 1e300, rnd.random()]), date(2024, 1, 1) + timedelta(days=i % 3), i))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "t timestamp, s string, d double, day date, id long").repartition(7)


@pytest.mark.parametrize("order", [["id"], ["t", "id"], ["s", "d", "id"], ["day", "t", "id"], ["d", "id"]])
@pytest.mark.parametrize("parts", [1, 10, 100])
def test_rank_equals_the_row_number_of_one_sort(spark, rows, order, parts):
    from pyspark.sql import Window
    want = {r["id"]: r["n"] for r in rows.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1).collect()}
    got = {r["id"]: r["r"] for r in rk.ordered_rank(rows, order, out="r", partitions=parts).collect()}
    assert got == want


def test_ntz_timestamps_and_groups(spark, rows):
    from pyspark.sql import Window
    df = rows.withColumn("t", F.col("t").cast("timestamp_ntz"))
    want = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("t", "id")) - 1).collect()}
    got = {r["id"]: r["r"] for r in rk.ordered_rank(df, ["t", "id"], group="s", out="r", partitions=50).collect()}
    assert got == want


@pytest.mark.parametrize("start, stop", [(0, 10), (3, 4), (350, 420), (690, 5000), (5, 5), (9000, 9010), (0, 5000)])
def test_range_subset_is_the_slice(rows, start, stop):
    everything = [r["id"] for r in rows.orderBy("t", "id").collect()]
    assert sorted(r["id"] for r in rk.range_subset(rows, ["t", "id"], start, stop).collect()) == sorted(everything[start:stop])


def test_buckets_are_even_and_the_same_however_rows_are_dealt(rows):
    a, b = splitters(rows, ["t", "id"], 20), splitters(rows.repartition(3), ["t", "id"], 20)
    assert a == b and isinstance(a, Splitters)
    sizes = [r["count"] for r in a.bucket_of(rows, "b").groupBy("b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * min(sizes)


def test_empty_table_and_expressions(spark, rows):
    assert rk.ordered_rank(rows.limit(0), ["t", "id"], out="r").count() == 0
    assert rk.range_subset(rows.limit(0), ["t", "id"], 0, 5).count() == 0
    assert not sortable(rows, [F.col("id").desc()]) and sortable(rows, ["t", "s", "d", "day", "id"])
    down = rk.ordered_rank(rows, [F.col("id").desc()], out="r")
    assert {r["id"]: r["r"] for r in down.collect()} == {i: 699 - i for i in range(700)}


@pytest.mark.parametrize("name", ["range_events", "stride_sample", "make_batches"])
def test_no_checkpoint_in_the_plan(spark, capsys, name):
    se.queries()[name](spark, SF).explain(mode="simple")
    plan = capsys.readouterr().out
    assert "ExistingRDD" not in plan and "FileScan" in plan


def test_range_subset_prunes_its_scan(spark, capsys):
    se.queries()["range_events"](spark, SF).explain(mode="formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts" in plan or "LessThanOrEqual(ts" in plan
