import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwise.operators import analysis as an
from stepwise.operators import bpe
from stepwise.operators import rank as rk
from stepwise.operators.common import range_parts
from stepwise.session import scratch_path
from stepwise.sources import files as src


def test_read_corpus_text_and_split(spark):
    path = scratch_path(spark, "corpus")
    spark.createDataFrame([("a b",), ("c",)], "value string").write.text(path)
    df = src.read_corpus(spark, path, fmt="text")
    assert sorted(r["text"] for r in df.collect()) == ["a b", "c"]
    with pytest.raises(ValueError):
        src.read_corpus(spark, path, split="train", fmt="text")


def test_overwrite_results_replaces(spark):
    path = scratch_path(spark, "results")
    src.overwrite_results(spark.range(5), path)
    src.overwrite_results(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_materialise_checkpoint_and_table(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(r["x"] for r in rk.materialise(df).collect()) == list(range(0, 20, 2))
    path = scratch_path(spark, "mat")
    assert rk.materialise(df, path).count() == 10


def test_read_samples_unknown_name(spark):
    with pytest.raises(ValueError):
        src.read_samples(spark, "/nowhere", "cifar100")


def test_apply_transforms_and_sorted_vocab(spark):
    df = spark.range(3)
    out = an.apply_transforms(df, [lambda d: d.withColumn("y", F.col("id") + 1),
                                   lambda d: d.filter(F.col("y") > 1)])
    assert sorted(r["y"] for r in out.collect()) == [2, 3]
    vocab = bpe.BpeModel(["[PAD]", "[UNK]", "[EOS]", "b", "a"]).vocab_df(spark)
    assert [r["token"] for r in bpe.sorted_vocab(vocab).collect()] == ["[EOS]", "[PAD]", "[UNK]", "a", "b"]


def test_relayout_writes_a_folder_once(spark, tmp_path):
    """Rows of few categories in many splits, one category hot and one null: a file a folder, and a few more of the hot one."""
    rows = [(f"p_{i}_{'hot' if i % 2 else i % 7}.html", f"<p>{i}</p>") for i in range(600)] + [(None, "x")] * 3
    df = spark.createDataFrame(rows, "file_name string, html string").repartition(12)
    out = str(tmp_path / "pages")
    src.relayout_by_category(df, "file_name", out=out, content_col="html")
    written = [p for p in (tmp_path / "pages").rglob("*.parquet")]
    folders = {p.parent.name for p in written}
    assert len(folders) == 9 and len(written) <= 9 + range_parts(spark) < 9 * 12
    listed = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    back = src.read_folders(spark, out, "file_name string, html string, item_id string, category string")
    assert sorted((r[0] or "", r[1]) for r in back.select("file_name", "html").collect()) == sorted((n or "", h) for n, h in rows)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == listed


def test_relayout_keeps_no_file_in_the_driver(spark, tmp_path):
    """Far more folders than tasks: Spark's plan has the files of the list, not one of each folder."""
    df = spark.range(400).select(F.concat(F.lit("p_"), "id", F.lit("_c"), "id", F.lit(".html")).alias("file_name"), F.col("id").cast("string").alias("html"))
    out = str(tmp_path / "pages")
    src.relayout_by_category(df, "file_name", out=out, content_col="html")
    back = src.read_folders(spark, out, "file_name string, html string, item_id string, category string")
    assert len(list((tmp_path / "pages").glob("category=*/*.parquet"))) == 400
    assert len(back.inputFiles()) <= range_parts(spark)
    assert sorted(map(tuple, back.collect())) == sorted((f"p_{i}_c{i}.html", str(i), str(i), f"c{i}") for i in range(400))


ODD_NAMES = [None, "", "x_", "a_1_b.c.html", "a_1_", "a_1_b=c%25.x", "a_1_{[^]}?#*.x", "a_1_'\"\\:\x01\x7f.x", "a_1_é 日本.x", "a_1_%.x", "a_1_B.x", "a_1_b.x", "a_1_ .x"]


def test_relayout_as_sparks_writer_has_it(spark, tmp_path):
    """Names with null, empty and escaped categories: the folders of Spark's writer, in place of what was there, and Spark reads them alike."""
    df = spark.createDataFrame([(n, h) for n in ODD_NAMES for h in ("<p>", None, "")], "file_name string, html string")
    out, other = str(tmp_path / "pages"), str(tmp_path / "spark")
    spark.range(3).write.parquet(out)
    rows = src.relayout_by_category(df, "file_name", out=out, content_col="html")
    rows.write.partitionBy("category").parquet(other)
    folders = [sorted(p.name for p in (tmp_path / d).glob("category=*")) for d in ("pages", "spark")]
    assert folders[0] == folders[1] and not list((tmp_path / "pages").glob("*.parquet"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["pages", "spark"]
    schema = "file_name string, html string, item_id string, category string"
    key = lambda r: tuple((x is not None, x or "") for x in r)
    read = [sorted(map(tuple, df.collect()), key=key) for df in (src.read_folders(spark, out, schema), spark.read.schema(schema).parquet(out), spark.read.schema(schema).parquet(other))]
    assert read[0] == read[1] == read[2] and len(read[0]) == 3 * len(ODD_NAMES)
    some = src.read_folders(spark, out, "Html string, none long, category string").collect()
    assert sorted(map(key, some)) == sorted(key((r[1], None, r[3])) for r in read[0])


def test_relayout_keeps_types_and_overwrites_its_own_source(spark, tmp_path):
    kinds = "file_name string, b binary, s smallint, t timestamp, n timestamp_ntz, d date, x decimal(20,3), f double, item_id string, category string"
    df = spark.range(40).selectExpr("concat('p_', id, '_', id % 3) AS file_name", "CAST(id AS string) || 'b' AS b0", "id").selectExpr(
        "file_name", "CAST(b0 AS binary) AS b", "CAST(id AS smallint) AS s", "timestamp_seconds(id * 1e6 + 0.25) AS t", "CAST(timestamp_seconds(id) AS timestamp_ntz) AS n", "date_add(DATE '1890-01-01', CAST(id AS int)) AS d", "CAST(id / 7 AS decimal(20,3)) AS x", "if(id = 3, double('NaN'), double(id)) AS f")
    out = str(tmp_path / "pages")
    want = sorted(str(r) for r in src.relayout_by_category(df, "file_name", out=out).selectExpr(*[c.split()[0] for c in kinds.split(", ")]).collect())
    assert sorted(str(r) for r in src.read_folders(spark, out, kinds).collect()) == want
    again = src.read_folders(spark, out, kinds).drop("item_id", "category")
    src.relayout_by_category(again, "file_name", out=out)
    for back in (src.read_folders(spark, out, kinds), spark.read.schema(kinds).parquet(out)):
        assert sorted(str(r) for r in back.collect()) == want


@pytest.mark.parametrize("odd", ["type", "store"])
def test_relayout_by_sparks_writer(spark, tmp_path, odd):
    """A nested column, or a store that tasks can't open: Spark writes and reads the folders."""
    df = spark.createDataFrame([(f"p_{i}_{i % 3}.x", [i] if odd == "type" else str(i)) for i in range(30)], f"file_name string, html {'array<long>' if odd == 'type' else 'string'}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pages.link./in", f"file://{tmp_path}")
    out = str(tmp_path / "pages") if odd == "type" else "viewfs://pages/in/pages"
    src.relayout_by_category(df, "file_name", out=out, content_col="html")
    assert not (tmp_path / "pages" / src.FILE_LIST).exists() and len(list((tmp_path / "pages").glob("category=*"))) == 3
    back = src.read_folders(spark, out, f"file_name string, {'html array<long>' if odd == 'type' else 'html string'}, item_id string, category string")
    assert sorted((r[0], r[1]) for r in back.collect()) == sorted(map(tuple, df.collect()))


def test_a_repeated_task_writes_the_same_files(tmp_path):
    """An attempt that ends early leaves no file that readers see; the next one's files are all."""
    rows = [pa.RecordBatch.from_pydict({"html": [f"{k}{i}" for i in range(3)] + [f"{k + 1}x"], "category": [str(k)] * 3 + [str(k + 1)]}) for k in range(4)]

    def ends():
        yield from rows[:2]
        raise OSError("lost")

    folder = f"file:{tmp_path}"
    with pytest.raises(OSError, match="lost"):
        list(src.write_part(ends(), "category", folder, "part-0", 1, {}))
    listed = [b.to_pylist() for attempt in (2, 3) for b in [pa.Table.from_batches(src.write_part(iter(rows), "category", folder, "part-0", attempt, {}))]]
    assert listed[0] == listed[1] and [x["value"] for x in listed[0]] == ["0", "1", "2", "3", "4"]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*") if p.is_file()) == sorted(x["file"] for x in listed[0])
    back = pa.Table.from_batches(src.read_listed([pa.RecordBatch.from_pylist(listed[0])], folder, pa.schema([("html", pa.string()), ("category", pa.string())])))
    assert sorted(map(tuple, (r.values() for r in back.to_pylist()))) == sorted((h, c) for b in rows for h, c in zip(b["html"].to_pylist(), b["category"].to_pylist()))


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_relayout_content_of_all_lengths(spark, tmp_path, kind):
    """Null and empty content, and bytes that aren't valid text."""
    rows = [(f"p_{i}_{i % 2}.x", None if i % 5 == 0 else b"" if i % 5 == 1 else bytes([i + 100]) * i * i) for i in range(60)]
    df = spark.createDataFrame(rows, "file_name string, html binary").withColumn("html", F.col("html").cast(kind))
    out = str(tmp_path / "pages")
    src.relayout_by_category(df, "file_name", out=out, content_col="html")
    for back in (src.read_folders(spark, out, f"file_name string, html {kind}, category string"), spark.read.parquet(out)):
        assert dict(back.dtypes)["html"] == kind
        assert sorted((n, h and bytes(h)) for n, h in back.select("file_name", F.col("html").cast("binary")).collect() if h is not None) == sorted(r for r in rows if r[1] is not None)
        assert back.where("html IS NULL").count() == 12


def test_packed_columns_are_unpacked_in_small_groups():
    rows = pa.table({"html": src._packed(pa.array(["x" * 3_000_000, None, "", "é" * 3_000_000, "y"])), "n": [1, 2, 3, 4, 5]})
    groups = list(src._groups(rows, {"html": pa.string()}))
    assert [g["n"].to_pylist() for g in groups] == [[1, 2, 3], [4, 5]]
    assert pa.concat_tables(groups)["html"].to_pylist() == ["x" * 3_000_000, None, "", "é" * 3_000_000, "y"]


def test_relayout_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("p_1_a.x", "<p>")], "file_name string, html string")
    out = str(tmp_path / "pages")
    for rows in (df, df.where("html IS NULL")):
        src.relayout_by_category(rows, "file_name", out=out, content_col="html")
        assert src.read_folders(spark, out, "html string, category string").count() == rows.count()
