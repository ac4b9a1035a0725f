"""Sources and sinks.

Logs and configs are JSON lines read with an explicit schema (never
inferred).  Timestamps travel as strings with microseconds, the format the
summariser writes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stepwise.operators.common import join_null_safe, parallelism, range_parts
from stepwise.operators.nested import flatten
from stepwise.session import ship_package

JSON_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

STEP_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("step", T.LongType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("loss", T.DoubleType()),
])

SUMMARY_SCHEMA = T.StructType([
    T.StructField("logger_id", T.StringType()),
    T.StructField("n_steps", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("time", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("accuracy_mean", T.DoubleType()),
    T.StructField("accuracy_std", T.DoubleType()),
    T.StructField("loss_mean", T.DoubleType()),
    T.StructField("loss_std", T.DoubleType()),
])


CORRUPT = "__corrupt_line"


def _json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the text of a line that isn't one object of the schema, its file and the start of its file split."""
    with_line = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(with_line).option("timestampFormat", JSON_TIME_FORMAT).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.select(*df.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "fail") -> DataFrame:
    """JSON lines of a schema; a broken line (cut off, not JSON, a value of another type) is an error, or left out.

    Text behind a line's first object isn't looked at, as Spark's reader has it.

    ``on_error``: ``fail``; ``skip``, the broken lines are then ``broken_lines`` of the same path; ``null``, a row of
    nulls and of what could be read.
    """
    if on_error not in ("fail", "skip", "null"):
        raise ValueError(f"on_error is fail, skip or null, not {on_error!r}")
    if on_error == "null":
        return spark.read.schema(schema).option("timestampFormat", JSON_TIME_FORMAT).json(path)
    df = _json_lines(spark, path, schema)
    whole = F.col(CORRUPT).isNull()
    # the read columns are part of the condition: a scan of the broken text alone isn't possible
    read = F.coalesce(F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])), F.lit(""))
    if on_error == "fail":
        text = F.concat(F.lit("broken line in "), F.col("__file"), F.lit(": "), F.substring(CORRUPT, 1, 200), F.lit(" read as "), read)
        keep = F.when(whole, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    else:
        keep = whole & (F.length(read) >= 0)
    return df.where(keep).drop(CORRUPT, "__file", "__start")


def broken_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that ``read_json_lines`` refuses: file, split_start (byte of the file's split that holds it), line, and what was read of it as JSON."""
    df = _json_lines(spark, path, schema)
    read = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    # as above, the condition takes in the read columns
    return df.where(F.col(CORRUPT).isNotNull() & (F.length(F.coalesce(read, F.lit(""))) >= 0)).select(F.col("__file").alias("file"), F.col("__start").alias("split_start"), F.col(CORRUPT).alias("line"), read.alias("read"))


def read_run_logs(spark: SparkSession, path: str, schema: T.StructType = STEP_LOG_SCHEMA, on_error: str = "fail") -> DataFrame:
    """Every run's JSON-lines log under a path or glob; ``run_id`` is a string.  Broken lines as ``read_json_lines`` has them."""
    df = read_json_lines(spark, path, schema, on_error)
    if "run_id" in df.columns:
        df = df.withColumn("run_id", F.col("run_id").cast("string"))
    return df


def read_run_configs(spark: SparkSession, path: str, schema: T.StructType, sep: str = ".", on_error: str = "fail") -> DataFrame:
    """Nested run configs, one per line, flattened to dotted columns.  Broken lines as ``read_json_lines`` has them."""
    return flatten(read_json_lines(spark, path, schema, on_error), sep=sep)


def append_summaries(df: DataFrame, path: str) -> None:
    """S3: append summary rows as JSON lines (one object per row)."""
    df.write.mode("append").option("timestampFormat", JSON_TIME_FORMAT).json(path)


def write_logs(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write step records as JSON lines (optionally one folder per run or experiment)."""
    w = df.write.mode("append").option("timestampFormat", JSON_TIME_FORMAT)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_run_table(runs: DataFrame, path: str, partition_by: str = "experiment") -> None:
    """One table of runs (run_id, run_dir, state, config ...), partitioned by experiment."""
    runs.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def overwrite_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Clear and recreate a results location."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_corpus(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet",
                text: str = "text") -> DataFrame:
    """A text corpus with a ``text`` column, optionally one split."""
    df = spark.read.text(path).withColumnRenamed("value", text) if fmt == "text" else spark.read.format(fmt).load(path)
    if split is not None:
        if "split" not in df.columns:
            raise ValueError("corpus has no split column")
        df = df.filter(F.col("split") == split)
    return df


# Labelled-vector datasets this reader knows (name -> id, features, label).
SAMPLE_SETS = {"embeddings": ("vec_id", "embedding", "label")}


def read_samples(spark: SparkSession, root: str, name: str, train: bool = True) -> DataFrame:
    """Labelled vectors ``(id, features, label)``; the train or the test half.

    The halves are an exact seeded split (X1) of the table; an unknown
    dataset name is an error before anything is read.
    """
    from stepwise.operators.rank import random_split

    if name not in SAMPLE_SETS:
        raise ValueError(f"unsupported dataset {name!r}")
    id_col, feat, label = SAMPLE_SETS[name]
    df = spark.read.parquet(f"{root}/{name}.parquet").select(
        F.col(id_col).alias("id"), F.col(feat).alias("features"), F.col(label).cast("int").alias("label"))
    parts = random_split(df, "id", [0.5], ["train"], seed=42, keep_remainder=True)
    return parts.filter((F.col("split") == "train") == F.lit(train)).drop("split")


FILE_NAME_PATTERN = r"^(.+?)(\.[^.]*)?$"


def parse_file_name(name) -> dict:
    """S7 parse: ``..._<id>_<category>.ext`` -> stem, id (second last part), category (last)."""
    n = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_extract(n, FILE_NAME_PATTERN, 1)
    parts = F.split(stem, "_")
    item = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return {"stem": stem, "item_id": item, "category": F.element_at(parts, -1)}


def relayout_by_category(df: DataFrame, name_col: str, out: str | None = None,
                         content_col: str | None = None) -> DataFrame:
    """Parse the category from each file name; optionally rewrite the rows under
    ``out/category=<category>/`` (one folder per category; null and empty ones share the null folder)."""
    p = parse_file_name(name_col)
    res = df.withColumn("item_id", p["item_id"]).withColumn("category", p["category"])
    if out is not None:
        cols = [c for c in res.columns if content_col is None or c in (name_col, content_col, "item_id", "category")]
        _write_folders(res.select(*cols), "category", out, content_col)
    return res


def _by_folder(df: DataFrame, col: str) -> DataFrame:
    """Rows dealt so that one task writes a folder; values with more rows than an even task go to several.

    So there are as many files as folders, and one more for each even task at most, whatever the number of input splits.
    """
    parts = range_parts(df.sparkSession)
    even = max(1, -(-df.count() // parts))
    hot = df.groupBy(col).agg(F.ceil(F.count(F.lit(1)) / even).cast("int").alias("__pieces")).where("__pieces > 1")
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t], F.spark_partition_id())
    # at most ``parts`` values are hot
    dealt = join_null_safe(df.withColumn("__row", row), F.broadcast(hot), [col], "left")
    return dealt.repartition(parts, col, F.pmod("__row", F.coalesce("__pieces", F.lit(1)))).drop("__row", "__pieces")


#: Lists the files of a table's folders, beside them; Spark passes over names that begin with ``_`` or ``.``.
FILE_LIST = "_files"
LISTED = "value string, file string"
#: Columns of these types are written by the tasks themselves.
PLAIN = r"string|binary|boolean|tinyint|smallint|int|bigint|float|double|date|timestamp|timestamp_ntz|decimal\(\d+,\d+\)"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: Characters that a folder's name has as ``%`` and two digits, and the null character.
ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
#: Bytes of rows in a row group, and in a batch read from small files.
GROUP_BYTES = 4 << 20


def file_system(folder: str):
    """The file system of a qualified folder, as tasks open it without Spark, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", folder)
    for hadoop in ("s3a://", "s3n://"):  # Hadoop's names of a scheme
        folder = f"s3://{folder[6:]}" if folder.startswith(hadoop) else folder
    return fs.FileSystem.from_uri(folder)


def _tasks_open(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and a task can open a folder's store without Spark."""
    def opens(_=None):
        try:
            system, path = file_system(folder)
            system.get_file_info(path)
            yield True
        except (OSError, ValueError, NotImplementedError):
            yield False

    return next(opens()) and (folder.startswith("file:") or spark.sparkContext.parallelize([0], 1).mapPartitions(opens).first())


def _packed(values: pa.Array) -> pa.Array:
    """Each text or binary value compressed, behind its length."""
    codec, bufs = pa.Codec("zstd"), (x.as_buffer() for x in values.cast(pa.binary()))
    return pa.array([None if b is None else len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True) for b in bufs], pa.binary())


def _unpacked(values: pa.Array, kind: pa.DataType) -> pa.Array:
    codec, bufs = pa.Codec("zstd"), (x.as_py() for x in values)
    sized = ((b, b and int.from_bytes(b[:8], "little")) for b in bufs)
    return pa.array([None if b is None else n and codec.decompress(b[8:], n, asbytes=True) or b"" for b, n in sized], pa.binary()).view(kind)


def _write_folders(df: DataFrame, col: str, out: str, content: str | None = None) -> None:
    """``df`` as Parquet under ``out/<col>=<value>/``, in place of what is there.

    The tasks write the files and list them in ``out/_files``; Spark's writer and reader keep each folder and file in the driver.
    They still do where the tasks can't open the store of ``out``, where a column's type isn't plain, or where
    only the folders that occur are to be overwritten. The column ``content``, if named, crosses the exchange compressed.
    """
    spark = df.sparkSession
    ship_package(spark)
    path, job = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    system = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = system.makeQualified(path(out))
    made = path(folder.getParent(), f".{folder.getName()}-{job}")
    to = made.toString()
    plain = all(re.fullmatch("string" if c == col else PLAIN, t) for c, t in df.dtypes) and len(df.columns) > 1
    static = spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    if not (plain and static and _tasks_open(spark, to)):
        _by_folder(df, col).write.mode("overwrite").partitionBy(col).parquet(out)
        return

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        return write_part(batches, col, to, f"part-{task.partitionId():05d}-{job}", task.taskAttemptId(), kinds)

    # as in Spark's writer, the folder of an empty value is that of null
    rows = df.withColumn(col, F.nullif(F.make_valid_utf8(col), F.lit("")))
    kinds = {c: pa.string() if t == "string" else pa.binary() for c, t in df.dtypes if c == content and c != col and t in ("string", "binary")}
    for c in kinds:
        rows = rows.withColumn(c, F.arrow_udf(_packed, "binary")(c))
    try:
        system.mkdirs(made)
        _by_folder(rows, col).sortWithinPartitions(col).mapInArrow(run, LISTED).write.option("compression", "gzip").json(f"{to}/{FILE_LIST}")
        system.create(path(made, "_SUCCESS")).close()
    except BaseException:
        system.delete(made, True)
        raise
    system.delete(folder, True)
    if not system.rename(made, folder):
        raise OSError(f"{to} could not be renamed to {folder.toString()}")


class _FolderFile:
    """A Parquet file of the folder of one value; it gets its name when it is whole."""

    def __init__(self, system, root: str, col: str, value: str | None, name: str, attempt: int, schema: pa.Schema):
        folder = f"{col}={NULL_FOLDER if value is None else ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value)}"
        self.system, self.value, self.file = system, value, f"{folder}/{name}"
        self.path, self.hidden = f"{root}/{folder}/{name}", f"{root}/{folder}/.{name}.{attempt}"
        system.create_dir(f"{root}/{folder}")
        self.sink = system.open_output_stream(self.hidden, compression=None)
        # most files have a row or a few: what readers skip by would be larger than the rows
        self.writer = pq.ParquetWriter(self.sink, schema, compression="zstd", use_dictionary=False, write_statistics=False, store_schema=False)

    def done(self) -> tuple[str | None, str]:
        self.writer.close()
        self.sink.close()
        try:
            self.system.move(self.hidden, self.path)
        except OSError:  # in some stores a file of an earlier attempt isn't replaced
            self.system.delete_file(self.path)
            self.system.move(self.hidden, self.path)
        return self.value, self.file

    def drop(self) -> None:
        self.writer.close()
        self.sink.close()
        self.system.delete_file(self.hidden)


def _groups(rows: pa.Table, packed: dict[str, pa.DataType]) -> Iterator[pa.Table]:
    """``rows`` in pieces of about ``GROUP_BYTES``, their packed columns unpacked."""
    if not rows.num_rows:
        return
    sizes = np.full(rows.num_rows, rows.nbytes / rows.num_rows)
    for c in packed:
        sizes += [int.from_bytes(b[:8], "little") if b else 0 for b in rows[c].to_pylist()]
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP_BYTES)) + 1
    for lo, hi in pairwise([0, *ends.tolist(), rows.num_rows]):
        piece = rows.slice(lo, hi - lo)
        for c, kind in packed.items():
            piece = piece.set_column(piece.schema.get_field_index(c), c, _unpacked(piece[c], kind))
        yield piece


def write_part(batches, col: str, folder: str, name: str, attempt: int, packed: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Writes a task's rows, sorted by ``col``, each value's to a file in its folder; lists the files as they are done.

    ``packed``: the columns that come compressed, and their types. A repeated task writes files of the same names.
    """
    system, root = file_system(folder)
    listed = pa.schema([("value", pa.string()), ("file", pa.string())])
    file, n = None, 0
    try:
        for batch in batches:
            done = []
            for rows in _groups(pa.Table.from_batches([batch]), packed):
                values, rows, at = rows[col].to_pylist(), rows.drop_columns([col]), 0
                for value, same in groupby(values):
                    size = sum(1 for _ in same)
                    if file is None or file.value != value:
                        if file is not None:
                            done.append(file.done())
                        file, n = None, n + 1
                        file = _FolderFile(system, root, col, value, f"{name}.c{n:03d}.zstd.parquet", attempt, rows.schema)
                    file.writer.write_table(rows.slice(at, size))
                    at += size
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], schema=listed)
        if file is not None:
            last, file = file.done(), None
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in last], schema=listed)
    finally:
        if file is not None:
            file.drop()


def read_listed(batches, folder: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of listed files; rows of small files share batches."""
    system, root = file_system(folder)
    pieces, size = [], 0

    def joined():
        return pa.concat_tables(pieces).combine_chunks().to_batches()

    for batch in batches:
        for value, name in zip(batch["value"].to_pylist(), batch["file"].to_pylist(), strict=True):
            col = name[:name.index("=")].lower()
            with system.open_input_file(f"{root}/{name}") as source, pq.ParquetFile(source) as file:
                there = {c.lower(): c for c in file.schema_arrow.names}
                wanted = [there[f.name.lower()] for f in schema if f.name.lower() in there]
                for g in range(file.num_row_groups):
                    rows, n = file.read_row_group(g, columns=wanted, use_threads=False), file.metadata.row_group(g).num_rows
                    cols = []
                    for f in schema:
                        if f.name.lower() == col:
                            cols.append(pa.repeat(pa.scalar(value, pa.string()).cast(f.type), n))
                        else:
                            cols.append(rows[there[f.name.lower()]].cast(f.type) if f.name.lower() in there else pa.nulls(n, f.type))
                    pieces.append(pa.Table.from_arrays(cols, schema=schema))
                    size += pieces[-1].nbytes
                    if size >= GROUP_BYTES:
                        yield from joined()
                        pieces, size = [], 0
    if pieces:
        yield from joined()


def read_folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in many folders.

    Tasks read the files that ``relayout_by_category`` listed; files that were added later aren't among them. Without a list, the
    folders are listed by as many tasks as the cluster has use for (Spark's default is a task a folder), and the files are kept in the driver.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = system.makeQualified(at).toString()
    if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, FILE_LIST)):
        ship_package(spark)
        kinds = T.StructType.fromDDL(schema)
        fields = to_arrow_schema(kinds)
        return spark.read.schema(LISTED).json(f"{folder}/{FILE_LIST}").mapInArrow(lambda batches: read_listed(batches, folder, fields), kinds)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(parallelism(spark) * 4))
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(key, before)
