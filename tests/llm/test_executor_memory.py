"""What the pipeline's stages keep in an executor: the size of Arrow batches, one copy of a text, no workers for a local table."""

import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stepwise.llm import langid, neardup, shards
from stepwise.llm.textbuf import BATCH_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _docs(spark, n=300, words=4000):
    """``n`` texts of about 8 bytes a word, in one partition."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.conv(F.pmod(F.xxhash64("id", i), F.lit(1 << 32)), 10, 26)))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("xx").alias("lang"))


def _largest(docs):
    """Bytes of the largest batch that a mapInArrow and an Arrow function get."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    texts = docs.select("text")
    return max(texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0], texts.select(size("text").alias("n")).agg(F.max("n")).first()[0])


@pytest.mark.parametrize("step", [
    lambda docs: langid.train(docs),
    lambda docs: langid.predict(docs, langid.LanguageModel((), langid.np.zeros((langid.SLOTS, 1), langid.np.float32))),
    lambda docs: neardup.near_links(docs),
], ids=["train", "predict", "near_links"])
def test_batches_of_texts_are_bounded_by_bytes(spark, step):
    docs = _docs(spark).persist()
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 3 * BATCH_BYTES
    spark.conf.unset(SETTING)
    step(docs.limit(3))
    assert _largest(docs) <= 1.5 * BATCH_BYTES
    docs.unpersist()


def test_language_packs_a_text_once_and_keeps_columns(spark):
    rows = [(1, "an old man and the sea", "xx", "a"), (2, "12", "xx", "b"), (3, None, None, None), (4, "the man and an old sea", "xx", None)]
    docs = spark.createDataFrame(rows, "`lang_pred` long, Text string, lang string, `score.x` string")
    out = cp.language(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[3]]
    plan = out._jdf.queryExecution().analyzed().toString()
    packed = next(x for x in plan.splitlines() if "struct(" in x)
    assert "Text" not in packed.split("struct(")[1].split(" AS row")[0]


def test_cuts_start_no_python_in_tasks(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    want = sorted(map(tuple, shards.shard(docs).select("doc_id", "shard", "slot").collect()))
    made = []
    whole = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: made.append(a) or whole(self, *a, **k))
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **k: pytest.fail("rows of a local table pass through Python workers"))
    assert sorted(map(tuple, shards.shard(docs).select("doc_id", "shard", "slot").collect())) == want
    assert made
