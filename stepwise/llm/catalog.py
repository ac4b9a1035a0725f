"""Registered queries of this folder, ``opN_<name>``, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import centroids, decontam, hard_negatives, html_text, langid, mixing, neardup, ngram_lm, pii, quality, secret_scan, shards, warc
from stepwise.llm.textbuf import spread_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_files(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words of the benchmark, found by winnowing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE["op2_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, ns)),
hit AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN its ON d.r = its.r
"""


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.classes(docs).drop("__tid")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mixture with target weights takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("source")


#: Sources in the order of limit per weight; the same hash order, equal rows one by one, cut at the row nearest to the budget.
ORACLE["op10_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5('mix:' || coalesce('i' || CAST(doc_id AS VARCHAR), 'n') || ':' || coalesce(md5(text), 'none')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, CAST(source AS BLOB)) - 1) % 3 AS INT) + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM s),
t AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) AS common, row_number() OVER (ORDER BY cap / w, source IS NULL, CAST(source AS BLOB)) AS pos FROM l
  WINDOW o AS (ORDER BY cap / w, source IS NULL, CAST(source AS BLOB) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CAST(least(cap, coalesce((SELECT arg_min(common, pos) FROM t x WHERE x.common <= x.cap / x.w) * w, cap)) AS DOUBLE) AS target FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM g),
b AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM p),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN whole < 2 AND (upto <= rest OR (upto - size <= rest AND (rest - upto + size) * 2 > size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document and the verdict of its host, the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs, "source").drop("source")


ORACLE["op5_quality_rules"] = quality.ORACLE


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


@query
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, indexed and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("payload")


ORACLE["op8_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


@query
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0).alias("held_out"))
    return ngram_lm.score(docs, ngram_lm.train(docs.where(~F.col("held_out")))).drop("text")


@query
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op12_centroid_clusters"] = centroids.oracle()


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, with the label noise that the query states."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label=noisy, anchor=F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = hard_negatives.ORACLE
