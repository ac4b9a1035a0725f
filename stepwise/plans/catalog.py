"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query runs an operator of the library over whole test tables (through
the role bindings) and rounds doubles to 6 places so results compare across
engines.  The matching SQL is in ``plans/oracle_sql.py``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions import arrays as ar
from stepwise.functions import scalars as sc
from stepwise.functions import text as tx
from stepwise.operators import analysis as an
from stepwise.operators import bpe, grid_train, logs, nested
from stepwise.operators import rank as rk
from stepwise.operators import sweeps as sw
from stepwise.operators import vectors as vec
from stepwise.sources import files as src
from stepwise.streaming import ordered
from stepwise.streaming import summary as stsum
from stepwise.operators.common import round_doubles
from stepwise.operators.metrics import sums
from stepwise.operators.smooth import smooth_and_mask
from stepwise.plans import bindings as bd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("best_steps")
def best_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: per run, the step of the best loss, raw and smoothed, with its config."""
    logs = bd.step_log(spark, sf)
    smoothed = smooth_and_mask(logs, ["run_id"], ["loss"])
    summary = an.best_per_run(smoothed, "run_id", "step",
                              {"loss": "lower", "smoothed_loss": "lower"})
    cfg = bd.run_configs(spark, sf).select(
        "id", "optimizer", "learning_rate", "depth", "width")
    out = an.join_logs_configs(summary, cfg, left="run_id", right="id").drop("id")
    return round_doubles(out.select(
        "run_id", "optimizer", "learning_rate", "depth", "width",
        "best_loss_step", "best_loss", "best_smoothed_loss_step", "best_smoothed_loss"))


# ---------------------------------------------------------------- shared inputs

def _joined(spark, sf):
    """J1 of the events step log with the customer run configs."""
    return an.join_logs_configs(bd.step_log(spark, sf), bd.run_configs(spark, sf))


def _smoothed(spark, sf):
    return smooth_and_mask(bd.step_log(spark, sf), ["run_id"], ["loss"])


# ---------------------------------------------------------------- N1, N2

@register("flatten_configs")
def flatten_configs(spark, sf):
    """Nested run configs -> dotted columns."""
    return round_doubles(nested.flatten(bd.nested_configs(spark, sf)))


@register("unflatten_configs")
def unflatten_configs(spark, sf):
    """N2 o N1: flatten, rebuild the nesting, flatten again with '/' to show the structure."""
    flat = nested.flatten(bd.nested_configs(spark, sf))
    return round_doubles(nested.flatten(nested.unflatten(flat), sep="/"))


# ---------------------------------------------------------------- P*

@register("name_suffix")
def name_suffix(spark, sf):
    """Last four characters of the customer name as a key."""
    c = bd.table(spark, sf, "customer")
    return c.select("c_custkey", sc.string_suffix("c_name", 4).alias("name_suffix"))


@register("lr_filter")
def lr_filter(spark, sf):
    """Drop high learning rates outside sweep_b, keeping NULL learning rates."""
    j = _joined(spark, sf)
    cond = an.pd_cmp("learning_rate", ">=", 0.5) & an.pd_cmp("exp_name", "!=", "sweep_b")
    return round_doubles(an.filter_not(j, cond).select(
        "run_id", "step", "learning_rate", "exp_name", "loss"))


@register("fill_optimizer")
def fill_optimizer(spark, sf):
    """P5: missing optimizer -> 'sgd'."""
    return an.fill_null(bd.run_configs(spark, sf), {"optimizer": "sgd"}).select("id", "optimizer")


@register("present_smoothed")
def present_smoothed(spark, sf):
    """Rows whose smoothed loss is present."""
    return round_doubles(an.not_null_mask(_smoothed(spark, sf), "smoothed_loss")
                         .select("run_id", "step", "smoothed_loss"))


@register("param_counts")
def param_counts(spark, sf):
    """MLP parameter count per config."""
    c = bd.run_configs(spark, sf)
    return c.select("id", "depth", "width",
                    sc.param_count("width", "depth", bd.INPUT_DIM, bd.OUTPUT_DIM).alias("total_params"))


@register("rescaled_features")
def rescaled_features(spark, sf):
    """P10: scale features by 1/255 and move a (4, 4, 4) layout to channels-first."""
    e = bd.table(spark, sf, "embeddings")
    moved = ar.channels_first(ar.rescale("embedding", 255.0), 4, 4, 4)
    return e.select("vec_id", ar.round_array(moved, 6).alias("features"))


# ---------------------------------------------------------------- J1

@register("join_logs_configs")
def join_logs_configs(spark, sf):
    """Step log joined to run configs on run_id = id (null-safe)."""
    return round_doubles(_joined(spark, sf).select(
        "run_id", "step", "split", "loss", "optimizer", "learning_rate", "depth", "width"))


# ---------------------------------------------------------------- A*

@register("facet_train_frac")
def facet_train_frac(spark, sf):
    """A1: facets (train_frac; width, depth), null keys dropped."""
    return round_doubles(an.facet_summary(_joined(spark, sf), ["train_frac", "width", "depth"],
                                          "run_id", "step", "loss"))


@register("facet_optimizer_lr")
def facet_optimizer_lr(spark, sf):
    """A2: facets (optimizer, learning_rate), null keys kept as a group."""
    return round_doubles(an.facet_summary(_joined(spark, sf), ["optimizer", "learning_rate"],
                                          "run_id", "step", "loss", keep_null=True))


@register("distinct_counts")
def distinct_counts(spark, sf):
    """A3: number of distinct widths, depths and optimizers (NULL counted once)."""
    return an.distinct_count(_joined(spark, sf), ["width", "depth", "optimizer"], count_null=True)


@register("single_width_check")
def single_width_check(spark, sf):
    """A4: (train_frac, depth) groups that hold more than one width."""
    return an.check_single_value(bd.run_configs(spark, sf), ["train_frac", "depth"], "width")


@register("best_per_run_split")
def best_per_run_split(spark, sf):
    """A5 keyed by (run_id, split) on the raw loss."""
    return round_doubles(an.best_per_run(bd.step_log(spark, sf), ["run_id", "split"], "step",
                                         {"loss": "lower"}))


@register("run_elapsed")
def run_elapsed(spark, sf):
    """Seconds from the first to the last step of each run."""
    return round_doubles(an.elapsed(bd.step_log(spark, sf), "run_id", "step", "time"))


@register("log_summary")
def log_summary(spark, sf):
    """W1 + A7-A10: count-window summary, flush 20, chunks of 7, loss and perplexity."""
    return round_doubles(logs.count_window_summary(
        bd.step_log(spark, sf), flush_interval=20, aggregation_interval=7,
        metrics=("loss", "perplexity")))


@register("log_summary_accuracy")
def log_summary_accuracy(spark, sf):
    """W1 + A6: summary of batch records with logits, flush 4, chunks of 3, accuracy and loss."""
    return round_doubles(logs.count_window_summary(
        bd.batch_step_log(spark, sf), flush_interval=4, aggregation_interval=3,
        metrics=("loss", "accuracy")))


# ---------------------------------------------------------------- U*

@register("union_sweeps")
def union_sweeps(spark, sf):
    """The step log cut by month half into two sweeps, one lacking epoch, unioned by name."""
    log = bd.step_log(spark, sf)
    a = an.tag_constant(log.filter(F.dayofmonth("time") <= 15), "sweep_name", "first_half")
    b = an.tag_constant(log.filter(F.dayofmonth("time") > 15).drop("epoch"), "sweep_name", "second_half")
    return round_doubles(an.union_runs(a, b).select("run_id", "step", "epoch", "loss", "sweep_name"))


@register("distinct_lrs")
def distinct_lrs(spark, sf):
    """Distinct learning rates of sweep_b below 0.5."""
    cond = (F.col("exp_name") == "sweep_b") & (F.col("learning_rate") < 0.5)
    return round_doubles(an.distinct_values(bd.run_configs(spark, sf), "learning_rate", cond))


# ---------------------------------------------------------------- W3, W4, L3

@register("nth_from_end")
def nth_from_end(spark, sf):
    """Smoothed loss 31 rows from the end of each run."""
    return round_doubles(an.nth_from_end(_smoothed(spark, sf), "run_id", "step", "smoothed_loss", 31))


@register("first_in_group")
def first_in_group(spark, sf):
    """First run_id and width (by step) of each depth group."""
    return an.first_in_group(_joined(spark, sf), "depth", "step", ["run_id", "width"])


@register("report_head")
def report_head(spark, sf):
    """L3: the 30 deep runs with the lowest best loss."""
    summary = an.best_per_run(bd.step_log(spark, sf), "run_id", "step", {"loss": "lower"})
    cfg = bd.run_configs(spark, sf)
    j = an.join_logs_configs(summary, cfg)
    return round_doubles(an.report_head(j, F.col("depth") >= 3,
                                        ["run_id", "depth", "width", "best_loss", "best_loss_step"],
                                        [F.col("best_loss").asc(), F.col("run_id").asc()], 30))


# ---------------------------------------------------------------- text

TEXT_NEW_TOKENS = 8
_MODELS: dict = {}


def _model(spark, sf, name="documents", key="doc_id", new_tokens=TEXT_NEW_TOKENS):
    """Train (once per session) a BPE model on a whole corpus table."""
    k = (sf, name, key, new_tokens, spark.sparkContext.applicationId)
    if k not in _MODELS:
        _MODELS[k] = bpe.bpe_train(bd.table(spark, sf, name), "text", key, new_tokens=new_tokens)
    return _MODELS[k]


@register("normalized_text")
def normalized_text(spark, sf):
    """documents stripped of Unicode whitespace at both ends (length and md5)."""
    t = tx.normalize_text("text")
    return bd.table(spark, sf, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("n_chars"), F.md5(t).alias("text_md5"))


@register("word_freq")
def word_freq(spark, sf):
    """A13 + F2: pre-token frequencies over the whole documents corpus."""
    return bpe.word_freq(bd.table(spark, sf, "documents"), "text", "doc_id").select("word", "freq")


@register("alphabet")
def alphabet(spark, sf):
    """Characters of the documents corpus with ids from 3 by first appearance."""
    words = bpe.word_freq(bd.table(spark, sf, "documents"), "text", "doc_id")
    return bpe.alphabet(words)


@register("pair_counts")
def pair_counts(spark, sf):
    """Adjacent character pairs of all words, weighted by word frequency."""
    words = bpe.word_freq(bd.table(spark, sf, "documents"), "text", "doc_id")
    table = words.filter(F.length("word") > 1).select(bpe.encode_symbols("word").alias("sym"), "freq")
    return bpe.pair_counts(table)


@register("top_pair")
def top_pair(spark, sf):
    """L1: the most frequent pair (ties: left, right)."""
    return top_pair_of(spark, sf)


def top_pair_of(spark, sf):
    return bpe.top_pairs(pair_counts(spark, sf), 1)


@register("bpe_merges")
def bpe_merges(spark, sf):
    """T1 (+T2 rewrite rounds): merges learned from documents, 8 new tokens."""
    return _model(spark, sf).merges_df(spark)


@register("bpe_vocab")
def bpe_vocab(spark, sf):
    """The resulting vocabulary (specials, alphabet, merged tokens)."""
    return _model(spark, sf).vocab_df(spark)


@register("encode_conversations")
def encode_conversations(spark, sf):
    """T3 + T4 + J3: conversation turns encoded with the documents model (+EOS, unknown -> UNK)."""
    return bpe.encode(bd.table(spark, sf, "conversations"), "text", ["conv_id", "turn"], _model(spark, sf))


@register("decode_conversations")
def decode_conversations(spark, sf):
    """T6 + J4: decode of the encoded turns (specials appear literally)."""
    m = _model(spark, sf)
    enc = bpe.encode(bd.table(spark, sf, "conversations"), "text", ["conv_id", "turn"], m)
    return bpe.decode(enc, "ids", ["conv_id", "turn"], m)


@register("round_trip_documents")
def round_trip_documents(spark, sf):
    """decode(encode(text, no EOS)) of the training corpus equals its normalised text."""
    rt = bpe.round_trip(bd.table(spark, sf, "documents"), "text", "doc_id", _model(spark, sf))
    return rt.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


#: Tokens of the full-size model.
FULL_NEW_TOKENS = 1000


@register("bpe_merges_10000")
def bpe_merges_10000(spark, sf):
    """T1 at the size of a real vocabulary: 10,000 new tokens learned from documents."""
    return _model(spark, sf, new_tokens=10_000).merges_df(spark)


@register("bpe_merges_1000")
def bpe_merges_1000(spark, sf):
    """1,000 tokens learned from all documents (tests/test_bpe.py compares with one merge at a time)."""
    return _model(spark, sf, new_tokens=FULL_NEW_TOKENS).merges_df(spark)


@register("encode_conversations_1000")
def encode_conversations_1000(spark, sf):
    """T4: conversation turns encoded with the full-size model."""
    m = _model(spark, sf, new_tokens=FULL_NEW_TOKENS)
    return bpe.encode(bd.table(spark, sf, "conversations"), "text", ["conv_id", "turn"], m)


@register("round_trip_documents_1000")
def round_trip_documents_1000(spark, sf):
    """decode(encode(text, no EOS)) of all documents with the full-size model."""
    m = _model(spark, sf, new_tokens=FULL_NEW_TOKENS)
    rt = bpe.round_trip(bd.table(spark, sf, "documents"), "text", "doc_id", m)
    return rt.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("encoded_lengths")
def encoded_lengths(spark, sf):
    """Tokens per encoded conversation turn (EOS included)."""
    enc = bpe.encode(bd.table(spark, sf, "conversations"), "text", ["conv_id", "turn"], _model(spark, sf))
    return bpe.encoded_lengths(enc, ["conv_id", "turn"])


@register("vocab_overlap")
def vocab_overlap(spark, sf):
    """Tokens shared by the documents and the benchmark vocabularies."""
    a = _model(spark, sf).vocab_df(spark)
    b = _model(spark, sf, "benchmark", "item_id").vocab_df(spark)
    return bpe.vocab_overlap(a, b)["common"]


# ---------------------------------------------------------------- K1, X*, W5, W6, P8, P9, T5, F6

@register("random_split")
def random_split(spark, sf):
    """Embeddings split 0.8 / 0.1 (remainder 0.1 dropped), seed 42, exact sizes."""
    e = bd.table(spark, sf, "embeddings").select("vec_id", "label")
    return rk.random_split(e, "vec_id", [0.8, 0.1], ["train", "val"], seed=42)


@register("make_batches")
def make_batches(spark, sf):
    """Embeddings in vec_id order cut into batches of 64 (short last batch kept)."""
    e = bd.table(spark, sf, "embeddings").select("vec_id")
    return rk.make_batches(e, "vec_id", 64)


@register("step_schedule")
def step_schedule(spark, sf):
    """3 epochs of batches of 64 over embeddings; validate after every 5th step."""
    return rk.schedule_for(bd.table(spark, sf, "embeddings"), 3, 64, 5)


@register("epoch_shuffle")
def epoch_shuffle(spark, sf):
    """3 epochs (from 0), each a fresh seeded order; batch = position div 64."""
    e = bd.table(spark, sf, "embeddings").select("vec_id")
    out = rk.epoch_shuffle(e, "vec_id", 3, seed=42)
    return out.withColumn("batch", F.floor(F.col("position") / 64).cast("bigint"))


@register("stride_sample")
def stride_sample(spark, sf):
    """Every 100th event in (ts, event_id) order."""
    ev = bd.table(spark, sf, "events").select("event_id", "ts", "user_id")
    return rk.stride_sample(ev, ["ts", "event_id"], 100).select("event_id", "user_id")


@register("head_events")
def head_events(spark, sf):
    """The first 25 events in (ts, event_id) order."""
    ev = bd.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return rk.head_n(ev, ["ts", "event_id"], 25).select("event_id", "event_type")


@register("range_events")
def range_events(spark, sf):
    """Events [1000, 1050) in (ts, event_id) order."""
    ev = bd.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return rk.range_subset(ev, ["ts", "event_id"], 1000, 1050).select("event_id", "event_type")


@register("subset_by_index")
def subset_by_index(spark, sf):
    """Documents whose id is in the labels index table."""
    d = bd.table(spark, sf, "documents").select("doc_id", "lang")
    return rk.subset_by_index(d, bd.table(spark, sf, "labels"), "doc_id")


def _conv_batches(spark, sf):
    """Batches are made of texts, which take less room in the shuffles than their ids, and encoded where they lie."""
    turns = bd.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = rk.make_batches(turns, ["conv_id", "turn"], 16)
    enc = bpe.encode(b, "text", ["conv_id", "turn", "batch", "position"], _model(spark, sf), dealt=True)
    return bpe.encode_batch(enc, "batch")


@register("encode_batch")
def encode_batch(spark, sf):
    """T5: encoded turns in batches of 16 (by conv_id, turn), padded to the batch's longest."""
    return _conv_batches(spark, sf).select("conv_id", "turn", "batch", "ids")


@register("flatten_labels")
def flatten_labels(spark, sf):
    """F6 + A16: each padded batch as one flat label array (rows x longest length)."""
    out = rk.flatten_labels(_conv_batches(spark, sf), "batch", "position", "ids")
    return out.select("batch", "n_rows", F.size("labels").cast("int").alias("n_labels"), "labels")


# ---------------------------------------------------------------- F7-F11, M2-M4

@register("argmax_logits")
def argmax_logits(spark, sf):
    """predicted class = first index of the largest logit."""
    lt = bd.logits_table(spark, sf)
    return lt.select("vec_id", "label", ar.argmax("logits").alias("pred"))


@register("softmax_logits")
def softmax_logits(spark, sf):
    """F8: class probabilities."""
    lt = bd.logits_table(spark, sf)
    return lt.select("vec_id", ar.round_array(ar.softmax("logits"), 6).alias("probs"))


@register("mean_cross_entropy")
def mean_cross_entropy(spark, sf):
    """mean cross-entropy over rows whose label is not the ignore index 0."""
    lt = bd.logits_table(spark, sf)
    return round_doubles(lt.agg(ar.mean_cross_entropy("logits", "label", ignore_index=0).alias("loss"),
                                F.count(F.when(F.col("label") != 0, 1)).alias("n_rows")))


@register("layer_norm")
def layer_norm(spark, sf):
    """each embedding normalised to mean 0, sample std 1 (no epsilon)."""
    e = bd.table(spark, sf, "embeddings")
    return e.select("vec_id", ar.round_array(ar.layer_norm("embedding"), 6).alias("normed"))


@register("relu_features")
def relu_features(spark, sf):
    """negative entries set to 0."""
    e = bd.table(spark, sf, "embeddings")
    return e.select("vec_id", ar.round_array(ar.relu("embedding"), 6).alias("features"))


@register("evaluate_splits")
def evaluate_splits(spark, sf):
    """M4 (+X1, X2): per split and batch of 64 (vec_id order): samples, loss, accuracy."""
    lt = bd.logits_table(spark, sf).select("vec_id", "logits", "label")
    parts = rk.random_split(lt, "vec_id", [0.8, 0.1], ["train", "val"], seed=42)
    batches = rk.make_batches(parts, "vec_id", 64, group="split")
    return round_doubles(vec.evaluate(batches, "logits", "label", ["split", "batch"]))


@register("score_centroids")
def score_centroids(spark, sf):
    """M2: dense layers (input from class centroids, one ReLU layer, output) applied to every vector."""
    e = bd.table(spark, sf, "embeddings")
    cents = vec.class_centroids(e, "embedding", "label", bd.INPUT_DIM).toPandas()
    layers = vec.centroid_layers(cents, bd.OUTPUT_DIM, bd.INPUT_DIM, depth=1)
    scored = vec.score_mlp(e, "embedding", layers, ["vec_id"])
    return scored.select("vec_id", ar.round_array("logits", 6).alias("logits"), ar.argmax("logits").alias("pred"))


@register("score_centroids_tables")
def score_centroids_tables(spark, sf):
    """M2 with the weights as tables: the same layers by a blocked matrix product, no layer broadcast."""
    e = bd.table(spark, sf, "embeddings")
    cents = vec.class_centroids(e, "embedding", "label", bd.INPUT_DIM)
    entries = cents.select(F.posexplode("centroid").alias("i", "w"), F.col("label").alias("j"))
    same = spark.range(bd.OUTPUT_DIM).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w"))
    nothing = spark.range(bd.OUTPUT_DIM).select(F.col("id").alias("j"), F.lit(0.0).alias("b"))
    n = bd.OUTPUT_DIM
    scored = vec.score_mlp_tables(e, "embedding", [(entries, nothing), (same, nothing), (same, nothing)], [bd.INPUT_DIM, n, n, n], ["vec_id"])
    return scored.select("vec_id", ar.round_array("logits", 6).alias("logits"), ar.argmax("logits").alias("pred"))


@register("embed_tokens")
def embed_tokens(spark, sf):
    """M3: embedding vector (rows of embeddings by id) for every token of the encoded turns."""
    enc = bpe.encode(bd.table(spark, sf, "conversations"), "text", ["conv_id", "turn"], _model(spark, sf))
    out = vec.embed_tokens(enc, "ids", ["conv_id", "turn"], bd.table(spark, sf, "embeddings"),
                           "vec_id", "embedding")
    return out.select("conv_id", "turn", "pos", "token_id", "vector")


# ---------------------------------------------------------------- G1-G5, F13-F15

def _axes(spark, sf):
    region = bd.table(spark, sf, "region")
    nation = bd.table(spark, sf, "nation")
    brands = bd.table(spark, sf, "part").select("p_brand").distinct()
    return [("r_name", sw.axis_from_values(region.select("r_name", "r_regionkey"), "r_name", ["r_regionkey"])),
            ("n_nationkey", sw.axis_from_values(nation.select("n_nationkey"), "n_nationkey")),
            ("p_brand", sw.axis_from_values(brands, "p_brand"))], nation


@register("grid_expand")
def grid_expand(spark, sf):
    """G1: every combination of region names x nation keys x part brands; run ids from 1."""
    axes, _ = _axes(spark, sf)
    return sw.grid_expand(spark, axes).select("run_id", "r_name", "n_nationkey", "p_brand")


@register("grid_paired")
def grid_paired(spark, sf):
    """Region names crossed with (nation key, region key) pairs that move together."""
    axes, nation = _axes(spark, sf)
    paired = sw.paired_axis(nation, ["n_nationkey", "n_regionkey"], ["n_nationkey"])
    return sw.grid_expand(spark, [axes[0], ("paired", paired)]).select(
        "run_id", "r_name", "n_nationkey", "n_regionkey")


def _transitions(spark, sf):
    ev = bd.table(spark, sf, "events")
    state = (F.when(F.col("event_type") == "click", "running")
              .when(F.col("event_type") == "purchase", "finished")
              .when(F.col("event_type") == "error", "failed").otherwise("new"))
    return ev.select(F.col("user_id").cast("string").alias("run_id"), state.alias("state"), "ts", "event_id")


@register("run_states")
def run_states(spark, sf):
    """Current state per run from its transition log (latest by ts, event_id)."""
    return sw.run_state(_transitions(spark, sf), "run_id", "state", ["ts", "event_id"])


@register("pending_runs")
def pending_runs(spark, sf):
    """Runs whose current state is new."""
    return sw.pending_runs(sw.run_state(_transitions(spark, sf), "run_id", "state", ["ts", "event_id"]))


@register("default_params")
def default_params(spark, sf):
    """Missing settings take defaults (optimizer, learning rate, batch sizes)."""
    c = bd.run_configs(spark, sf).select("id", "optimizer", "learning_rate")
    out = sw.default_params(c, {"optimizer": "sgd", "learning_rate": 0.001, "train_batch": 128, "val_batch": 1024})
    return round_doubles(out)


@register("series_labels")
def series_labels(spark, sf):
    """F15 + F13: series labels and zero-padded run directories per config."""
    c = bd.run_configs(spark, sf)
    return c.select("id", sc.series_label(F.concat(F.lit("d"), F.col("depth").cast("string")),
                                          F.concat(F.lit("w"), F.col("width").cast("string"))).alias("model_label"),
                    sc.series_label("optimizer", "depth").alias("opt_label"),
                    sc.run_dir(F.col("id").cast("bigint") + 1).alias("run_dir"))


@register("json_fields")
def json_fields(spark, sf):
    """parse the props JSON of each event and dump (run_id, step) as one JSON object."""
    ev = bd.table(spark, sf, "events")
    return ev.select("event_id", sc.json_load("props", "k int")["k"].alias("k"),
                     sc.json_dump(F.col("user_id").cast("string").alias("run_id"),
                                  F.col("event_id").alias("step")).alias("record"))


# ---------------------------------------------------------------- S1-S4, S7

def _scratch(spark, name):
    from stepwise.session import scratch_path
    return scratch_path(spark, name)


@register("jsonl_logs")
def jsonl_logs(spark, sf):
    """S1 + S3: the step log written as JSON lines (one folder per run) and read back with a schema."""
    path = _scratch(spark, "logs")
    src.write_logs(bd.step_log(spark, sf), path, partition_by="run_id")
    df = src.read_run_logs(spark, path)
    return round_doubles(df.select("run_id", "split", "epoch", "step",
                                   sc.timestamp_str("time").alias("time"), "loss"))


def _damaged_logs(spark, sf) -> str:
    """The step log as JSON lines; every 17th step's line is cut off, the next one's step is no number."""
    path = _scratch(spark, "damaged")
    log = bd.step_log(spark, sf)
    good = F.to_json(F.struct(*[F.col(f.name) for f in src.STEP_LOG_SCHEMA.fields]), {"timestampFormat": src.JSON_TIME_FORMAT})
    cut = F.concat(F.lit('{"run_id":"'), "run_id", F.lit('","step":'), F.col("step").cast("string"))
    typed = F.concat(F.lit('{"run_id":"'), "run_id", F.lit('","step":"x'), F.col("step").cast("string"), F.lit('"}'))
    log.select(F.when(F.col("step") % 17 == 0, cut).when(F.col("step") % 17 == 1, typed).otherwise(good).alias("value")).write.text(path)
    return path


@register("jsonl_logs_whole")
def jsonl_logs_whole(spark, sf):
    """The whole lines of logs with broken ones."""
    df = src.read_run_logs(spark, _damaged_logs(spark, sf), on_error="skip")
    return round_doubles(df.select("run_id", "split", "epoch", "step", sc.timestamp_str("time").alias("time"), "loss"))


@register("jsonl_logs_broken")
def jsonl_logs_broken(spark, sf):
    """The broken lines of the same logs, with the run that could be read of them."""
    bad = src.broken_lines(spark, _damaged_logs(spark, sf), src.STEP_LOG_SCHEMA)
    return bad.where(F.col("file").isNotNull() & (F.col("split_start") >= 0)).select("line")


@register("jsonl_configs")
def jsonl_configs(spark, sf):
    """Nested configs written as JSON lines and read back flattened."""
    path = _scratch(spark, "configs")
    nested_df = bd.nested_configs(spark, sf)
    nested_df.write.mode("overwrite").json(path)
    return round_doubles(src.read_run_configs(spark, path, nested_df.schema))


@register("sweep_run_table")
def sweep_run_table(spark, sf):
    """S4 + G1 + F13: the run table (run_dir, state, nested config) written by experiment and read back."""
    axes, _ = _axes(spark, sf)
    grid = sw.grid_expand(spark, axes)
    runs = grid.select("run_id", sc.run_dir("run_id").alias("run_dir"), F.lit("new").alias("state"),
                       F.struct(F.struct("r_name", "n_nationkey").alias("data"),
                                F.struct("p_brand").alias("model")).alias("config"),
                       F.lit("grid").alias("experiment"))
    path = _scratch(spark, "runs")
    src.write_run_table(runs, path)
    back = spark.read.parquet(path)
    return nested.flatten(back).select("run_id", "run_dir", "state", "experiment", "`config.data.r_name`",
                                       "`config.data.n_nationkey`", "`config.model.p_brand`")


@register("page_file_names")
def page_file_names(spark, sf):
    """Item id and category parsed from a file name built from each page URL path."""
    p = bd.table(spark, sf, "pages")
    name = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/", "_")
    out = src.relayout_by_category(p.select("page_id", name.alias("file_name")), "file_name")
    return out.select("page_id", "file_name", "item_id", "category")


# ---------------------------------------------------------------- M1

@register("sweep_train")
def sweep_train(spark, sf):
    """M1: one MLP fit per (width, depth) grid row on the embeddings train split; val accuracy."""
    from stepwise.operators.train import sweep_train as fit

    e = bd.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    parts = rk.random_split(e, "vec_id", [0.8, 0.1], ["train", "val"], seed=42)
    grid = [{"run_id": 1, "width": 16, "depth": 1}, {"run_id": 2, "width": 32, "depth": 1}]
    return round_doubles(fit(spark, parts, grid, "embedding", "label", bd.INPUT_DIM, bd.OUTPUT_DIM, max_iter=30))


def _trained(spark, sf, epochs, batch_size, val_interval):
    """Four runs on the embeddings, every fifth of them held out."""
    samples = bd.table(spark, sf, "embeddings").select("vec_id", "embedding", "label", F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train").alias("split"))
    grid = spark.createDataFrame([(1, 16, 1, "sgd", 0.1), (2, 16, 1, "adam", 0.01), (3, 32, 1, "adam", 0.01), (4, 16, 2, "adam", 0.01)],
                                 "run_id long, width int, depth int, optimizer string, learning_rate double")
    return grid_train.train_grid(samples, grid, "vec_id", "embedding", "label", bd.INPUT_DIM, bd.OUTPUT_DIM, epochs, batch_size, val_interval)


@register("sweep_train_log")
def sweep_train_log(spark, sf):
    """M1: loss of every run and step, and the accuracy on the held-out samples after it; all runs in one pass a step."""
    log = _trained(spark, sf, epochs=15, batch_size=None, val_interval=1)
    train = log.where("split = 'train'").select("run_id", "step", "loss")
    return round_doubles(train.join(log.where("split = 'val'").select("run_id", "step", F.col("accuracy").alias("val_accuracy")), ["run_id", "step"]), 5)


@register("sweep_train_schedule")
def sweep_train_schedule(spark, sf):
    """M1 + W5: epochs, steps and batch sizes in the log of a mini-batch training, with its validations."""
    return _trained(spark, sf, epochs=2, batch_size=128, val_interval=3).select("run_id", "split", "epoch", "step", "n_samples")


# ---------------------------------------------------------------- R1-R3

def _stream_input(spark, sf, with_markers: bool) -> str:
    """Write the step log as JSON lines in three appends: first half-month, second, end markers."""
    base = _scratch(spark, "stream-in")
    logs = bd.step_log(spark, sf).withColumn("end_of_run", F.lit(None).cast("boolean"))
    src.write_logs(logs.filter(F.dayofmonth("time") <= 15), base)
    src.write_logs(logs.filter(F.dayofmonth("time") > 15), base)
    if with_markers:
        ends = logs.groupBy("run_id").agg((F.max("step") + 1).alias("step"))
        src.write_logs(ends.select("run_id", F.lit(None).cast("string").alias("split"),
                                   F.lit(None).cast("int").alias("epoch"), "step",
                                   F.lit(None).cast("timestamp").alias("time"),
                                   F.lit(None).cast("double").alias("loss"),
                                   F.lit(True).alias("end_of_run")), base)
    return base


@register("stream_log_summary")
def stream_log_summary(spark, sf):
    """R1 + R2: the log streamed from growing JSONL files, summarised with flush 20 / chunks of 7."""
    base = _stream_input(spark, sf, with_markers=True)
    out = _scratch(spark, "stream-out")
    stream = stsum.stream_ingest(spark, base)
    stsum.run_to_table(stsum.stream_count_summary(stream, 20, 7), out, out + "-chk")
    return round_doubles(spark.read.parquet(out))


@register("stream_log_summary_accuracy")
def stream_log_summary_accuracy(spark, sf):
    """R1 + A6: the batch log with logits as a stream of Parquet files, accuracy and loss, flush 4 / chunks of 3."""
    log = bd.batch_step_log(spark, sf).withColumn("end_of_run", F.lit(None).cast("boolean"))
    ends = log.groupBy("run_id").agg((F.max("step") + 1).alias("step")).withColumn("end_of_run", F.lit(True))
    base, out = _scratch(spark, "stream-batches"), _scratch(spark, "stream-accuracy")
    log.write.mode("append").parquet(base)
    log.limit(0).unionByName(ends, allowMissingColumns=True).write.mode("append").parquet(base)
    stream = spark.readStream.schema(log.schema).parquet(base)
    stsum.run_to_table(stsum.stream_count_summary(stream, 4, 3, metrics=("loss", "accuracy")), out, out + "-chk")
    return round_doubles(spark.read.parquet(out))


SUMMARY_ROWS = "kind string, logger_id string, n_steps bigint, step bigint, time string, epoch int, run_id string, split string"


def _shuffled_appends(spark, sf, appends: int = 4):
    """Writes the step log as JSON lines in appends that cut across every run's order, end markers last; yields the folder after each append."""
    base = _scratch(spark, "stream-shuffled")
    log = rk.materialise(bd.step_log(spark, sf).withColumn("end_of_run", F.lit(None).cast("boolean")), _scratch(spark, "stream-log"))
    for i in range(appends):
        src.write_logs(log.where(F.pmod(F.xxhash64("run_id", "step"), F.lit(appends)) == i), base)
        yield base
    ends = log.groupBy("run_id").agg((F.max("step") + 1).alias("step")).withColumn("end_of_run", F.lit(True))
    src.write_logs(log.limit(0).unionByName(ends, allowMissingColumns=True), base)
    yield base


def _ordered_stream(spark, base, metrics, delay_days) -> DataFrame:
    return ordered.stream_ordered_summary(stsum.stream_ingest(spark, base), 20, 7, metrics, delay=delay_days * 86_400.0)


@register("stream_log_summary_shuffled")
def stream_log_summary_shuffled(spark, sf):
    """R1 + S3: records arrive in any order within the log's span and are summarised in step order; JSON-lines appends with a manifest.

    The stream goes on after each append, so its micro-batches are as many as the appends, whatever the number of files.
    """
    out = _scratch(spark, "stream-ordered")
    for base in _shuffled_appends(spark, sf):
        ordered.append_batches(_ordered_stream(spark, base, ("loss", "perplexity"), 400), out, out + "-chk").awaitTermination()
    rows = ordered.read_batches(spark, out, SUMMARY_ROWS + ", loss_mean double, loss_std double, perplexity double")
    return round_doubles(rows.where(F.col("kind") == ordered.SUMMARY).drop("kind"))


@register("stream_rejected_records")
def stream_rejected_records(spark, sf):
    """The second half of each month arrives first, the stream is restarted for the first half; records that come too late are rows of their own, in no chunk."""
    base, out = _scratch(spark, "stream-late"), _scratch(spark, "stream-rejects")
    log = bd.step_log(spark, sf).withColumn("end_of_run", F.lit(None).cast("boolean"))
    for late in (False, True):
        src.write_logs(log.where((F.dayofmonth("time") <= 15) == late), base)
        ordered.append_batches(_ordered_stream(spark, base, ("loss",), 0), out, out + "-chk").awaitTermination()
    rows = ordered.read_batches(spark, out, SUMMARY_ROWS + ", loss_mean double, loss_std double")
    return rows.where(F.col("kind") == ordered.REJECTED).select("run_id", "split", "epoch", "step", "time")


def _extent_metric() -> logs.StateMetric:
    """A metric of a user's own: least and greatest loss, and the mean size of a loss."""
    def update(x, begin):
        loss, there = x["loss"]
        least = np.minimum.reduceat(np.where(there, loss, np.inf), begin)
        return {"n": sums((there.astype("int64"), there), begin), "low": least,
                "high": np.maximum.reduceat(np.where(there, loss, -np.inf), begin), "size": sums((np.abs(loss), there), begin)}

    def merge(a, b):
        return {"n": a["n"] + b["n"], "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"]), "size": a["size"] + b["size"]}

    def finish(c):
        known = lambda x, name: F.when(c("n") > 0, x).alias(name)
        return [known(c("low"), "loss_min"), known(c("high"), "loss_max"), known(c("size") / c("n"), "loss_size")]

    return logs.StateMetric("extent", {"loss": (lambda: F.col("loss"), "double")}, {"n": "bigint", "low": "double", "high": "double", "size": "double"}, update, merge, finish)


logs.register_metric("loss_extent", _extent_metric)


@register("log_summary_user_metric")
def log_summary_user_metric(spark, sf):
    """W1 with a registered metric that has a mergeable state, beside a built-in one."""
    return round_doubles(logs.count_window_summary(bd.step_log(spark, sf), flush_interval=20, aggregation_interval=7, metrics=("loss", "loss_extent")))


@register("log_summary_user_metric_skew_safe")
def log_summary_user_metric_skew_safe(spark, sf):
    """The same on runs that are split over tasks; partial states are merged."""
    return round_doubles(logs.count_window_summary(bd.step_log(spark, sf, skew_safe=True), flush_interval=20, aggregation_interval=7, metrics=("loss", "loss_extent"),
                                                   skew_safe=True))


@register("stream_log_summary_user_metric")
def stream_log_summary_user_metric(spark, sf):
    """E1 + R1: the same metric in a stream."""
    out = _scratch(spark, "stream-user-metric")
    closed = _ordered_stream(spark, _stream_input(spark, sf, with_markers=True), ("loss", "loss_extent"), 40)
    stsum.run_to_table(closed, out, out + "-chk")
    return round_doubles(spark.read.parquet(out).where(F.col("kind") == ordered.SUMMARY).drop("kind"))


@register("stream_join_configs")
def stream_join_configs(spark, sf):
    """Streamed step records joined to static run configs."""
    base = _stream_input(spark, sf, with_markers=False)
    out = _scratch(spark, "stream-join")
    stream = stsum.stream_ingest(spark, base)
    joined = stsum.stream_join_configs(stream, bd.run_configs(spark, sf))
    stsum.run_to_table(joined.select("run_id", "step", "split", "loss", "optimizer", "learning_rate",
                                     "depth", "width"), out, out + "-chk")
    return round_doubles(spark.read.parquet(out))


@register("append_summaries")
def append_summaries(spark, sf):
    """S3: summary rows appended as JSON lines in two appends (split by run), read back with a schema."""
    summary = logs.count_window_summary(bd.step_log(spark, sf), flush_interval=20, aggregation_interval=7,
                                        metrics=("loss", "perplexity"))
    path = _scratch(spark, "summaries")
    first = F.col("run_id").cast("bigint") % 2 == 0
    src.append_summaries(summary.filter(first), path)
    src.append_summaries(summary.filter(~first), path)
    schema = "logger_id string, n_steps bigint, step bigint, time string, epoch int, run_id string, " \
             "split string, loss_mean double, loss_std double, perplexity double"
    return round_doubles(spark.read.schema(schema).json(path))


@register("samples_train")
def samples_train(spark, sf):
    """The train half of a known labelled-vector set (exact seeded split)."""
    return src.read_samples(spark, sf, "embeddings", train=True).select("id", "label")


@register("log_summary_skew_safe")
def log_summary_skew_safe(spark, sf):
    """W1 without run-keyed windows: hot runs are split across range partitions."""
    return round_doubles(logs.count_window_summary(
        bd.step_log(spark, sf, skew_safe=True), flush_interval=20, aggregation_interval=7,
        metrics=("loss", "perplexity"), skew_safe=True))


@register("best_steps_skew_safe")
def best_steps_skew_safe(spark, sf):
    """Flagship with the skew-safe smoothing path (hot runs split by position buckets)."""
    logs_df = bd.step_log(spark, sf, skew_safe=True)
    smoothed = smooth_and_mask(logs_df, ["run_id"], ["loss"], skew_safe=True)
    summary = an.best_per_run(smoothed, "run_id", "step", {"loss": "lower", "smoothed_loss": "lower"})
    cfg = bd.run_configs(spark, sf).select("id", "optimizer", "learning_rate", "depth", "width")
    out = an.join_logs_configs(summary, cfg, left="run_id", right="id").drop("id")
    return round_doubles(out.select(
        "run_id", "optimizer", "learning_rate", "depth", "width",
        "best_loss_step", "best_loss", "best_smoothed_loss_step", "best_smoothed_loss"))


@register("nth_from_end_skew_safe")
def nth_from_end_skew_safe(spark, sf):
    """W3 on the skew-safe path (positions from range slices, no run-keyed window)."""
    sm = smooth_and_mask(bd.step_log(spark, sf, skew_safe=True), ["run_id"], ["loss"], skew_safe=True)
    return round_doubles(an.nth_from_end(sm, "run_id", "step", "smoothed_loss", 31, skew_safe=True))


@register("token_ids")
def token_ids(spark, sf):
    """Each distinct conversation pre-token looked up in the documents vocabulary (unknown -> 1)."""
    words = bpe.word_freq(bd.table(spark, sf, "conversations"), "text", ["conv_id", "turn"]).select(
        F.col("word").alias("token"))
    m = _model(spark, sf)
    return bpe.token_to_id(words, "token", m.vocab_df(spark), len(m.tokens)).select("token", "id")


@register("chunk_field_lists")
def chunk_field_lists(spark, sf):
    """Per summary chunk (flush 20, chunks of 7), the losses of its records in step order."""
    keyed = logs.chunk_keys(bd.step_log(spark, sf), "run_id", "step", "split", 20, 7)
    lists = logs.collect_field_lists(keyed.withColumn("loss", F.round("loss", 6)),
                                     ["run_id", "__island", "__fg", "__chunk"], "step", ["loss", "step"])
    return lists.select("run_id", F.col("__island").alias("island"), F.col("__fg").alias("flush_group"),
                        F.col("__chunk").alias("chunk"), F.col("loss").alias("losses"), F.col("step").alias("steps"))


@register("relayout_pages")
def relayout_pages(spark, sf):
    """S7 write: pages rewritten under one folder per parsed category, read back and counted."""
    p = bd.table(spark, sf, "pages")
    name = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/", "_")
    out = _scratch(spark, "relayout")
    src.relayout_by_category(p.select("page_id", name.alias("file_name"), "html"), "file_name", out=out,
                             content_col="html")
    # explicit schema: partition values stay strings (an empty category is stored as the null partition)
    back = src.read_folders(spark, out, "file_name string, html string, item_id string, category string")
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"),
                                        F.sum(F.length("html")).cast("bigint").alias("n_bytes"))


# ---------------------------------------------------------------- sweep read path

SWEEP_METRICS = ("loss_mean", "accuracy_mean")


def _sweep(spark, sf, name, metrics):
    """One sweep: its logs joined with its own configs, smoothed on every metric that is there, tagged."""
    log = bd.step_log(spark, sf).withColumnRenamed("loss", "loss_mean")
    log = log.withColumn("accuracy_mean", F.exp(-F.col("loss_mean"))).drop(*[m for m in SWEEP_METRICS if m not in metrics])
    cfg = bd.run_configs(spark, sf).filter(F.col("exp_name") == name)
    cfg = cfg.select("id", "optimizer", "depth", "width", F.col("depth").alias("epoch"))
    joined = an.join_logs_configs(log, cfg)
    return an.tag_constant(smooth_and_mask(joined, ["run_id"], SWEEP_METRICS), "sweep_name", name)


def _sweeps(spark, sf):
    """Both sweeps; sweep_b has no accuracy, so its accuracy columns are NULL."""
    return an.union_runs(_sweep(spark, sf, "sweep_a", SWEEP_METRICS), _sweep(spark, sf, "sweep_b", SWEEP_METRICS[:1]))


@register("sweep_read")
def sweep_read(spark, sf):
    """J1 (suffixes on the clashing epoch), W2 + P7 on all metrics, P2, U1: two sweeps in one table."""
    return round_doubles(_sweeps(spark, sf).select(
        "sweep_name", "run_id", "step", "epoch_x", "epoch_y", "optimizer", "loss_mean", "accuracy_mean",
        "smoothed_loss_mean", "smoothed_accuracy_mean"))


@register("sweep_best")
def sweep_best(spark, sf):
    """A5 of every metric of both sweeps, the better direction taken from the metric's name."""
    names = [p + m for p in ("", "smoothed_") for m in SWEEP_METRICS]
    return round_doubles(an.best_per_run(_sweeps(spark, sf), ["sweep_name", "run_id"], "step",
                                         {m: an.metric_direction(m) for m in names}))


@register("sweep_series")
def sweep_series(spark, sf):
    """A1 + J2: smoothed series by (optimizer, depth), null keys dropped, with the run's best step."""
    runs = _sweeps(spark, sf)
    best = an.best_per_run(runs, "run_id", "step", {"loss_mean": an.metric_direction("loss_mean")})
    series = an.facet_series(runs, ["optimizer", "depth"], "run_id", "step", "smoothed_loss_mean")
    return round_doubles(an.join_summary(series, best))


@register("facet_series_null")
def facet_series_null(spark, sf):
    """A2: loss series by (optimizer, learning_rate), null keys kept."""
    return round_doubles(an.facet_series(_joined(spark, sf), ["optimizer", "learning_rate"], "run_id", "step", "loss",
                                         keep_null=True))


# ---------------------------------------------------------------- E1-E3, S5, S8, X3, L4, P1

@register("log_summary_pandas_metric")
def log_summary_pandas_metric(spark, sf):
    """W1 with a metric given as a Python function over one chunk's records."""
    spread_of_loss = logs.PandasMetric(
        "loss_spread", lambda rows: {"loss_max": rows["loss"].max(), "loss_median": rows["loss"].median()},
        "loss_max double, loss_median double", ["loss"])
    return round_doubles(logs.count_window_summary(
        bd.step_log(spark, sf), flush_interval=20, aggregation_interval=7, metrics=("loss", spread_of_loss)))


@register("materialised_features")
def materialised_features(spark, sf):
    """E2 + X3: a split's features sent through a chain of transforms, written once and read back."""
    e = bd.table(spark, sf, "embeddings").select("vec_id", "embedding")
    parts = rk.random_split(e, "vec_id", [0.8, 0.1], ["train", "val"], seed=42)
    out = an.apply_transforms(parts, [lambda d: d.withColumn("features", ar.rescale("embedding", 255.0)),
                                      lambda d: d.withColumn("features", ar.round_array(ar.relu("features"), 6)),
                                      lambda d: d.drop("embedding")])
    return rk.materialise(out, _scratch(spark, "features"))


@register("sorted_vocab")
def sorted_vocab(spark, sf):
    """L4: the vocabulary in token order."""
    return bpe.sorted_vocab(_model(spark, sf).vocab_df(spark))


@register("corpus_splits")
def corpus_splits(spark, sf):
    """S8 + S5: a corpus that replaces the results of a folder, read back split by split."""
    path = _scratch(spark, "corpus")
    src.overwrite_results(bd.table(spark, sf, "labels"), path)
    part = F.when(F.col("lang") == "en", "train").otherwise("validation")
    src.overwrite_results(bd.table(spark, sf, "documents").select("doc_id", "text", part.alias("split")), path)
    both = an.union_runs(*[src.read_corpus(spark, path, split) for split in ("train", "validation")])
    return both.select("doc_id", "split", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("collated_batches")
def collated_batches(spark, sf):
    """E3 + X2: batches of 64 vectors as one row each, ids and labels as arrays."""
    e = bd.table(spark, sf, "embeddings").select("vec_id", "label")
    return rk.collate(rk.make_batches(e, "vec_id", 64), "batch", "position", ["vec_id", "label"])


@register("grid_nested")
def grid_nested(spark, sf):
    """G1 + P1 + N2: a long params table (with a null parameter) to nested run configs, types kept."""
    def values(table, col):
        return F.transform(F.array_sort(F.collect_set(col)), lambda v: v.cast("string")).alias("values"), bd.table(spark, sf, table)

    parts = []
    for i, (name, (vals, df)) in enumerate({"data.region": values("region", "r_name"), "model.brand": values("part", "p_brand"),
                                            "trainer.steps": values("nation", "n_nationkey")}.items()):
        parts.append(df.agg(vals).select(F.lit(name).alias("param"), F.lit(i).alias("ord"), "values"))
    warmup = bd.table(spark, sf, "region").agg(F.collect_set("r_name")).select(
        F.lit("trainer.warmup").alias("param"), F.lit(len(parts)).alias("ord"), F.array(F.lit(None).cast("string")).alias("values"))
    axes = sw.axes_from_table(an.union_runs(*parts, warmup), types={"trainer.steps": "int"})
    flat = sw.grid_expand(spark, axes)
    return nested.flatten(nested.unflatten(flat), sep="/")
