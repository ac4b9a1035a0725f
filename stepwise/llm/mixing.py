"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every row gets a key: a hash of its id and text, then its place in the stored table, which tells
equal rows apart.  Sizes are summed by source and the first digits
of the key; the running sums give, for each source, the bucket in which its
budget is reached.  Only the rows of these boundary buckets are summed
again by the next digits, down to single rows; the rows below the
threshold are taken.  Nothing is sorted but the histograms.  The same rows are taken
in every run; of rows equal in id and text, the same number.  Each text is read once: keys and sizes are stored.

Targets: source i weighs ``weights[i % len(weights)]`` in the order of the names (code
points, null last); the sources share ``share`` times all sizes by weight, none gets more
than ``most`` times its own size, and what is over is shared again among the others.

Defined results: null text has size 0; a source of size 0 has target 0; a null id is
hashed as a value of its own; rows with equal ids (or none) and equal texts are taken one by one;
empty tables give no rows.  Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.textbuf import broadcast_if_small, stored, with_result

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Hexadecimal digits of the key that one histogram resolves; digits of the hash in it and of the place behind.
DIGITS, HASH_DIGITS, PLACE_DIGITS = 3, 15, 18


def n_words(text: Column) -> Column:
    """Number of runs of bytes that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with the column target.

    There is one row per source, so the ordered windows here see a table of the mixture's size, not
    of the corpus'.  Sources reach their limit in the order of limit per weight; the level
    at which the rest share is found from running sums.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sources.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights)).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("limit") / F.col("w"))
    everything = Window.partitionBy()
    below = Window.orderBy("level", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    s = s.withColumn("common", (F.col("budget") - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.col("rest"))
    s = s.withColumn("at", F.row_number().over(Window.orderBy("level", F.col("source").isNull(), F.col("source").cast("binary"))))
    s = s.withColumn("common", F.min(F.when(F.col("common") <= F.col("level"), F.struct("at", "common"))).over(everything)["common"])
    return s.select("source", "source_size", F.least("limit", F.coalesce(F.col("common") * F.col("w"), F.col("limit"))).alias("target"))


def _digits(level: int) -> Column:
    return F.substring("key", 1 + level * DIGITS, DIGITS)


def keyed(doc_id: Column, text: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit(":"), F.coalesce(F.md5(text), F.lit("none"))))
    return F.concat(F.substring(digest, 1, HASH_DIGITS), F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), PLACE_DIGITS, "0"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): keys below the cut are taken; their sizes sum to nearly the budget (source, left).

    ``rows`` (source, key, size) is stored.  Each level keeps the key prefix of the boundary bucket; the last one
    is that at which every boundary bucket is a single row.
    """
    edge = budgets.select("source", F.lit("").alias("prefix"), F.col("left").cast("double").alias("left"))
    for level in range((HASH_DIGITS + PLACE_DIGITS) // DIGITS):
        edge = edge.withColumnRenamed("source", "src").select("src", "prefix", "left")
        met = rows.join(broadcast_if_small(edge, 128), F.col("source").eqNullSafe(F.col("src")) & (F.substring("key", 1, level * DIGITS) == F.col("prefix")))
        hist = met.groupBy("source", "prefix", _digits(level).alias("digits")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("digits")
        hist = hist.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
        full = Window.partitionBy("source")
        hist = hist.withColumn("over", F.min(F.when(F.col("upto") > F.col("left"), F.col("digits"))).over(full))
        one = hist.where(F.col("digits") == F.col("over"))
        edge = stored(one.select("source", F.concat("prefix", "digits").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), "n", "rows"), "edges")
        if edge.where("rows > 1").isEmpty():
            break
    # the boundary row is taken if that comes nearer to the budget
    return edge.select("source", F.when(F.col("left") * 2 > F.col("n"), F.concat("prefix", F.lit("g"))).otherwise(F.col("prefix")).alias("cut"))


def _counted(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, keep_text: bool) -> DataFrame:
    """Every row with size, source_size, target, taken and ``__copies``, how often the mixture takes it."""
    sized = docs.withColumn("__size", n_words(F.col(text))).withColumn("__key", keyed(F.col(doc_id), F.col(text), seed))
    sized = stored(sized if keep_text else sized.drop(text), "sizes")
    slim = sized.select(F.col(source).alias("source"), F.col("__key").alias("key"), F.col("__size").alias("size"))
    sums = stored(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goal = targets(sums)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(MOST)))).otherwise(0)
    goal = stored(goal.withColumn("whole", whole.cast("long")).withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "targets")
    cuts = thresholds(slim, stored(goal.where("whole < " + str(int(MOST))).select("source", "left"), "budgets"))
    plan = stored(goal.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left"), "plan")
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    out = sized.join(broadcast_if_small(plan, 160), F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    out = out.withColumn("__copies", F.col("__whole") + F.coalesce((F.col("__key") < F.col("__cut")).cast("long"), F.lit(0)))
    out = with_result(out, size=F.col("__size"), source_size=F.col("__source_size"), target=F.col("__target"), taken=F.col("__size") * F.col("__copies"))
    return out.drop("__size", "__key", "__source", "__source_size", "__target", "__whole", "__cut")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", keep_text: bool = False) -> DataFrame:
    """Every row (without its text unless asked for) with size, source_size, target and taken.

    ``taken`` is the words that the mixture takes: whole repeats of the source, and one more of
    the rows below its threshold.
    """
    return _counted(docs, doc_id, text, source, seed, keep_text).drop("__copies")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mixture, repeated as often as it takes them, with the columns of ``docs``."""
    packed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("words"), F.col(f"`{source}`").alias("origin"), F.struct("*").alias("row"))
    found = _counted(packed, "id", "words", "origin", "mix", keep_text=False)
    return found.where("__copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("copy")).select("row.*")
