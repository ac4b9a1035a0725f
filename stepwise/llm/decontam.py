"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters.  A
window is ``window`` consecutive words of a benchmark item; an item of fewer
words is one window.  For windows of n words the fingerprint is the minimum
hash of the k-grams in it (k = half of n, rounded up): every text that holds
the window holds the same minimum, so joining the minima of documents and
items misses no shared span.  Hits are then extended to whole windows and
compared word by word, so hash collisions never count.

Plan: one pass over the documents finds the windows whose minimum is in a
fixed-size bit table of the items' minima (false positives only); the
words of documents with such a window are stored, exploded at those windows
alone, and joined with the items' fingerprints.

Defined results: a null or empty text has no words, no hits; null items and
items without words match nothing; equal windows in several items or repeated
items all count; repeated documents each get their row; a null item id is left
out of ``items_sha256`` but counts as an item.  Columns of the input named like a
result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.textbuf import broadcast_if_small, stored

#: Fixed values of the contract: the word pattern after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Bits of the table of item minima for each window of the items, and its bounds in 64-bit words.
BITS_A_WINDOW = 64
LEAST_WORDS, MOST_WORDS = 1 << 8, 1 << 17
#: Where a fingerprint's bits are taken from, for each of its places in the table.
PROBES = (0, 20, 40)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def gram_words(window: int) -> int:
    """Words of the hashed k-grams in windows of ``window`` words."""
    return (window + 1) // 2


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of each k consecutive word hashes."""
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def window_minima(grams: Column, n_words: Column, window: int) -> Column:
    """The winnowing fingerprint of each window, in order."""
    span = window - gram_words(window) + 1
    if span == 1:
        return grams
    return F.when(n_words >= window, F.transform(F.sequence(F.lit(0), n_words - window), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))).otherwise(F.array().cast("array<bigint>"))


def _minima(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` with an array ``words``: adds n_words and, for each window length, the array ``m<length>``."""
    df = df.withColumn("n_words", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for n in lengths:
        df = df.withColumn("g", gram_hashes(F.col("h"), gram_words(n)))
        df = df.withColumn(f"m{n}", window_minima(F.col("g"), F.col("n_words"), n)).drop("g")
    return df.drop("h")


def _window(n: int | Column) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, n), " ")


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Stored (item_id, n, fp, win): every window of every item with its fingerprint.

    The arrays are stored before they are exploded: the optimiser would otherwise
    repeat their expressions in a filter below the explode.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words")).withColumn("n", F.least(F.size("words"), F.lit(window)))
    items = _minima(items, list(range(1, window + 1)))
    items = stored(items.select("item_id", "n", "words", F.get(F.array(*[f"m{n}" for n in range(1, window + 1)]), F.col("n") - 1).alias("m")), "items")
    parts = items.select("item_id", "n", "words", F.posexplode("m").alias("at", "fp"))
    return stored(parts.select("item_id", "n", "fp", _window(F.col("n")).alias("win")), "item_windows")


def _place(fp: Column, shift: int, words64: int) -> tuple[Column, Column]:
    """Word number and bit number of one probe."""
    bit = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(words64 * 64 - 1))
    return F.shiftrightunsigned(bit, 6).cast("int"), bit.bitwiseAND(F.lit(63)).cast("int")


def bit_table(fps: DataFrame, words64: int) -> Column:
    """A constant array of ``words64`` longs with the probes' bits of every fingerprint set.

    The driver holds this one array, at most 8 * MOST_WORDS bytes.
    """
    spots = F.array(*[F.struct(w.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("b")) for w, b in (_place(F.col("fp"), s, words64) for s in PROBES)])
    filled = fps.select(F.explode(spots).alias("s")).select("s.*").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = [0] * words64
    for w, b in zip(filled["w"], filled["b"], strict=True):
        bits[w] = int(b)
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def _candidates(docs: DataFrame, text: str, lengths: list[int], wins: DataFrame, words64: int) -> DataFrame:
    """Stored (row, in, n_words, words, s<n>...): the rows of ``docs``, with words only where a window may be an item's."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("__")).alias("in"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("row"), words(F.col(text)).alias("words"))
    found = _minima(slim, lengths)
    bits = bit_table(wins, words64) if lengths else None

    def known(fp: Column) -> Column:
        hit = F.lit(True)
        for shift in PROBES:
            word, bit = _place(fp, shift, words64)
            hit = hit & (F.call_function("shiftrightunsigned", F.get(bits, word), bit).bitwiseAND(F.lit(1)) == 1)
        return hit

    hot = F.lit(False)
    for n in lengths:
        spots = F.filter(F.transform(f"m{n}", lambda fp, i: F.when(known(fp), F.struct(i.alias("at"), fp.alias("fp")))), lambda x: x.isNotNull())
        found = found.withColumn(f"s{n}", spots).drop(f"m{n}")
        hot = hot | (F.size(f"s{n}") > 0)
    return stored(found.withColumn("hot", hot).withColumn("words", F.when(F.col("hot"), F.col("words"))), "candidates")


def _texts(kept: DataFrame, wins: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """Stored (row, hit, items, sha): one row per distinct text with a hit."""
    texts = kept.where("hot").select("row", "words", *[f"s{n}" for n in lengths]).dropDuplicates(["row"])
    spots = None
    for n in lengths:
        one = texts.select("row", "words", F.lit(n).alias("n"), F.explode(f"s{n}").alias("s")).select("row", "words", "n", "s.*")
        one = one.select("row", "n", "at", "fp", _window(n).alias("win"))
        spots = one if spots is None else spots.unionByName(one)
    row_bytes = 64 + 16 * window
    distinct = stored(wins.select("n", "fp", "win").distinct(), "windows")
    hits = spots.join(broadcast_if_small(distinct, row_bytes), ["n", "fp", "win"])
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("spots"), F.collect_set("win").alias("wins"))
    covered = F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    hits = stored(hits.select("row", F.size(F.array_distinct(covered)).cast("long").alias("hit"), "wins"), "hits")
    owners = stored(wins.select("win", "item_id").distinct(), "owners")
    named = hits.select("row", "hit", F.explode("wins").alias("win")).join(broadcast_if_small(owners, row_bytes), "win")
    named = named.groupBy("row").agg(F.first("hit").alias("hit"), F.collect_set(F.struct(F.col("item_id").alias("id"))).alias("items"))
    ids = F.array_sort(F.transform("items", lambda x: x["id"].cast("string")))
    return stored(named.select("row", "hit", F.size("items").cast("long").alias("items"), F.sha2(F.array_join(ids, ","), 256).alias("sha")), "texts")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document without its text, with n_words, n_hit, n_items, items_sha256 and contaminated.

    The columns of ``docs`` besides the text pass through.
    """
    wins = item_windows(benchmark, item_id, item_text, window)
    shape = {r["n"]: r["c"] for r in wins.groupBy("n").agg(F.count("*").alias("c")).collect()}
    lengths, size = sorted(shape), LEAST_WORDS
    while size < MOST_WORDS and size * 64 < BITS_A_WINDOW * sum(shape.values()):
        size *= 2
    kept = _candidates(docs, text, lengths, wins, size)
    base = kept.select("row", "in", F.col("n_words").cast("long").alias("n"))
    zero = F.lit(0).cast("long")
    if lengths:
        found = _texts(kept, wins, lengths, window)
        base = base.join(broadcast_if_small(found, 256), "row", "left")
    else:
        base = base.select("*", zero.alias("hit"), zero.alias("items"), F.lit(None).cast("string").alias("sha"))
    passed = {c.lower() for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
    return base.select(
        *[F.col("in")[c].alias(c) for c in docs.columns if c != text and c.lower() not in passed], F.col("n").alias("n_words"), F.coalesce("hit", zero).alias("n_hit"),
        F.coalesce("items", zero).alias("n_items"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("hit", zero) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit, with the columns of ``docs``.

    The contaminated texts are few against the corpus: their ids are sent to the documents if they are small
    enough, else the two are shuffled.
    """
    found = decontaminate(docs.select(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("id"), F.col(f"`{text}`").alias("text")), benchmark)
    leaked = stored(found.where("contaminated").select(F.col("id").alias("__leaked")).distinct(), "leaked")
    return docs.join(broadcast_if_small(leaked, 96), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256) == F.col("__leaked"), "left_anti")
