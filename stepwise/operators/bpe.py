"""Byte-pair-encoding tokenizer as Spark jobs.

Data layout
-----------
* words: ``(word, freq, first occurrence)``, tallied from batches of
  pre-tokenised texts in the tasks and summed by one shuffle on the word.
* segmentations: one row per distinct multi-character word, ``(sym, freq,
  pairs)``: its symbols after the first ``done`` merges, and a hash of each of its
  adjacent pairs, the postings by which a round finds the words it touches.
* pair counts after the same merges, ``(left, right, count)``.

Training (T1) is a loop of rounds and gives the merges of one-at-a-time
training.  A round guesses a sequence of coming merges from a bounded set of
words.  One Spark job then segments anew only the words that hold a pair of
the merges since ``done`` or of the guesses, and adds their signed count
changes to the pair counts (see ``pair_histories``).  From those exact counts
the driver accepts merges as long as the guess was right, and at the first
wrong guess takes the right merge instead (see ``_settled``): every round adds at
least one merge, and a wrong guess costs time, never a wrong merge.  When the
merges since ``done`` have grown by half, segmentations and counts are written anew
(see ``Segmented.advanced``).

Encoding (T4) runs the greedy lowest-rank merge loop on every row in place, in
Arrow batches, with the merge ranks broadcast (bounded by the vocabulary size)
and a bounded cache of words per task; T3 encodes a table of distinct words.
"""

from __future__ import annotations

import bisect
import heapq
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.functions.arrays import pad_array
from stepwise.functions.text import join_tokens, normalize_text, to_chars, word_lists
from stepwise.operators.common import bounded_broadcast, parallelism, spread
from stepwise.session import ensure_checkpoint_dir, scratch_path, ship_package

# The special tokens and their ids.
PAD, UNK, EOS = "[PAD]", "[UNK]", "[EOS]"
SPECIALS = (PAD, UNK, EOS)
PAD_ID, UNK_ID, EOS_ID = 0, 1, 2

_L, _R = "\t", "\n"


# ---------------------------------------------------------------- model

@dataclass
class BpeModel:
    """Vocabulary (id order) and merges (rank order); both bounded by vocab_size."""

    tokens: list[str]
    merges: list[tuple[str, str]] = field(default_factory=list)

    @property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {m: i for i, m in enumerate(self.merges)}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, t) for i, t in enumerate(self.tokens)],
                                     "id int, token string")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, l, r, l + r) for i, (l, r) in enumerate(self.merges)],
                                     "rank int, left string, right string, merged string")


# ---------------------------------------------------------------- A13, A14

#: Bytes of texts that are tallied, or encoded, at a time.
LOT_BYTES = 1 << 24
#: Types that Arrow doesn't sort.
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def lots(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, end row) of consecutive runs of rows of at most ``most`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


def _ordered(keys: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The order of rows by keys, nulls first, and a number for each row in that order that rows of equal keys (null and null too) share."""
    names = [str(i) for i in range(len(keys))]
    order = pc.sort_indices(pa.table(dict(zip(names, keys))), [(n, "ascending") for n in names], null_placement="at_start")
    codes = [k.take(order).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
    return order, np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in codes], axis=0))


def _tallied(row_keys: list[pa.Array], texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Distinct words of some rows: the words, their counts, the row and the position of the first by (keys, position)."""
    order, group = _ordered(row_keys)
    lists = word_lists(texts.take(order))
    at = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    code, n = words.indices.to_numpy(), len(words.dictionary)
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    pos = np.arange(len(code)) - at[row]
    turn = np.arange(len(code)) if len(lists) == 0 or group[-1] == len(lists) - 1 else np.lexsort((pos, group[row]))
    first = np.empty(n, np.int64)
    first[code[turn[::-1]]] = turn[::-1]  # of equal words the last assigned stays
    return words.dictionary, np.bincount(code, minlength=n), order.take(pa.array(row[first])), pos[first]


def word_freq(df: DataFrame, text: str, keys) -> DataFrame:
    """(word, freq, first) where first = earliest (keys..., pos) occurrence.

    Words are tallied in the tasks, an Arrow batch of texts at a time, so that distinct words and not occurrences are
    sorted and shuffled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = spread(df.select(*keys, text), *keys)
    kinds = [rows.schema[k].dataType for k in keys]
    out = T.StructType([T.StructField("word", T.StringType()), T.StructField("freq", T.LongType()),
                        T.StructField("first", T.StructType([*[T.StructField(k, t) for k, t in zip(keys, kinds)], T.StructField("pos", T.IntegerType())]))])
    flat = not any(isinstance(t, _NESTED) for t in kinds)  # such rows go one by one

    def run(batches):
        for batch in batches:
            for lo, hi in lots(batch.column(len(keys)), LOT_BYTES if flat else 0):
                part = batch.slice(lo, hi - lo)
                of = [part.column(i) for i in range(len(keys))]
                words, freq, row, pos = _tallied(of if flat else [pa.array([0])], part.column(len(keys)))
                first = pa.StructArray.from_arrays([*[k.take(row) for k in of], pa.array(pos, pa.int32())], names=[*keys, "pos"])
                yield pa.record_batch([words, pa.array(freq, pa.int64()), first], ["word", "freq", "first"])

    texts = rows.select(*keys, F.make_valid_utf8(normalize_text(text)).alias("__text"))
    return texts.mapInArrow(run, out).groupBy("word").agg(F.sum("freq").alias("freq"), F.min("first").alias("first"))


def _first_characters(row_keys: list[pa.Array], texts: pa.Array) -> tuple[list[str], pa.Array, list[int], list[int]]:
    """Distinct characters of some rows: the characters, the row, the word and the place in it of the first by (keys, word, place)."""
    order, group = _ordered(row_keys)
    text = pc.fill_null(texts.cast(pa.string()), "").take(order).to_pylist()
    ends = np.cumsum([len(t) for t in text])
    whole = "".join(text)
    seen = np.zeros(0x110000, bool)
    seen[np.frombuffer(whole.encode("utf-32-le"), np.uint32)] = True
    chars = [chr(c) for c in np.flatnonzero(seen)]
    rows = np.searchsorted(ends, np.array([whole.index(c) for c in chars], np.int64), side="right")
    words: dict[int, np.ndarray] = {}  # ends of a row's words

    def place(i: int, c: str) -> tuple[int, int, int]:
        if i not in words:
            words[i] = np.cumsum([len(w) for w in word_lists(pa.array([text[i]], pa.string())).flatten().to_pylist()])
        at = text[i].index(c)
        pos = int(np.searchsorted(words[i], at, side="right"))
        return pos, at - (int(words[i][pos - 1]) if pos else 0), i

    best: dict[str, tuple[int, int, int]] = {}
    alike: dict[tuple[int, int], set[str]] = {}  # rows of equal keys that hold the first of some characters
    lows, highs = np.searchsorted(group, group[rows], side="left"), np.searchsorted(group, group[rows], side="right")
    for c, i, low, high in zip(chars, rows.tolist(), lows.tolist(), highs.tolist()):
        if high - low == 1:
            best[c] = place(i, c)
        else:
            alike.setdefault((low, high), set()).add(c)
    for (low, high), some in alike.items():
        for i in range(low, high):
            for c in some.intersection(text[i]):
                best[c] = min(best.get(c, (len(text[i]) + 1, 0, 0)), place(i, c))
    pos, cpos, at = zip(*best.values()) if best else ((), (), ())
    return list(best), order.take(pa.array(at, pa.int64())), list(pos), list(cpos)


def alphabet(table: DataFrame, text: str | None = None, keys=None) -> DataFrame:
    """(token, id) for every character, ids from 3 in order of first appearance.

    ``table`` are words with their first places, as ``word_freq`` gives them, or with ``text`` and ``keys`` the texts
    themselves, which need no place of any word.  The alphabet is bounded by the number of distinct code points;
    every task finds the first of each among its rows, and the final ordering runs on that small table.
    """
    firsts = _word_characters(table) if text is None else _text_characters(table, text, [keys] if isinstance(keys, str) else list(keys))
    w = Window.orderBy("o")
    return (firsts.groupBy("token").agg(F.min("o").alias("o"))
                  .select("token", (F.row_number().over(w) + len(SPECIALS) - 1).cast("int").alias("id")))


def _text_characters(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(token, o) of the characters of every lot of texts; the rows stay where they are."""
    kinds = [df.schema[k].dataType for k in keys]
    first = T.StructType([*[T.StructField(k, t) for k, t in zip(keys, kinds)], T.StructField("pos", T.IntegerType())])
    out = T.StructType([T.StructField("token", T.StringType()), T.StructField("o", T.StructType([T.StructField("first", first), T.StructField("cpos", T.IntegerType())]))])
    flat = not any(isinstance(t, _NESTED) for t in kinds)

    def run(batches):
        for batch in batches:
            for lo, hi in lots(batch.column(len(keys)), LOT_BYTES // 4 if flat else 0):
                part = batch.slice(lo, hi - lo)
                of = [part.column(i) for i in range(len(keys))]
                tokens, row, pos, cpos = _first_characters(of if flat else [pa.array([0])], part.column(len(keys)))
                place = pa.StructArray.from_arrays([*[k.take(row) for k in of], pa.array(pos, pa.int32())], names=[*keys, "pos"])
                o = pa.StructArray.from_arrays([place, pa.array(cpos, pa.int32())], names=["first", "cpos"])
                yield pa.record_batch([pa.array(tokens, pa.string()), o], ["token", "o"])

    return df.select(*keys, F.make_valid_utf8(normalize_text(text)).alias("__text")).mapInArrow(run, out)


def _word_characters(words: DataFrame) -> DataFrame:
    """(token, o) of the characters of every batch of words."""
    out = T.StructType([T.StructField("token", T.StringType()), T.StructField("o", T.StructType([words.schema["first"], T.StructField("cpos", T.IntegerType())]))])
    flat = not any(isinstance(f.dataType, _NESTED) for f in words.schema["first"].dataType)

    def run(batches):
        for batch in batches:
            first = batch.column("first")
            order, group = _ordered(first.flatten() if flat else [pa.array(range(len(first)))])
            text = batch.column("word").take(order).to_pylist()
            starts = np.cumsum([0, *map(len, text)])
            whole = "".join(text)
            at = [whole.index(c) for c in dict.fromkeys(whole)]
            # words that share their first place, as repeated keys give them, are compared character by character
            alike = np.append(group[1:] == group[:-1], False) | np.insert(group[1:] == group[:-1], 0, False) if flat else np.ones(len(text), bool)
            at = sorted({*at, *(int(starts[i]) + text[i].index(c) for i in np.flatnonzero(alike) for c in dict.fromkeys(text[i]))})
            tokens, at = [whole[i] for i in at], np.array(at, np.int64)
            row = np.searchsorted(starts, at, side="right") - 1
            o = pa.StructArray.from_arrays([first.take(order.take(pa.array(row))), pa.array(at - starts[row], pa.int32())], names=["first", "cpos"])
            yield pa.record_batch([pa.array(tokens, pa.string()), o], ["token", "o"])

    return words.select("word", "first").mapInArrow(run, out)


# ---------------------------------------------------------------- A15, L1

def _symbols(sym_col: str = "sym"):
    """The symbols of a segmentation string, as an array."""
    return F.split(F.expr(f"substring({sym_col}, 2, length({sym_col}) - 2)"), _R + _L)


def encode_symbols(word) -> F.Column:
    """A word as its segmentation string, one symbol per character."""
    w = F.col(word) if isinstance(word, str) else word
    return F.concat(F.lit(_L), F.array_join(to_chars(w), _R + _L), F.lit(_R))


def pair_counts(table: DataFrame, sym: str = "sym", freq: str = "freq") -> DataFrame:
    """(left, right, count) of adjacent symbols weighted by word frequency.

    Overlapping pairs count (``aaa`` gives (a, a) twice).  Partial aggregation
    before the shuffle keeps hot pairs cheap.
    """
    s = _symbols(sym)
    n = F.size(s) - 1
    pairs = F.arrays_zip(F.slice(s, 1, n).alias("left"), F.slice(s, 2, n).alias("right"))
    return (table.filter(F.size(s) > 1)
                 .select(F.explode(pairs).alias("p"), F.col(freq))
                 .groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right"))
                 .agg(F.sum(freq).cast("bigint").alias("count")))


def top_pairs(pairs: DataFrame, k: int = 1) -> DataFrame:
    """L1: the k most frequent pairs; ties by left, then right (binary string order)."""
    return pairs.orderBy(F.col("count").desc(), F.col("left").asc(), F.col("right").asc()).limit(k)


# ---------------------------------------------------------------- T1, T2

#: The words that guesses are made from (half as many in the sample of all words), the merges guessed from the
#: sample, those guessed from whole pairs at most, the pairs whose histories a round brings to the driver.
GUESS_WORDS, GUESS_MERGES, MOST_GUESSES, GUESS_PAIRS = 1 << 15, 256, 1 << 10, 1 << 11
#: Best pairs of which all words must be at hand, else a sample of all words gives the guesses.
WHOLE_PAIRS = 64
#: Merges that may wait before the segmentations are written anew: these at least and at most, else half of those done.
WAITING = (64, 1 << 10)
#: Words of a file of segmentations at most; small files are read together, large ones by many tasks.
FILE_WORDS = 1 << 16
#: Sums that a task holds before it emits them.
HELD_SUMS = 1 << 18


def apply_merges(sym, merges) -> F.Column:
    """Rewrite a segmentation by merges (left to right, non-overlapping)."""
    c = F.col(sym) if isinstance(sym, str) else sym
    for l, r in merges:
        c = F.replace(c, F.lit(_L + l + _R + _L + r + _R), F.lit(_L + l + r + _R))
    return c


def _times(merges) -> dict[tuple[str, str], list[int]]:
    """The places of every pair in a sequence of merges, ascending."""
    out: dict[tuple[str, str], list[int]] = {}
    for t, pair in enumerate(merges):
        out.setdefault(pair, []).append(t)
    return out


def replay(word: str | list[str], times: dict, start: int, note=None, changes: bool = False) -> list[str]:
    """Apply a sequence of merges to one word (or its symbols so far) in its order; the symbols left.

    ``note(left, right, step, change)`` hears the pairs that the word holds before merge ``start``
    (step 0) and the changes that merge ``start + i`` makes (step i + 1).
    With ``changes`` it hears at step 0 what the merges before ``start`` change, and not the pairs.  O(n log n) in the word's length.
    """
    sym = list(word)
    end = len(sym)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    queue: list[tuple] = []
    heard = note is None or changes

    def offer(i: int, now: int) -> None:
        j = after[i] if i >= 0 else end
        if j < end and (at := times.get((sym[i], sym[j]))) is not None:
            k = bisect.bisect_right(at, now)
            if k < len(at):
                heapq.heappush(queue, (at[k], i, sym[i], sym[j]))

    def held() -> None:
        i = 0
        while end and after[i] < end:
            note(sym[i], sym[after[i]], 0, 1)
            i = after[i]

    for i in range(end):
        offer(i, -1)
    while queue:
        t, i, left, right = heapq.heappop(queue)
        j = after[i]
        if sym[i] != left or j >= end or sym[j] != right:
            continue
        if not heard and t >= start:
            held()
            heard = True
        h, k, new, step = before[i], after[j], left + right, t - start + 1
        if changes:
            step = max(0, step)
        if note is not None and (step > 0 or changes):
            note(left, right, step, -1)
            if h >= 0:
                note(sym[h], left, step, -1)
                note(sym[h], new, step, 1)
            if k < end:
                note(right, sym[k], step, -1)
                note(new, sym[k], step, 1)
        sym[i], sym[j] = new, None
        after[i] = k
        if k < end:
            before[k] = i
        offer(h, t)
        offer(i, t)
    if not heard:
        held()
    return [s for s in sym if s is not None]


_JOINT = "\x01"


def _posting(left: str, right: str) -> int:
    """The hash by which a pair is found among the postings; ``_postings`` gives the same on Spark's side."""
    return zlib.crc32(f"{left}{_JOINT}{right}".encode())


def _postings(sym: str):
    """Hashes of a word's adjacent pairs."""
    rest = F.slice(sym, 2, F.greatest(F.size(sym) - 1, F.lit(0)))
    first = F.slice(sym, 1, F.greatest(F.size(sym) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(first, rest, lambda x, y: F.crc32(F.concat(x, F.lit(_JOINT), y))))


def _holding(segs: DataFrame, pairs) -> DataFrame:
    """The words that hold one of ``pairs``, and a few more whose hashes agree."""
    keys = sorted({_posting(*p) for p in pairs})
    return segs.where(F.expr(f"exists(pairs, p -> p in ({','.join(f'{k}L' for k in keys)}))")) if keys else segs.limit(0)


def _folder(spark: SparkSession, path: str):
    """The file system of a folder and the folder, as Hadoop has them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


@dataclass
class Segmented:
    """Every word's symbols after the first ``done`` merges, with postings, and the pair counts of that state.

    The words are files under ``path`` of the shared folder, where columns of repeated symbols and hashes are small;
    they are written where the words are, without a shuffle of their own.
    """

    segs: DataFrame
    counts: DataFrame
    done: int
    path: str

    @classmethod
    def of(cls, segs: DataFrame, done: int) -> Segmented:
        """``segs`` (sym, freq) written with postings to the shared folder; the counts are partial sums before one shuffle."""
        spark = segs.sparkSession
        parts, path = parallelism(spark), scratch_path(spark, "segmented")
        segs = segs.select("sym", "freq", _postings("sym").alias("pairs"))
        fs, folder = _folder(spark, path)
        fs.deleteOnExit(folder)
        segs.write.option("maxRecordsPerFile", FILE_WORDS).option("compression", "zstd").parquet(path)
        segs = spark.read.schema(segs.schema).parquet(path)
        n = F.size("sym") - 1
        pairs = segs.where("size(sym) > 1").select(F.explode(F.arrays_zip(F.slice("sym", 1, n).alias("left"), F.slice("sym", 2, n).alias("right"))).alias("p"), "freq")
        counts = pairs.groupBy("p.left", "p.right").agg(F.sum("freq").cast("bigint").alias("count"))
        return cls(segs, counts.coalesce(max(1, parts)).checkpoint(), done, path)

    def drop(self) -> None:
        """Delete the files, which nothing reads any more."""
        fs, folder = _folder(self.segs.sparkSession, self.path)
        fs.delete(folder, True)

    def advanced(self, merges: list[tuple[str, str]], to: int) -> Segmented:
        """The state after ``merges[:to]``; only words that hold a pair of the new ones are segmented anew."""
        times = self.segs.sparkSession.sparkContext.broadcast(_times(merges[self.done:to]))

        def run(batches):
            known = times.value
            for batch in batches:
                sym = [s if not any(p in known for p in zip(s, s[1:])) else replay(s, known, 0) for s in batch.column(0).to_pylist()]
                yield pa.record_batch([pa.array(sym, pa.list_(pa.string())), batch.column(1)], ["sym", "freq"])

        return Segmented.of(self.segs.select("sym", "freq").mapInArrow(run, "sym array<string>, freq bigint"), to)


def pair_histories(state: Segmented, merges: list[tuple[str, str]], guesses: list[tuple[str, str]]) -> DataFrame:
    """What every pair counts after ``merges`` and after each of ``guesses``: (left, right, most, steps).

    ``steps`` are (step, change) in order: at step 0 the count after ``merges``, at step i + 1 the change by
    guess i.  ``most`` is at least the pair's highest count.  Words without a pair of the merges since the
    state or of the guesses are not read beyond their postings: their part of the counts stays.  Sums are made
    in every task before the one shuffle, on the pair.
    """
    waiting = merges[state.done:]
    shared = state.segs.sparkSession.sparkContext.broadcast((_times([*waiting, *guesses]), len(waiting)))

    def table(sums: dict) -> pa.RecordBatch:
        left, right, step = zip(*sums) if sums else ((), (), ())
        return pa.record_batch([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(step, pa.int32()),
                                pa.array(sums.values(), pa.int64())], ["left", "right", "step", "change"])

    def run(batches):
        times, start = shared.value
        sums: dict[tuple[str, str, int], int] = {}
        for batch in batches:
            for sym, freq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                def note(left, right, step, change, freq=freq):
                    key = (left, right, step)
                    sums[key] = sums.get(key, 0) + change * freq

                replay(sym, times, start, note, changes=True)
                if len(sums) >= HELD_SUMS:
                    yield table(sums)
                    sums.clear()
        yield table(sums)

    touched = _holding(state.segs, [*waiting, *guesses]).select("sym", "freq")
    changes = touched.mapInArrow(run, "left string, right string, step int, change bigint").where("change != 0")
    before = state.counts.select("left", "right", F.lit(0).alias("step"), F.col("count").alias("change"))
    steps = (before.unionByName(changes).repartition("left", "right").groupBy("left", "right", "step").agg(F.sum("change").alias("change"))
                   .where("change != 0"))
    return steps.groupBy("left", "right").agg(
        F.sum(F.greatest("change", F.lit(0))).alias("most"),
        F.array_sort(F.collect_list(F.struct("step", "change"))).alias("steps"))


class _Best:
    """Counts of pairs and the best of them: highest count, then left, then right."""

    def __init__(self, counts: dict):
        self.counts = dict(counts)
        self.queue = [(-c, *pair) for pair, c in self.counts.items()]
        heapq.heapify(self.queue)

    def put(self, pair: tuple[str, str], count) -> None:
        self.counts[pair] = count
        heapq.heappush(self.queue, (-count, *pair))

    def top(self):
        """(-count, left, right) of the best pair with a positive count, or None."""
        while self.queue:
            minus, left, right = self.queue[0]
            if minus < 0 and self.counts[left, right] == -minus:
                return self.queue[0]
            heapq.heappop(self.queue)
        return None


def _settled(rows, guesses: list[tuple[str, str]], truncated: bool):
    """The merges that exact counts prove; what is known for the next guess.

    Known are the counts just before the last of these merges, a bound of all other pairs' counts, and the
    changes that each guessed merge made.

    ``rows`` are pair histories, best ``most`` first; if ``truncated``, pairs that rank behind the last row
    exist, and a best pair that does not rank before them proves nothing.
    """
    events: dict[int, list] = {}
    for r in rows:
        for step, change in r["steps"]:
            events.setdefault(step, []).append(((r["left"], r["right"]), change))
    last = (-rows[-1]["most"], rows[-1]["left"], rows[-1]["right"]) if truncated else None
    best, taken = _Best({}), []
    for step in range(len(guesses) + 1):
        for pair, change in events.get(step, ()):
            best.put(pair, best.counts.get(pair, 0) + change)
        top = best.top()
        if top is None or (last is not None and top > last):
            break
        taken.append(top[1:])
        if step == len(guesses) or taken[-1] != guesses[step]:
            break
    counts: dict[tuple[str, str], int] = {}
    for step in range(len(taken)):
        for pair, change in events.get(step, ()):
            counts[pair] = counts.get(pair, 0) + change
    effects = {pair: dict(events.get(i + 1, ())) for i, pair in enumerate(guesses)}
    return taken, (counts, -last[0] if truncated else 0, effects)


def _guess(sample: list[tuple[list[str], float]], merges: list[tuple[str, str]], known, n: int) -> list[tuple[str, str]]:
    """The next ``n`` merges as the sample and what the last round made known (None before the first) foresee them.

    ``merges`` are those that the sample's words haven't seen yet.  A merge changes the counts as it did in the
    last round's sequence, else in the sample's proportions.
    """
    exact, others, effects = known or ({}, 0, {})
    if not sample:
        return []
    past = merges[:-1] if exact else merges
    times = _times(past)
    words = [replay(w, times, 0) for w, _ in sample]
    seen: dict[tuple[str, str], int] = {}
    where: dict[tuple[str, str], set[int]] = {}
    for i, (sym, (_, freq)) in enumerate(zip(words, sample)):
        for pair in zip(sym, sym[1:]):
            seen[pair] = seen.get(pair, 0) + freq
            where.setdefault(pair, set()).add(i)
    likely = _Best({p: min(c, others) if exact else c for p, c in seen.items()} | exact)
    out: list[tuple[str, str]] = []
    forced = merges[-1] if exact else None
    while len(out) < n:
        if forced is not None:
            pair, forced = forced, None
        else:
            top = likely.top()
            if top is None:
                break
            pair = top[1:]
            out.append(pair)
        scale = likely.counts.get(pair, 0) / seen[pair] if seen.get(pair, 0) > 0 else 1
        change: dict[tuple[str, str], int] = {}
        for i in where.pop(pair, ()):
            old, freq, new, j = words[i], sample[i][1], [], 0
            while j < len(old):
                if j + 1 < len(old) and (old[j], old[j + 1]) == pair:
                    new.append(old[j] + old[j + 1])
                    j += 2
                else:
                    new.append(old[j])
                    j += 1
            for p in zip(old, old[1:]):
                change[p] = change.get(p, 0) - freq
            for p in zip(new, new[1:]):
                change[p] = change.get(p, 0) + freq
                where.setdefault(p, set()).add(i)
            words[i] = new
        change[pair] = -seen.get(pair, 0)
        effect = effects.get(pair)
        for p, c in change.items():
            seen[p] = seen.get(p, 0) + c
            if effect is None:
                likely.put(p, likely.counts.get(p, 0) + c * scale)
        for p, c in (effect or {}).items():
            likely.put(p, likely.counts.get(p, 0) + c)
        likely.put(pair, 0)
    return out


def _first(df: DataFrame, n: int, *order) -> list:
    """The first ``n`` rows in an order, found on the executors (never one set for each partition on the driver)."""
    return df.orderBy(*order).limit(n).coalesce(1).collect()


def _sample(state: Segmented, n: int) -> list[tuple[list[str], float]]:
    """At most ``n`` words: half of them the most frequent, the rest by hash, weighted to stand for all rarer words."""
    if n < 2:
        return []
    key = F.array_join("sym", "")
    table = state.segs.select("sym", "freq", key.alias("word"))
    often = [(r["sym"], r["freq"], r["word"]) for r in _first(table, n // 2, F.desc("freq"), "word")]
    if len(often) < n // 2:
        return [(s, f) for s, f, _ in often]
    _, least, last = often[-1]
    rare = table.where((F.col("freq") < least) | ((F.col("freq") == least) & (F.col("word") > last)))
    some = [(r["sym"], r["freq"]) for r in _first(rare, n - len(often), F.xxhash64("word"), "word")]
    weight = (rare.agg(F.sum("freq")).first()[0] or 0) / max(1, sum(f for _, f in some))
    return [(s, f) for s, f, _ in often] + [(s, f * weight) for s, f in some]


def _words_of(state: Segmented, merges: list[tuple[str, str]], known, n: int) -> tuple[list[tuple[list[str], float]], int]:
    """At most ``n`` words that hold the best known pairs, as they were before the last merge, and the number of pairs of which all words are there.

    With all words of a pair at hand the driver foresees what its merge does.
    """
    if n < 2:
        return [], 0
    best = [merges[-1], *(p[1:] for p in heapq.nsmallest(GUESS_PAIRS, ((-c, *pair) for pair, c in known[0].items() if c > 0)))]
    if len(best) <= WHOLE_PAIRS or _holding(state.segs, best[:WHOLE_PAIRS]).limit(n + 1).count() > n:  # not worth more
        return [], 0
    shared = state.segs.sparkSession.sparkContext.broadcast((_times(merges[state.done:-1]), {p: i for i, p in reversed(list(enumerate(best)))}))

    def run(batches):
        times, rank = shared.value
        for batch in batches:
            found: list[tuple] = []
            for sym, freq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sym = replay(sym, times, 0) if times else sym
                first = min((rank[p] for p in zip(sym, sym[1:]) if p in rank), default=None)
                if first is not None:
                    found.append((first, sym, freq))
            ranks, syms, freqs = zip(*found) if found else ((), (), ())
            yield pa.record_batch([pa.array(ranks, pa.int32()), pa.array(syms, pa.list_(pa.string())), pa.array(freqs, pa.int64())], ["rank", "sym", "freq"])

    held = _holding(state.segs, [*merges[state.done:], *best]).select("sym", "freq").mapInArrow(run, "rank int, sym array<string>, freq bigint")
    rows = _first(held, n + 1, "rank", F.desc("freq"), "sym")
    return [(r["sym"], r["freq"]) for r in rows[:n]], rows[n]["rank"] if len(rows) > n else len(best)


def bpe_train(corpus: DataFrame, text: str, keys, vocab_size: int | None = None,
              new_tokens: int | None = None, head: int = GUESS_PAIRS,
              guess_words: int = GUESS_WORDS, guess_merges: int = GUESS_MERGES, waiting: tuple[int, int] = WAITING,
              on_round: Callable[[dict], None] | None = None) -> BpeModel:
    """Train byte-pair merges on the whole corpus.

    ``keys`` give the corpus order (first appearance decides alphabet ids).
    Give ``vocab_size`` (specials + alphabet + merged tokens) or
    ``new_tokens`` (the vocabulary is then 3 + alphabet + new_tokens).
    Textbook semantics: all non-overlapping occurrences merge, frequencies are
    summed, ranks are unique; a merge whose string already exists adds a
    merge but no vocabulary entry.

    ``guess_words`` words foresee the merges of a round, at first ``guess_merges`` (0 words: none, a
    round then adds one merge); ``head`` pair histories check them; ``waiting`` merges, at least and at most, come
    before the segmentations are written anew.  The four change the number and cost of rounds only.
    ``on_round`` hears of every round: merges so far, guessed, taken, words touched by the guesses, seconds.
    """
    spark = corpus.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    alpha_rows = alphabet(corpus, text, keys).orderBy("id")
    cap = (vocab_size - len(SPECIALS) + 1) if vocab_size is not None else None
    alpha = [r["token"] for r in (alpha_rows.limit(cap) if cap is not None else alpha_rows).collect()]
    if vocab_size is None:
        if new_tokens is None:
            raise ValueError("give vocab_size or new_tokens")
        vocab_size = len(SPECIALS) + len(alpha) + new_tokens
    if len(SPECIALS) + len(alpha) > vocab_size:
        raise ValueError(f"alphabet of {len(alpha)}+ characters does not fit a vocabulary of {vocab_size}")
    tokens = list(SPECIALS) + alpha
    ever = set(tokens)
    merges: list[tuple[str, str]] = []

    words = word_freq(corpus, text, keys).select("word", "freq")  # first places would be sorted and shuffled for every word
    state = Segmented.of(words.filter(F.length("word") > 1).select(to_chars("word").alias("sym"), "freq"), 0)
    sample = _sample(state, guess_words // 2)
    known, stuck = None, False
    while len(tokens) < vocab_size:
        began = time.time()
        left = vocab_size - len(tokens)
        own, whole = _words_of(state, merges, known, guess_words) if known and not stuck else ([], 0)
        if stuck:
            guesses = []
        elif whole >= WHOLE_PAIRS:
            # these words show what merges do; what last round's guesses did held in their order
            guesses = _guess(own, merges[-1:], (*known[:2], {}), min(MOST_GUESSES, whole + whole // 4, left))
        else:  # the best pairs are in too many words: a sample of all words
            guesses = _guess(sample, merges, known, min(guess_merges, left))
        rows = _first(pair_histories(state, merges, guesses).where("most > 0"), head, F.desc("most"), "left", "right")
        if not rows:
            break
        taken, known = _settled(rows, guesses, len(rows) >= head)
        # without guesses the order is that of the counts, so the best pair is always proven
        stuck = not taken
        for l, r in taken:
            if len(tokens) >= vocab_size:
                break
            merges.append((l, r))
            if l + r not in ever:
                tokens.append(l + r)
                ever.add(l + r)
        if on_round is not None:
            on_round({"merges": len(merges), "guessed": len(guesses), "taken": len(taken), "done": state.done, "whole_pairs": whole, "touched": _holding(state.segs, guesses).count(), "seconds": time.time() - began})
        low, most = waiting
        if taken and len(merges) - state.done >= min(most, max(low, state.done // 2)):
            before, state = state, state.advanced(merges, len(merges) - 1)  # what is known holds before the last merge
            before.drop()
    state.drop()
    return BpeModel(tokens, merges)


# ---------------------------------------------------------------- T3

def bpe_word(word: str, ranks: dict) -> list[str]:
    """Greedy encoding of one word: merge the lowest-rank pair, leftmost first, until none applies.

    Symbols form a linked list; a heap holds the mergeable neighbours as (rank, position).  Entries whose
    symbols have changed since are skipped, so a word of n characters takes O(n log n).
    """
    sym = list(word)
    end = len(sym)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else end
        if j < end and (rank := ranks.get((sym[i], sym[j]))) is not None:
            heapq.heappush(queue, (rank, i, sym[i], sym[j]))

    for i in range(end):
        offer(i)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if sym[i] != left or j >= end or sym[j] != right:
            continue
        sym[i], sym[j] = left + right, None
        after[i] = after[j]
        if after[j] < end:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [s for s in sym if s is not None]


WORD_CODES = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])


def encode_words(words: DataFrame, model: BpeModel, word: str = "word") -> DataFrame:
    """T3 + J3: (word, tokens, ids) for each row of a distinct-word table.

    Runs the merge loop in Arrow batches; ranks and ids are broadcast once
    (their size is bounded by the vocabulary size).
    """
    ship_package(words.sparkSession)
    sc = words.sparkSession.sparkContext
    b_ranks = sc.broadcast(model.ranks)
    b_ids = sc.broadcast(model.ids)

    def run(batches):
        ranks, ids = b_ranks.value, b_ids.value
        for pdf in batches:
            toks = [bpe_word(w, ranks) for w in pdf[word]]
            yield pd.DataFrame({
                "word": pdf[word],
                "tokens": toks,
                "ids": [[ids.get(t, UNK_ID) for t in ts] for ts in toks],
            })

    spark = words.sparkSession
    return (words.select(F.col(word).alias("word")).repartition(parallelism(spark), "word")
                 .mapInPandas(run, WORD_CODES))


# ---------------------------------------------------------------- T4, T6, T7

#: Encoded words that a task remembers, and the characters of the longest of them.
WORD_CACHE, CACHED_CHARS = 1 << 16, 64


def encode(df: DataFrame, text: str, keys, model: BpeModel, add_eos: bool = True, dealt: bool = False) -> DataFrame:
    """T4: (keys..., ids array<int>) for every row; an empty text encodes to [] (+ EOS).

    Every row is encoded where it is, in Arrow batches, with the ranks broadcast and
    a bounded cache of words per task: no shuffle, no hot word, and rows with equal
    keys stay apart.  Rows that are ``dealt`` to tasks already aren't spread.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ship_package(df.sparkSession)
    sc = df.sparkSession.sparkContext
    b_ranks, b_ids = sc.broadcast(model.ranks), sc.broadcast(model.ids)

    seen: dict[str, list[int]] = {}  # of one task

    def encoded(texts: pa.Array) -> pa.ListArray:
        ranks, ids = b_ranks.value, b_ids.value
        lists = word_lists(texts)
        words = lists.flatten().dictionary_encode()
        some = []
        for w in words.dictionary.to_pylist():
            c = seen.get(w)
            if c is None:
                c = [ids.get(t, UNK_ID) for t in bpe_word(w, ranks)]
                if len(seen) < WORD_CACHE and len(w) <= CACHED_CHARS:
                    seen[w] = c
            some.append(c)
        size = np.array([len(c) for c in some], np.int64)[words.indices.to_numpy()] if some else np.zeros(0, np.int64)
        tokens = pa.array(some, pa.list_(pa.int32())).take(words.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy()[1:]]
        if add_eos:
            tokens = np.insert(tokens, ends, EOS_ID)
            ends = ends + np.arange(1, len(ends) + 1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens, pa.int32()))

    @F.arrow_udf("array<int>")
    def codes(texts: pa.Array) -> pa.Array:
        found = [encoded(texts.slice(lo, hi - lo)) for lo, hi in lots(texts, LOT_BYTES)]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    rows = df.select(*keys, text)
    rows = (rows if dealt else spread(rows)).select(*keys, F.make_valid_utf8(normalize_text(text)).alias("__text"))
    return rows.select(*keys, codes("__text").alias("ids"))


def token_to_id(tokens: DataFrame, token: str, vocab: DataFrame, max_vocab: int) -> DataFrame:
    """Look tokens up in the vocabulary; unknown -> UNK id 1."""
    v = bounded_broadcast(vocab.select(F.col("token").alias("__t"), F.col("id")), max_vocab)
    return (tokens.join(v, tokens[token] == v["__t"], "left")
                  .withColumn("id", F.coalesce(F.col("id"), F.lit(UNK_ID)))
                  .drop("__t"))


def _vocab_literal(tokens: list[str]):
    """The vocabulary as one constant array: a single string literal split on a
    private-use separator that no token contains (constant-folded by Catalyst)."""
    text = "".join(tokens)
    sep = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
    return F.split(F.lit(sep.join(tokens)), sep, -1)


def decode(df: DataFrame, ids: str, keys, model: BpeModel) -> DataFrame:
    """T6 + J4: ids -> tokens -> one string per row; specials appear literally.

    The vocabulary (bounded by the model's vocab_size) is a constant array, so
    each row is decoded in place by index lookup — no explode, join or
    regrouping shuffle.  An id outside the vocabulary raises.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    vocab = _vocab_literal(model.tokens)
    n = len(model.tokens)

    def look(i):
        ok = (i >= 0) & (i < n)
        return F.when(ok, F.element_at(vocab, F.when(ok, i + 1).otherwise(1))).otherwise(
            F.raise_error(F.concat(F.lit("token id out of range: "), i.cast("string"))))

    return df.select(*keys, join_tokens(F.transform(F.col(ids), look)).alias("text"))


def round_trip(df: DataFrame, text: str, keys, model: BpeModel) -> DataFrame:
    """decode(encode(x, no EOS)); equals the normalised text when every character is known."""
    return decode(encode(df, text, keys, model, add_eos=False), "ids", keys, model)


# ---------------------------------------------------------------- T5, A16

def encode_batch(encoded: DataFrame, batch: str, ids: str = "ids") -> DataFrame:
    """T5: right-pad every encoding with PAD to the longest one of its batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return encoded.withColumn(ids, pad_array(ids, longest, PAD_ID))


def encoded_lengths(encoded: DataFrame, keys, ids: str = "ids") -> DataFrame:
    """Tokens per text."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return encoded.select(*keys, F.size(ids).cast("int").alias("n_tokens"))


def sorted_vocab(vocab: DataFrame, token: str = "token") -> DataFrame:
    """L4: the vocabulary listed in token order (binary string order)."""
    return vocab.orderBy(token)


# ---------------------------------------------------------------- J7

def vocab_overlap(a: DataFrame, b: DataFrame, token: str = "token") -> dict[str, DataFrame]:
    """Common tokens, tokens only in a, tokens only in b."""
    ta, tb = a.select(token).distinct(), b.select(token).distinct()
    return {"common": ta.intersect(tb),
            "only_a": ta.join(tb, token, "left_anti"),
            "only_b": tb.join(ta, token, "left_anti")}
