"""Language-model scoring from a log-frequency Bloom filter.

Learning counts all words and word pairs of the training texts.  A count c
gets the level 1 + floor(log(c) / log(BASE)); the filter holds the events
(pair, 1) to (pair, level), so its size follows the sum of the levels.  A
probe asks for (pair, 1), (pair, 2), ... until the filter says no; the level
reached stands for the mean of the counts that share it.  Words carry their
exact counts beside the filter, because the add-0.1 base score needs them.

A token's probability is its pair's estimated count smoothed towards the base:
``(c(prev, tok) + STRENGTH * base(tok)) / (c(prev) + STRENGTH)``.  No pair can
occur more often than its words, so a level is held against theirs, which also
stops false positives of unknown words.

The filter comes in blocks of about a million pairs, dealt by the key's top
bits; their number follows the bytes of the training texts.  All blocks are
broadcast while they take ``BROADCAST_BYTES`` at most.  Beyond that a
broadcast has no bound, so the texts are dealt into groups of bounded bytes,
every group asks each block for its distinct words and pairs once, and the
answers meet the texts again.  Both ways give the same scores.

Defined results: a null text is empty and has the one token that ends it.
Words are told apart by 64-bit hashes, pairs by block and 32 bits, within the
error of the filter.  Without training texts every base probability is 1.  Repeated rows are
scored each; an empty table gives no rows; texts are read whole; input columns
named like a result are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.llm.textbuf import BROADCAST_BYTES, NOT_SPACE, mix64, per_row, rows_of, runs, slices, stored, word_hashes

#: Counts of one level lie between two powers of this base.
BASE = 1.5
#: Added to the words of a context, shared out as the base probabilities say.
STRENGTH = 8.0
ADDED = 0.1
BITS_PER_EVENT, PROBES = 16, 4
#: Levels of any count below 2 ** 63.
MAX_LEVEL = 1 + int(63 * math.log(2) / math.log(BASE))
#: Text bytes for each filter block and for each group of texts that asks the blocks.
BLOCK_BYTES, GROUP_BYTES = 16 << 20, 4 << 20
#: Tokens that a task counts before it sends them on; text bytes that it tokenises at once.
FLUSH_TOKENS, STEP_BYTES = 1 << 20, 1 << 21

_U64 = np.uint64
_START, _END = _U64(0x53F1A9C3D2E4B687), _U64(0x9D2C5680EFC60001)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Words of up to so many bytes are hashed eight bytes at a time, all words together.
SHORT_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _level_means() -> np.ndarray:
    """The mean of the whole counts of each level; 0 for level 0, the geometric mean where a level has none."""
    out = [0.0]
    for j in range(1, MAX_LEVEL + 1):
        lo, hi = math.ceil(BASE ** (j - 1) - 1e-9), math.ceil(BASE ** j - 1e-9) - 1
        out.append((lo + hi) / 2 if hi >= lo else BASE ** (j - 0.5))
    return np.array(out)


MEANS = _level_means()
_BOUNDS = np.array([BASE ** j for j in range(MAX_LEVEL)]) * (1 - 1e-12)


def levels(counts: np.ndarray) -> np.ndarray:
    """Level of each count, 0 for 0."""
    return np.searchsorted(_BOUNDS, counts, side="right").astype(np.int64)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; different words of up to eight bytes and of one length never share it."""
    size = ends - starts
    out = size.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    todo = np.flatnonzero(size <= SHORT_WORD)
    for i in range(0, SHORT_WORD, 8):
        todo = todo[size[todo] > i]
        out[todo] = mix64(out[todo] ^ (eight[starts[todo] + i] & _MASKS[np.minimum(size[todo] - i, 8)]))
    long = np.flatnonzero(size > SHORT_WORD)
    cut = np.searchsorted(np.cumsum(size[long]), np.arange(1, int(size[long].sum()) // (1 << 20) + 1) << 20)
    for piece in np.split(long, np.unique(cut)):
        out[piece] = word_hashes(data, starts[piece], ends[piece])
    return out


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row, one end behind them, and the first token of each row (with an end entry)."""
    low = _LOWER[data]
    starts, ends = runs(NOT_SPACE[low], bounds)
    n = per_row(rows_of(starts, bounds), len(bounds) - 1)
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(first[-1], _END, dtype=np.uint64)
    is_word = np.ones(first[-1], dtype=bool)
    is_word[first[1:] - 1] = False
    out[is_word] = _hashes(low, starts, ends)
    return out, first


def tokens_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of a whole column, made in steps."""
    toks, first, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, data, bounds in slices(texts, STEP_BYTES):
        t, f = tokens(data, bounds)
        toks.append(t)
        first.append(f[1:] + n)
        n += len(t)
    return np.concatenate(toks), np.concatenate(first)


def previous(toks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each, the start mark for the first of a row."""
    prev = np.empty_like(toks)
    prev[1:] = toks[:-1]
    prev[first[:-1]] = _START
    return prev


def pair_keys(prev: np.ndarray, toks: np.ndarray) -> np.ndarray:
    return mix64(prev * _U64(0xD6E8FEB86659FD93) + toks)


def _short(keys: np.ndarray, block_bits: int) -> np.ndarray:
    """The 32 bits below a key's block."""
    return ((keys << _U64(block_bits)) >> _U64(32)).astype(np.uint32)


def _places(short: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit of each event and the step to its next ones, modulo ``size``."""
    h = mix64((short.astype(np.uint64) << _U64(8)) + _U64(level))
    return h % _U64(size), (mix64(h) | _U64(1)) % _U64(size)


def filter_bits(short: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of pairs with counts, as bytes."""
    top = levels(counts)
    size = max(64, -(-int(top.sum()) * BITS_PER_EVENT // 8) * 8)
    bits = np.zeros(size, dtype=bool)
    for j in range(1, int(top.max(initial=0)) + 1):
        at, step = _places(short[top >= j], j, size)
        for _ in range(PROBES):
            bits[at] = True
            at = (at + step) % _U64(size)
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, short: np.ndarray) -> np.ndarray:
    """The level that each pair reaches: the last one before the first event that isn't held."""
    out = np.zeros(len(short), dtype=np.uint8)
    asked, size = np.arange(len(short)), len(bits) * 8
    for j in range(1, MAX_LEVEL + 1):
        at, step = _places(short[asked], j, size)
        for _ in range(PROBES):
            held = np.flatnonzero((bits[(at >> _U64(3)).astype(np.int64)] >> (at & _U64(7)).astype(np.uint8)) & 1)
            asked, step = asked[held], step[held]
            at = (at[held] + step) % _U64(size)
        if not len(asked):
            break
        out[asked] = j
    return out


def _in_turn(bits: np.ndarray, short: np.ndarray) -> np.ndarray:
    """``probe`` in steps, which bounds the temporaries."""
    return np.concatenate([probe(bits, short[i:i + (1 << 18)]) for i in range(0, len(short), 1 << 18)] or [np.zeros(0, np.uint8)])


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then their next ones: high bytes that are mostly zero shrink in an exchange."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(cell: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _sorted_cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells of ascending values that end at ``ends``: the first one and the steps to the next, in planes."""
    return pa.array([_planes(np.diff(part, prepend=part.dtype.type(0))) for part in np.split(values, ends[:-1])], pa.binary())


def _ascending(cell: bytes, kind) -> np.ndarray:
    """The values of a cell of ``_sorted_cells``."""
    return np.cumsum(_unplaned(cell, kind), dtype=kind)


def _plane_cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells of consecutive values that end at ``ends``, in planes."""
    return pa.array([_planes(part) for part in np.split(values, ends[:-1])], pa.binary())


def _block_ends(keys: np.ndarray, block_bits: int) -> np.ndarray:
    """End of each block among sorted keys."""
    return np.searchsorted(keys >> _U64(64 - block_bits), np.arange(1 << block_bits, dtype=np.uint64), side="right")


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    found = pc.value_counts(pa.array(keys))
    values, n = found.field(0).to_numpy(), found.field(1).to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _join(cells: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), dtype=kind)


def _joined(cells: pa.ChunkedArray, kind, read) -> np.ndarray:
    return np.concatenate([read(c, kind) for c in cells.to_pylist()] or [np.zeros(0, kind)])


PARTS = "block int, words binary, word_counts binary, pairs binary, pair_counts binary"
BLOCKS = "block int, words binary, word_counts binary, bits binary, n_tokens long, n_words long"


@dataclass(frozen=True)
class Model:
    """Filter blocks (a stored table), texts and tokens learned from, distinct tokens, and the bytes of all blocks."""

    blocks: DataFrame
    block_bits: int
    texts: int
    tokens: int
    distinct: int
    bytes: int


def train(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> Model:
    """Counts words and pairs of all texts; tasks pre-aggregate, one exchange deals packed counts by block."""
    docs = docs.select(F.col(f"`{text}`").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = max(1, math.ceil(math.log2(max(1, (size[0] or 0) / block_bytes))))

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def part():
            words, n_words = _counted(np.concatenate([t for t, _ in held]))
            pairs, n_pairs = _counted(np.concatenate([p for _, p in held]))
            w_ends, p_ends = _block_ends(words, bits), _block_ends(pairs, bits)
            return pa.record_batch([pa.array(np.arange(1 << bits, dtype=np.int32)), _sorted_cells(words, w_ends), _plane_cells(n_words, w_ends),
                                    _sorted_cells(_short(pairs, bits), p_ends), _plane_cells(n_pairs.astype(np.uint32), p_ends)],
                                   ["block", "words", "word_counts", "pairs", "pair_counts"])

        for batch in batches:
            for _, _, data, bounds in slices(batch.column(0), STEP_BYTES):
                toks, first = tokens(data, bounds)
                held.append((toks, pair_keys(previous(toks, first), toks)))
                n += len(toks)
                if n >= FLUSH_TOKENS:
                    yield part()
                    held.clear()
                    n = 0
        if held:
            yield part()

    def build(table: pa.Table) -> pa.Table:
        words, n_words = _summed(_joined(table["words"], np.uint64, _ascending), _joined(table["word_counts"], np.int64, _unplaned))
        pairs, n_pairs = _summed(_joined(table["pairs"], np.uint32, _ascending), _joined(table["pair_counts"], np.uint32, _unplaned).astype(np.int64))
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "words": [words.tobytes()], "word_counts": [n_words.tobytes()],
                         "bits": [filter_bits(pairs, n_pairs).tobytes()], "n_tokens": [int(n_words.sum())], "n_words": [len(words)]})

    blocks = stored(docs.mapInArrow(count, PARTS).groupBy("block").applyInArrow(build, BLOCKS), "lm_blocks")
    totals = blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.octet_length("words") * 2 + F.octet_length("bits"))).first()
    return Model(blocks, bits, size[1], *(int(x or 0) for x in totals))


class _Scorer:
    """Turns counts of words and levels of pairs into the results of a run of texts."""

    def __init__(self, model: Model):
        self.texts, self.n = model.texts, model.tokens
        self.floor = model.tokens + ADDED * (model.distinct + 1)

    def results(self, toks: np.ndarray, first: np.ndarray, count_of, level_of) -> dict[str, np.ndarray]:
        """``count_of`` sorted distinct words, ``level_of`` sorted distinct pairs."""
        prev = previous(toks, first)
        word, at = _distinct(toks)
        c = count_of(word)[at]
        c_prev = np.empty_like(c)
        c_prev[1:] = c[:-1]
        c_prev[first[:-1]] = self.texts
        pair, at = _distinct(pair_keys(prev, toks))
        level = np.minimum(level_of(pair)[at], levels(np.minimum(c, c_prev)))
        base = (c + ADDED) / self.floor
        p = (np.minimum(MEANS[level], c_prev) + STRENGTH * base) / (c_prev + STRENGTH)
        total = lambda x: np.add.reduceat(x, first[:-1])
        return {"n_tokens": np.diff(first), "n_known": total((c > 0).astype(np.int64)), "base_score": total(np.log10(base)), "score": total(np.log10(p))}


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    coded = pa.array(keys).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[coded.indices.to_numpy()]


def _counts_in(words: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Count of each asked word among sorted words."""
    if not len(words):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    return np.where(words[at] == asked, counts[at], 0)


RESULTS = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def score(docs: DataFrame, model: Model, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score of every text."""
    names = {n for n, _ in RESULTS} | {"train_tokens"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names or c == text])
    if model.bytes <= broadcast_bytes:
        out = _score_broadcast(docs, model, text)
    else:
        out = _score_blocks(docs, model, text, group_bytes)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in RESULTS])


def _score_broadcast(docs: DataFrame, model: Model, text: str) -> DataFrame:
    rows = model.blocks.orderBy("block").collect()
    every = {r["block"]: (np.frombuffer(r["words"], np.uint64), np.frombuffer(r["word_counts"], np.int64), np.frombuffer(r["bits"], np.uint8)) for r in rows}
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(every)
    bits, scorer, at = model.block_bits, _Scorer(model), docs.columns.index(text)

    def run(batches):
        blocks = shared.value

        def each(keys, kind, answer):
            """Answers of the blocks to sorted keys."""
            out, lo = np.zeros(len(keys), kind), 0
            for b, hi in enumerate(_block_ends(keys, bits)):
                if hi > lo and b in blocks:
                    out[lo:hi] = answer(blocks[b], keys[lo:hi])
                lo = hi
            return out

        for batch in batches:
            found: dict[str, list] = {n: [] for n, _ in RESULTS}
            for _, _, data, bounds in slices(batch.column(at), STEP_BYTES):
                got = scorer.results(*tokens(data, bounds), lambda w: each(w, np.int64, lambda b, k: _counts_in(b[0], b[1], k)),
                                     lambda p: each(p, np.uint8, lambda b, k: _in_turn(b[2], _short(k, bits))))
                for n in found:
                    found[n].append(got[n])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.concatenate(v)) if v else pa.array([], pa.int64() if n.startswith("n_") else pa.float64()) for n, v in found.items()]],
                                             names=[*batch.schema.names, *found])

    return docs.mapInArrow(run, _schema(docs))


def _score_blocks(docs: DataFrame, model: Model, text: str, group_bytes: int) -> DataFrame:
    """Groups of texts ask the blocks; answers and texts meet by group.

    The exchange by group is made once and read twice.  Rows equal in all columns are spread by the partition that they come from.
    """
    size = docs.agg(F.sum(F.octet_length(f"`{text}`")), F.count(F.lit(1))).first()
    groups = max(1, -(-int((size[0] or 0) + 64 * size[1]) // group_bytes))
    names = docs.columns
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    group = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(groups)).cast("int")
    grouped = docs.select(group.alias("__group"), *[F.col(f"`{c}`") for c in names]).repartition(groups, "__group")
    bits, scorer, at = model.block_bits, _Scorer(model), names.index(text) + 1

    def questions(table: pa.Table) -> pa.Table:
        toks, first = tokens_of(table.column(at))
        words, pairs = (np.sort(pc.unique(pa.array(x)).to_numpy()) for x in (toks, pair_keys(previous(toks, first), toks)))
        return pa.table({"__group": pa.array(np.full(1 << bits, table.column(0)[0].as_py(), np.int32)), "block": pa.array(np.arange(1 << bits, dtype=np.int32)),
                         "words": _sorted_cells(words, _block_ends(words, bits)), "pairs": _sorted_cells(_short(pairs, bits), _block_ends(pairs, bits))})

    def answers(asked: pa.Table, block: pa.Table) -> pa.Table:
        known = len(block) > 0
        words = _join(block["words"], np.uint64)
        counts = _join(block["word_counts"], np.int64)
        held = _join(block["bits"], np.uint8)
        n = [_planes(_counts_in(words, counts, _ascending(w, np.uint64))) for w in asked["words"].to_pylist()]
        found = [(_in_turn(held, short) if known else np.zeros(len(short), np.uint8)).tobytes() for short in (_ascending(p, np.uint32) for p in asked["pairs"].to_pylist())]
        return pa.table({"__group": asked["__group"], "block": asked["block"], "counts": pa.array(n, pa.binary()), "levels": pa.array(found, pa.binary())})

    def scored(rows: pa.Table, answer: pa.Table) -> pa.Table:
        answer = answer.sort_by("block")
        counts, level = _joined(answer["counts"], np.int64, _unplaned), _join(answer["levels"], np.uint8)
        # the answers are in the order of the distinct words and pairs
        found = scorer.results(*tokens_of(rows.column(at)), lambda words: counts, lambda pairs: level)
        return pa.table([*rows.columns[1:], *[pa.array(v) for v in found.values()]], names=[*names, *found])

    asked = grouped.groupBy("__group").applyInArrow(questions, "__group int, block int, words binary, pairs binary")
    told = asked.groupBy("block").cogroup(model.blocks.groupBy("block")).applyInArrow(answers, "__group int, block int, counts binary, levels binary")
    return grouped.groupBy("__group").cogroup(told.groupBy("__group")).applyInArrow(scored, _schema(docs))
