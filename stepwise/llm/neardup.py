"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

A text is a weighted set of its shingles of five white-space words (a shorter
text is one shingle).  A shingle weighs its count in the text times the mean
inverse document frequency of its words; document frequencies are counted over
all documents in a fixed number of hashed slots, so the table stays
bounded and is the same for every text.  (The frequencies of whole shingles
would need two shuffles of every shingle, and would give the shingles of a large
group of near copies almost no weight.)

Sampling: 100 consistent weighted samples per text; two texts agree on one with
a probability equal to their weighted Jaccard similarity.  Banding: 20 bands of 5
samples, no sample in two; a pair shares no band with probability 0.036 % at similarity 0.80, 0.001 % at 0.85.  Pairs of a bucket whose samples agree too little for the threshold are put aside, all others are
verified by the exact weighted Jaccard similarity of the two sets.  First every text of a bucket is paired with a few
leaders (the text with the largest buckets, and minima of salted hashes; one constant-size aggregate), which
puts most groups in one class.  Then, in every bucket whose texts are still in several classes, all texts meet all
texts of the other classes: a large bucket is cut into blocks, and each two blocks are a cell of bounded bytes.  So every pair
that shares a band is compared or held by one class; the work of a bucket grows with the square of its texts only while they are of
several classes.  A link can be missed only if its texts share no band, or agree in fewer than ``LEAST_AGREED`` samples.

Defined results: null is the empty text; equal texts are always one class; texts
without words are near copies of nothing else.  The class id is the smallest doc_id
of the class (null only if all are).  Repeated rows are in one class.  Columns of the
input named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from stepwise.llm.textbuf import NOT_SPACE, bound_batches, broadcast_if_small, mix64, rows_of, runs, slices, stored, with_result, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_SAMPLES = 20, 5
SAMPLES = BANDS * BAND_SAMPLES
#: Leaders that a bucket's texts are compared with before all others.
LEADERS = 4
#: Bytes of a block of a large bucket, and of the small buckets that are put together.
BLOCK_BYTES, PACK_BYTES = 2 << 20, 64 << 10
#: Pairs with fewer agreeing samples are not verified: five standard deviations below the threshold.
LEAST_AGREED = int(SAMPLES * SIMILARITY - 5 * (SAMPLES * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Hashed slots of the document frequencies.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS

_U = np.uint64
_STEP = mix64(np.arange(101, 101 + SHINGLE_WORDS, dtype=np.uint64)) | _U(1)
_SEEDS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | _U(1)


def _gamma2() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) distribution, 1 - (1 + x) exp(-x) = p, by Newton steps."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.where(p < 0.1, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return x.astype(np.float32)


_GAMMA = _gamma2()
_LN_GAMMA = np.log(_GAMMA)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - SLOT_BITS)).astype(np.int64)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    starts, ends = runs(NOT_SPACE[data], bounds)
    return word_hashes(data, starts, ends), rows_of(starts, bounds)


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Smoothed inverse document frequency of each word slot, from 1 to 2, over all rows.

    Every task sends its used slots; the driver gets at most 262,144 rows.
    """
    def count(batches):
        seen, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for lo, hi, data, bounds in slices(b.column(0)):
                hashes, row = _words(data, bounds)
                cells = np.unique(row * SLOTS + _slot(hashes))
                seen += np.bincount(cells % SLOTS, minlength=SLOTS)
                n += hi - lo
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(seen[used], n), pa.int64())], names=["slot", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS + 1)
    df[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    n = max(df[-1], 1.0)
    return (1 + np.log((1 + n) / (1 + df[:-1])) / np.log1p(n)).astype(np.float32)


def shingles(data: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles, sorted by row and hash."""
    words, row = _words(data, bounds)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    size = np.bincount(row, minlength=len(bounds) - 1)
    left = size[row] - (np.arange(len(row)) - np.searchsorted(row, row))
    at = np.flatnonzero((left >= SHINGLE_WORDS) | ((left == size[row]) & (left < SHINGLE_WORDS)))
    span = np.minimum(left[at], SHINGLE_WORDS)
    code, rarity = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32)
    value = idf[_slot(words)]
    for j in range(SHINGLE_WORDS):
        has = span > j
        i = np.minimum(at + j, len(words) - 1)
        code += np.where(has, words[i] * _STEP[j], _U(0))
        rarity += np.where(has, value[i], np.float32(0))
    code, rarity, row = mix64(code), rarity / span, row[at]
    order = np.lexsort((code, row))
    code, rarity, row = code[order], rarity[order], row[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(first, len(code)))
    return row[first], code[first], (rarity[first] * count).astype(np.float32)


def samples(row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and their consistent weighted samples (rows by SAMPLES)."""
    docs, first = np.unique(row, return_index=True)
    out = np.empty((len(docs), SAMPLES), np.uint64)
    ln_w = np.log(weight)
    place = np.arange(len(code), dtype=np.int64)
    for k in range(SAMPLES):
        z = code * _SEEDS[k]
        z ^= z >> _U(32)
        z *= _U(0xD6E8FEB86659FD93)
        r = _GAMMA[z >> _U(48)]
        beta = ((z >> _U(16)) & _U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(ln_w / r + beta)
        ln_a = _LN_GAMMA[(z >> _U(32)) & _U(0xFFFF)] - r * (t - beta + 1)
        bits = ln_a.view(np.int32)
        key = ((bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | place
        best = np.minimum.reduceat(key, first) & 0xFFFFFFFF
        out[:, k] = mix64(code[best] ^ (t[best].astype(np.int64).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    return docs, out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band: a hash of its own five samples and of the band's number."""
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        use = slice(b * BAND_SAMPLES, (b + 1) * BAND_SAMPLES)
        keys[:, b] = mix64((sig[:, use] * _STEP[:BAND_SAMPLES]).sum(axis=1, dtype=np.uint64) + _U(b + 1))
    return keys


def _signature_udf(handle):
    @F.arrow_udf("struct<sig:binary,bands:array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        sigs, bands = [None] * len(texts), [None] * len(texts)
        for lo, _, data, bounds in slices(texts):
            row, code, weight = shingles(data, bounds, handle.value)
            if not len(row):
                continue
            docs, sig = samples(row, code, weight)
            keys = band_keys(sig).view(np.int64)
            low = (sig & _U(0xFF)).astype(np.uint8)
            for i, d in enumerate(docs):
                sigs[lo + d], bands[lo + d] = low[i].tobytes(), keys[i]
        return pa.StructArray.from_arrays([pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["sig", "bands"])

    return sign


def _vector_udf(handle):
    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        """Hashes, then weights of the text's shingles."""
        out = []
        for lo, hi, data, bounds in slices(texts):
            row, code, weight = shingles(data, bounds, handle.value)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            out.extend(code[a:b].tobytes() + weight[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True))
        return pa.array(out, pa.binary())

    return vector


def _parts(vec: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vec) // 12
    return np.frombuffer(vec, np.uint64, n), np.frombuffer(vec, np.float32, n, 8 * n)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    (ca, wa), (cb, wb) = _parts(a), _parts(b)
    _, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64))
    return both / max(float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both, 1e-30)


@F.arrow_udf(DoubleType())
def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([weighted_jaccard(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())


@F.arrow_udf(IntegerType())
def _agreed(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([int((np.frombuffer(x.as_py(), np.uint8) == np.frombuffer(y.as_py(), np.uint8)).sum()) for x, y in zip(a, b, strict=True)], pa.int32())


def text_id(text: Column) -> Column:
    """128 bits that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): every text of a bucket (tid, key, score) with the bucket's leaders; each pair once.

    The first leader is the text whose buckets are the largest: the original of a group of near
    copies shares more buckets than any copy.  The others are minima of salted hashes.
    """
    leader = [F.max(F.struct("score", "tid"))["tid"].alias("l0")]
    leader += [F.min(F.struct(F.xxhash64("tid", F.lit(i)).alias("h"), "tid"))["tid"].alias(f"l{i}") for i in range(1, LEADERS)]
    heads = buckets.groupBy("key").agg(*leader).select("key", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("heads"))
    met = buckets.select("tid", "key").join(stored(heads, "leaders"), "key").select("tid", F.explode("heads").alias("head")).where("tid != head")
    return met.select(F.least("tid", "head").alias("a"), F.greatest("tid", "head").alias("b")).distinct()


def _shared(texts: DataFrame) -> DataFrame:
    """Stored (tid, key, score): the buckets of two texts or more; the score of a text is the sum of its buckets' sizes."""
    buckets = texts.select("tid", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(buckets.join(stored(sizes, "sizes"), "key"), "shared")
    return stored(shared.select("tid", "key").join(shared.groupBy("tid").agg(F.sum("n").alias("score")), "tid"), "scored")


def _cells(members: DataFrame):
    """Groups of rows of (key, tid, ...) in which any two texts of a bucket meet once.

    A bucket of more than ``BLOCK_BYTES`` is dealt into blocks by hash, and each two blocks (i, j) are a cell;
    other buckets are one cell each, small ones together in packs.
    """
    size = sum((F.octet_length(c) for c in ("tid", "root", "sig", "vec") if c in members.columns), F.lit(8 * BANDS + 8))
    sizes = stored(members.groupBy("key").agg(F.sum(size).alias("bytes")), "sizes")
    packs = max(1, (sizes.agg(F.sum("bytes")).first()[0] or 0) // PACK_BYTES)
    blocks = sizes.select("key", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"), F.when(F.col("bytes") > PACK_BYTES, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(packs))).alias("pack"))
    dealt = members.join(broadcast_if_small(blocks, 24), "key").withColumn("block", F.pmod(F.xxhash64("tid"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other").groupBy("pack", "i", "j")


def _meetings(cell: pa.Table, root: np.ndarray):
    """(p, qs): a row of a cell sorted by key, and later rows of its bucket to verify with it.

    Those are of another class (``root`` may change between the steps) and agree in enough samples; a pair is met in the first band that it shares.
    """
    key, block = cell["key"].to_numpy(), cell["block"].to_numpy()
    sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(len(key), -1)
    bands = pc.list_flatten(cell["bands"]).to_numpy().reshape(len(key), -1)
    across = cell["i"][0].as_py() != cell["j"][0].as_py()
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        for p in range(lo, hi - 1):
            q = np.arange(p + 1, hi)
            q = q[(root[q] != root[p]) & ((block[q] != block[p]) | (not across))]
            q = q[(sig[q] == sig[p]).sum(axis=1) >= LEAST_AGREED]
            if len(q):
                q = q[bands[p][(bands[q] == bands[p]).argmax(axis=1)] == key[p]]
            if len(q):
                yield p, q


def _sorted_cell(cell: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows by key, and a number for each one's root."""
    cell = cell.sort_by("key").combine_chunks()
    return cell, np.unique(np.array(cell["root"].to_pylist(), dtype="S16"), return_inverse=True)[1]


def _hits(cell: pa.Table) -> pa.Table:
    """(key, tid) of the texts that have a pair to verify."""
    cell, root = _sorted_cell(cell)
    use = np.zeros(len(cell), bool)
    for p, q in _meetings(cell, root):
        use[p] = use[q] = True
    return cell.select(["key", "tid"]).filter(pa.array(use))


def _cell_links(similarity: float):
    def link(cell: pa.Table) -> pa.Table:
        """(a, b) of verified pairs that join the classes of a cell; a pair that others have joined before is left out."""
        cell, root = _sorted_cell(cell)
        parts = [_parts(v) for v in cell["vec"].to_pylist()]
        size = np.array([len(c) for c, _ in parts])
        first = np.cumsum(size) - size
        place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)[1]
        weight = np.concatenate([w for _, w in parts])
        whole = np.array([w.sum(dtype=np.float64) for _, w in parts])
        mine = np.zeros(len(place), np.float32)
        left, right = [], []
        for p, q in _meetings(cell, root):
            own = slice(first[p], first[p] + size[p])
            mine[place[own]] = weight[own]
            start = np.cumsum(size[q]) - size[q]
            at = np.arange(size[q].sum()) + np.repeat(first[q] - start, size[q])
            both = np.add.reduceat(np.minimum(mine[place[at]], weight[at]).astype(np.float64), start)
            mine[place[own]] = 0
            for x in q[both / np.maximum(whole[p] + whole[q] - both, 1e-30) >= similarity]:
                if root[x] != root[p]:
                    left.append(p)
                    right.append(x)
                    root[root == root[x]] = root[p]
        return pa.table({"a": cell["tid"].take(pa.array(left, pa.int64())), "b": cell["tid"].take(pa.array(right, pa.int64()))})

    return link


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): the smallest id that it is connected with.

    Each round hooks every node to its smallest neighbour, follows the
    hooks to their ends, and contracts the graph; rounds go with the logarithm of the nodes.
    """
    total = None
    while True:
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        hook = stored(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("root")), "hooks")
        while True:
            nxt = hook.alias("x").join(hook.alias("y"), F.col("x.root") == F.col("y.id")).select("x.id", F.col("y.root").alias("root"), (F.col("x.root") != F.col("y.root")).alias("moved"))
            nxt = stored(nxt, "hooks")
            hook = nxt.select("id", "root")
            if nxt.where("moved").isEmpty():
                break
        if total is None:
            total = hook
        else:
            step = hook.select(F.col("id").alias("root"), F.col("root").alias("new"))
            total = stored(total.join(step, "root", "left").select("id", F.coalesce("new", "root").alias("root")), "roots")
        left, right = hook.select(F.col("id").alias("a"), F.col("root").alias("ra")), hook.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        links = stored(links.join(left, "a").join(right, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return total


def near_links(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame | None]:
    """Stored rows (all columns but the text, with ``__tid``), and (id, root) of linked texts or None."""
    spark = docs.sparkSession
    bound_batches(spark)
    handle = spark.sparkContext.broadcast(document_frequencies(docs, text))
    rows = docs.withColumn("__tid", text_id(F.col(text))).withColumn("__s", _signature_udf(handle)(F.col(text)))
    rows = stored(rows.drop(text).withColumn("__sig", F.col("__s.sig")).withColumn("__bands", F.col("__s.bands")).drop("__s"), "signed")
    texts = rows.where(F.col("__sig").isNotNull()).select(F.col("__tid").alias("tid"), F.col("__sig").alias("sig"), F.col("__bands").alias("bands")).dropDuplicates(["tid"])
    texts = stored(texts, "texts")
    buckets, sigs = _shared(texts), texts.select("tid", "sig")
    pairs = _pairs(buckets)
    pairs = pairs.join(sigs.select(F.col("tid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("tid").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = stored(pairs.where(_agreed("sa", "sb") >= LEAST_AGREED).select("a", "b"), "pairs")

    def vectors(ids: DataFrame) -> DataFrame:
        need = stored(ids.distinct(), "needed")
        texts_of = docs.select(text_id(F.col(text)).alias("tid"), F.col(text).alias("text")).join(broadcast_if_small(need, 48), "tid", "left_semi").dropDuplicates(["tid"])
        return stored(texts_of.select("tid", _vector_udf(handle)("text").alias("vec")), "vectors")

    roots = None
    if not pairs.isEmpty():
        vecs = vectors(pairs.select(F.explode(F.array("a", "b")).alias("tid")))
        joined = pairs.join(vecs.select(F.col("tid").alias("a"), F.col("vec").alias("va")), "a").join(vecs.select(F.col("tid").alias("b"), F.col("vec").alias("vb")), "b")
        links = stored(joined.withColumn("s", _similarity("va", "vb")).where(F.col("s") >= similarity).select("a", "b"), "near")
        roots = None if links.isEmpty() else components(links)
    named = buckets.select("tid", "key")
    if roots is None:
        named = named.withColumn("root", F.col("tid"))
    else:
        named = stored(named.join(roots.withColumnRenamed("id", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid")), "rooted")
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    members = named.join(stored(mixed, "mixed"), "key", "left_semi").join(texts, "tid")
    members = stored(members.select("key", "tid", "root", "sig", "bands"), "members")
    meant = stored(_cells(members).applyInArrow(_hits, "key long, tid binary").distinct(), "meant")
    if meant.isEmpty():
        return rows, roots
    members = members.join(meant, ["key", "tid"], "left_semi").join(vectors(meant.select("tid")), "tid")
    links = stored(_cells(stored(members, "weighed")).applyInArrow(_cell_links(similarity), "a binary, b binary").distinct(), "near")
    return rows, roots if links.isEmpty() else _merged(roots, links)


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, root) after more links; only the graph of the classes is searched."""
    if roots is None:
        return components(links)
    a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b").distinct()
    step = components(stored(lifted, "lifted"))
    old = roots.join(step.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return stored(old.unionByName(step.join(roots, "id", "left_anti")), "roots")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every row without its text, with class_id, class_size and is_kept (true for one row id of each class).

    ``is_kept`` marks the rows of the smallest doc_id whose text is the first of the class
    with that doc_id; only fully repeated rows share it.
    """
    rows, roots = near_links(docs, text, similarity)
    if roots is not None:
        named = rows.join(broadcast_if_small(roots.withColumnRenamed("id", "__tid").withColumnRenamed("root", "__root"), 64), "__tid", "left").withColumn("__root", F.coalesce("__root", "__tid"))
    else:
        named = rows.withColumn("__root", F.col("__tid"))
    named = stored(named.drop("__sig", "__bands"), "named")
    heads = named.groupBy("__root").agg(F.min(F.struct(F.col(doc_id).isNull().alias("no"), F.col(doc_id).alias("id"), F.col("__tid").alias("tid"))).alias("__head"), F.count("*").alias("__n")).where("__n > 1")
    out = named.join(broadcast_if_small(stored(heads, "heads"), 96), "__root", "left")
    single = F.col("__n").isNull()
    head = F.col("__head")
    return with_result(
        out, class_id=F.when(single, F.col(doc_id)).otherwise(head["id"]), class_size=F.coalesce("__n", F.lit(1)).cast("long"),
        is_kept=single | (F.col(doc_id).eqNullSafe(head["id"]) & (F.col("__tid") == head["tid"])),
    ).drop("__root", "__head", "__n")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``."""
    found = classes(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id")
    found = stored(found.where("class_size > 1").groupBy("id", "__tid").agg(F.first("is_kept").alias("keep"), F.count("*").alias("n")), "decisions")
    gone = found.where("not keep").select(F.col("id").alias("__id"), F.col("__tid").alias("__t"))
    again = found.where("keep and n > 1").select(F.col("id").alias("__id"), F.col("__tid").alias("__t"))
    keyed = docs.withColumn("__tid", text_id(F.col(text)))

    def same():
        return F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__tid") == F.col("__t"))

    left = keyed.join(broadcast_if_small(gone, 64), same(), "left_anti")
    if not again.isEmpty():  # of fully repeated rows the first stays
        again = broadcast_if_small(again, 64)
        left = left.join(again, same(), "left_anti").unionByName(keyed.join(again, same(), "left_semi").dropDuplicates(["__tid"]))
    return left.drop("__tid")
