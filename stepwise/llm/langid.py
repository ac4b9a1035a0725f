"""Language identification by multilingual mixture inference.

Model: for each learned language a smoothed distribution over hashed byte
trigrams of letters, counted over all labelled training rows.

Inference: a text is a bag of words, each drawn from one language of an
unknown mixture; a word's likelihood under a language is the product of its
trigram likelihoods.  Expectation-maximisation estimates the proportions, and
the language set is the prefix of the languages (by proportion) whose
likelihood, penalised by half the log of the number of words per language,
is the best.  A flat background distribution takes part in the
mixture so that words like no learned language lower the score.

Defined results: a null text, one without any letter, and any text when
nothing was learned give ``und`` with score 0.  Ties go to the language first
by code point.  Texts are read whole.  Columns of the input named like a result
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.textbuf import SLICE_BYTES, bound_batches, rows_of, slices, with_result

UNDETERMINED = "und"
#: Hashed trigram slots.
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
SMOOTHING = 0.5
EM_ROUNDS = 8
#: A document is rejected when words like no learned language make up more than this share.
MAX_OTHER = 0.5

_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letter bytes, their trigram slots, and the starts of words among them."""
    low = _LETTER[data]
    if len(low) > 1:  # capitals of Latin-1 letters: C3 80..9E but for the sign 97
        cap = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][cap] += 0x20
    n = len(low)
    prev = np.zeros(n, np.uint32)
    prev[1:] = low[:-1]
    nxt = np.zeros(n, np.uint32)
    nxt[:-1] = low[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    prev[inner] = 0
    nxt[inner - 1] = 0
    at = np.flatnonzero(low)
    code = (prev[at] << np.uint32(16)) | (low[at].astype(np.uint32) << np.uint32(8)) | nxt[at]
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return at, slot, np.flatnonzero(prev[at] == 0)


@dataclass(frozen=True)
class LanguageModel:
    """Languages by code point and their log probabilities, slots by languages (the last one is the background)."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts trigram slots by language over all rows with a text and a language.

    Every task sends one row per language and used slot; the driver gets at
    most 65,536 rows per language, whatever the input's size.
    """
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for lo, hi, data, bounds in slices(b.column(0)):
                at, slot, _ = _grams(data, bounds)
                names, code = np.unique(np.array(langs[lo:hi], dtype=object), return_inverse=True)
                cells = code[rows_of(at, bounds)] * SLOTS + slot
                found = np.bincount(cells, minlength=len(names) * SLOTS).reshape(len(names), SLOTS)
                for name, n in zip(names, found, strict=True):
                    seen[name] = seen.get(name, 0) + n
        for k, acc in seen.items():
            used = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(acc[used], pa.int64())], names=["lang", "slot", "n"])

    bound_batches(labelled.sparkSession)
    used = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = used.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    log_p = np.full((SLOTS, len(languages) + 1), -np.log(SLOTS), dtype=np.float32)
    for j, name in enumerate(languages):
        c = np.zeros(SLOTS)
        rows = counts[counts["lang"] == name]
        c[rows["slot"].to_numpy()] = rows["n"].to_numpy()
        log_p[:, j] = np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * SLOTS))
    return LanguageModel(languages, log_p)


def _mixture(lik: np.ndarray, weight: np.ndarray, first: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document, with only its allowed languages."""
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(weight, first)[:, None]
    for _ in range(EM_ROUNDS):
        part = lik * theta[owner]
        part *= (weight / part.sum(axis=1))[:, None]
        theta = np.add.reduceat(part, first, axis=0) / total
    mix = np.log((lik * theta[owner]).sum(axis=1))
    return theta, np.add.reduceat(mix, first)


def infer(data: np.ndarray, bounds: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Shares of the languages and the background, one row per text; all zero where a text has no letter byte."""
    n, k = len(bounds) - 1, len(model.languages)
    shares = np.zeros((n, k + 1))
    at, slot, word = _grams(data, bounds)
    if not len(at) or not k:
        return shares
    ll = np.add.reduceat(model.log_p[slot], word, axis=0)
    weight = np.diff(np.append(word, len(at))).astype(np.float64)
    owner = rows_of(at[word], bounds)
    docs, first, owner = np.unique(owner, return_index=True, return_inverse=True)
    top = ll.max(axis=1, keepdims=True)
    lik = np.maximum(np.exp(ll - top), 1e-30).astype(np.float64)
    words = np.diff(np.append(first, len(word)))
    everything = np.ones((len(docs), k + 1))
    theta, _ = _mixture(lik, weight, first, owner, everything)
    order = np.argsort(-theta[:, :k], axis=1, kind="stable")
    best, result = np.full(len(docs), -np.inf), np.zeros_like(theta)
    live = np.arange(len(docs))
    for size in range(1, k + 1):
        allowed = np.zeros((len(docs), k + 1))
        allowed[:, k] = 1
        np.put_along_axis(allowed, order[:, :size], 1, axis=1)
        mine = np.isin(owner, live) if len(live) < len(docs) else slice(None)
        o = np.searchsorted(live, owner[mine])
        f = np.flatnonzero(np.diff(o, prepend=-1))
        th, fit = _mixture(lik[mine], weight[mine], f, o, allowed[live])
        fit -= 0.5 * size * np.log(words[live] + 1)
        better = fit > best[live]
        best[live[better]] = fit[better]
        result[live[better]] = th[better]
        live = live[better]
        if not len(live):
            break
    shares[docs] = result
    return shares


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the share of the predicted language) and ``other_share`` to every row."""
    bound_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    step = max(1 << 16, 4 * SLICE_BYTES // (len(model.languages) + 1))

    @F.arrow_udf("struct<lang_pred:string,score:double,other_share:double>")
    def identify(texts: pa.Array) -> pa.Array:
        m = handle.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        pred, score, other = [], [], []
        for lo, hi, data, bounds in slices(texts, step):
            shares = infer(data, bounds, m)
            ascii_letter = (data < 0x80) & (_LETTER[data] > 0)
            plain = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[bounds]) > 0
            known = plain & (len(m.languages) > 0)
            for i in np.flatnonzero(~plain & (shares.sum(axis=1) > 0)):
                known[i] = any(ch.isalpha() for ch in texts[lo + int(i)].as_py() or "")
            best = shares[:, :-1].argmax(axis=1) if len(m.languages) else np.zeros(hi - lo, int)
            pred.extend(names[np.where(known, best, len(m.languages))])
            score.append(np.where(known, np.clip(shares[np.arange(hi - lo), best], 0, 1), 0.0))
            other.append(np.where(known, np.clip(shares[:, -1], 0, 1), 1.0))
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (score, other)]
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(flat[0], pa.float64()), pa.array(flat[1], pa.float64())], names=["lang_pred", "score", "other_share"])

    found = docs.withColumn("__lid", identify(F.col(text)))
    out = with_result(found, lang_pred=F.col("__lid.lang_pred"), score=F.col("__lid.score"), other_share=F.col("__lid.other_share"))
    return out.drop("__lid")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text is 2 modulo 4 (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(predicted: DataFrame) -> F.Column:
    """The filter of the pipeline: a language was found and most words belong to learned languages."""
    return (predicted["lang_pred"] != UNDETERMINED) & (predicted["other_share"] <= MAX_OTHER)
