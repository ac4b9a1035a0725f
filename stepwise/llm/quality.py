"""Quality rules with host-level verdicts.

Each text is measured once, as a byte buffer; the measures are stored, a row of
numbers per document.  The failures of each rule are summed by host; for each rule a beta prior is fitted to the rates of all
hosts (method of moments) and shrinks them.  A host of which one shrunk rate
is above ``MAX_RATE`` loses all its documents.  Documents that fail the base rule go themselves.
Equal lines and windows are found by 64-bit hashes.

Defined results: null and empty texts have no words and fail; a null host is a host of its own; a single
host is its own prior; equal rows count each; empty tables give no rows.  Columns of the input named like a
result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.textbuf import NOT_SPACE, broadcast_if_small, byte_table, mix64, per_row, rows_of, runs, slices, stored, with_result, word_hashes

LEAST_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WORDS = 3
#: Further rules, which count only towards the host's rates: symbols by word, repeated lines by words.
MAX_SYMBOLS_A_WORD, MAX_DUP_LINES_A_WORD = 0.5, 0.1
#: A host with a larger shrunk rate of failing documents is rejected.
MAX_RATE = 0.5
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6

#: The rules, each with a rate of its own for every host; the first two are the base rule.
RULES = ("short", "repeats", "symbols", "lines")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = byte_table(b"#*$%&|<>")
#: First bytes of code points inside words.
_CHAR = NOT_SPACE & ~byte_table(range(0x80, 0xC0))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _again(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, whether its row has the code at another entry, and whether it is the first of its equals."""
    if not len(row):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((code, row))
    r, c = row[order], code[order]
    new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))
    alone = new & np.append(new[1:], True)
    repeated, first = np.empty(len(row), bool), np.empty(len(row), bool)
    repeated[order], first[order] = ~alone, new
    return repeated, first


def measure(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The five measures of each row."""
    n = len(bounds) - 1
    starts, ends = runs(NOT_SPACE[data], bounds)
    row = rows_of(starts, bounds)
    words = word_hashes(data, starts, ends)
    left, right = runs(data != 0x0A, bounds)
    spoken = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    said = spoken[right] > spoken[left]
    left, right = left[said], right[said]
    line_row = rows_of(left, bounds)
    _, first = _again(line_row, word_hashes(data, left, right))
    dup_lines = per_row(line_row, n) - per_row(line_row[first], n)
    inside = np.zeros(len(words), bool)
    if len(words) >= REPEAT_WORDS:
        last = len(words) - REPEAT_WORDS + 1
        whole = np.flatnonzero(row[:last] == row[REPEAT_WORDS - 1:])
        code = np.zeros(len(whole), np.uint64)
        for j in range(REPEAT_WORDS):
            code = mix64(code + words[whole + j])
        repeated, _ = _again(row[whole], code)
        for j in range(REPEAT_WORDS):
            inside[whole[repeated] + j] = True
    return per_row(row, n), _sums(_CHAR[data], bounds), _sums(_SYMBOL[data], bounds), dup_lines, per_row(row[inside], n)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stored: every row without its text, with the measures and ``base_failed``."""
    @F.arrow_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        parts = [measure(data, bounds) for _, _, data, bounds in slices(texts)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(MEASURES))

    found = docs.withColumn("__m", measured(F.col(text))).drop(text)
    m = {k: F.col(f"__m.{k}") for k in MEASURES}
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return stored(with_result(found, **m, base_failed=failed).drop("__m"), "measures")


def failures() -> dict[str, Column]:
    """Whether a measured row fails each rule."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS, "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_A_WORD * n, "lines": F.col("n_dup_lines") > MAX_DUP_LINES_A_WORD * n,
    }


def prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """(mean, strength) of the beta prior of one rule, from sums over all hosts: documents, failures, hosts, n * rate^2."""
    mean = failed / n if n else 0.0
    inside = mean * (1 - mean)
    between = squares / n - mean**2 - inside * hosts / n if n else 0.0
    strength = MOST_STRENGTH if between <= 0 else inside / between - 1
    return mean, min(MOST_STRENGTH, max(LEAST_STRENGTH, strength))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, n, failed_<rule>, shrunk_<rule>, shrunk): one row per host; ``shrunk`` is the largest of its shrunk rates."""
    bad = failures()
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *[F.sum(bad[r].cast("long")).alias(f"failed_{r}") for r in RULES])
    hosts = stored(hosts, "hosts")
    sums = [F.struct(F.sum(f"failed_{r}").alias("k"), F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("n")).alias("q")).alias(r) for r in RULES]
    s = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("h"), *sums).first()
    for r in RULES:
        mean, strength = prior(s["n"] or 0, s[r]["k"] or 0, s["h"], s[r]["q"] or 0.0)
        hosts = hosts.withColumn(f"shrunk_{r}", (F.col(f"failed_{r}") + mean * strength) / (F.col("n") + strength))
    return hosts.withColumn("shrunk", F.greatest(*[F.col(f"shrunk_{r}") for r in RULES]))


def judge(docs: DataFrame, host: str, text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """Every row without its text, with the measures, base_failed, host_rate and kept."""
    found = measures(docs, text)
    hosts = host_rates(found, host)
    hosts = hosts.select(F.col("host").alias("__host"), F.col("shrunk").alias("__rate"))
    out = found.join(broadcast_if_small(hosts, 128), F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left")
    return with_result(out, host_rate=F.col("__rate"), kept=~F.col("base_failed") & (F.col("__rate") <= max_rate)).drop("__host", "__rate")


#: DuckDB SQL of ``judge`` on documents by source; the measures, the priors by moments and the verdicts.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {REPEAT_WORDS})) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN inside ON w.r = inside.r),
f AS (SELECT *, n_words < {LEAST_WORDS} AS short, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeats,
  n_symbols > {MAX_SYMBOLS_A_WORD} * n_words AS symbols, n_dup_lines > {MAX_DUP_LINES_A_WORD} * n_words AS lines FROM m),
h AS (SELECT source, count(*) AS n, [count(*) FILTER (short), count(*) FILTER (repeats), count(*) FILTER (symbols), count(*) FILTER (lines)] AS k FROM f GROUP BY source),
u AS (SELECT source, n, rule, k[rule] AS k FROM h, (SELECT unnest(range(1, {len(RULES) + 1})) AS rule)),
s AS (SELECT rule, sum(k) / sum(n) AS mean, (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS within, sum(CAST(k AS DOUBLE) * k / n) / sum(n) AS q, count(*) / sum(n) AS hosts FROM u GROUP BY rule),
p AS (SELECT rule, mean, CASE WHEN q - mean * mean - within * hosts <= 0 THEN {MOST_STRENGTH}
  ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, within / (q - mean * mean - within * hosts) - 1)) END AS strength FROM s),
v AS (SELECT source, max((k + mean * strength) / (n + strength)) AS host_rate FROM u JOIN p ON u.rule = p.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, host_rate,
  NOT (short OR repeats) AND host_rate <= {MAX_RATE} AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
