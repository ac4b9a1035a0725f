"""Secret scan: base patterns, and literals assigned to sensitive names.

A lexer (``assignments``) reads source code and configuration as name-literal pairs and carries literals on through constants,
scopes and joined values; each pair is scored by the words of its name and the shape of its literal.  Pairs that
reach ``LEAST_SCORE`` add a span of kind ``literal`` for each of their literals; the spans of the base patterns stay.

Defined results: null is the empty text; positions are code points, ends exclusive; a literal found for several
names is one span; equal rows give equal results.  Every text is read whole; names and blanks may be of any length.  The
literal of a bare value goes to the end of its run, so the literals of ``k=v&k=v`` overlap; they are held as positions and scored from
the end of the run, so the work goes with the length of a text (times the different characters of a run).  Columns of the input named like a
result are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.assignments import lexed
from stepwise.llm.textbuf import with_result

#: Fixed values of the contract: the base kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Every match of ASSIGN holds one of these in lower case.
KEYS = ("passw", "secret", "token", "api")

LITERAL = "literal"
LEAST_SCORE = 2.0
#: Words of names and how much they tell.
NAME_SCORES = {
    "password": 2, "passwd": 2, "passphrase": 2, "passcode": 2, "pwd": 2, "pass": 1.25, "pin": 1.5, "secret": 2, "secrets": 2, "token": 1.5, "jwt": 1.25, "apikey": 2, "credential": 1.5,
    "credentials": 1.5, "private": 0.75, "access": 0.5, "auth": 0.75, "authorization": 1, "api": 0.75, "client": 0.25, "key": 0.75, "signature": 0.75, "signing": 0.75, "encryption": 0.75,
    "session": 0.5, "bearer": 1, "hmac": 1, "salt": 0.75, "webhook": 0.75,
}
#: Words that make a telling name surer but don't tell alone, and words behind which a name is the same.
OWNERS = frozenset(("db", "database", "user", "admin", "root", "smtp", "ftp", "ssh", "login", "account", "mysql", "postgres", "redis", "mail"))
NEUTRAL = frozenset(("value", "string", "str", "text", "code", "data", "base", "default", "old", "new", "main", "backup", "prod", "production", "dev", "test", "staging", "live", "hex", "raw"))
#: Any name that tells enough holds one of these in lower case, any URL with a password the last one.
STEMS = ("pass", "pwd", "pin", "secret", "token", "jwt", "credential", "private", "access", "auth", "api", "key", "sign", "encryption", "session", "bearer", "hmac", "salt", "webhook", "://")
#: Counts of a joined value's characters stop here.
MOST_COUNTED = 1 << 40
#: Literals that stand for a value to be filled in; also those that start with ``your`` or are in the brackets.
PLACEHOLDER = re.compile(r"(x+|\*+|none|null|nil|true|false|changeme|example|test|todo)\Z", re.IGNORECASE)
BRACKETS = (("<", ">"), ("${", "}"), ("%", "%"))
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A bare value of letters alone is the name of something, not a literal.
_LETTERS = re.compile(r"[A-Za-z_.-]+\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def pairs(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(name, start, end, quoted) of the assignments of one literal, in order; the literal is ``text[start:end]``."""
    found = lexed(text)
    for pair in found.pairs:
        if span := found.spans[pair.node]:
            yield pair.name, *span, pair.quoted


@functools.lru_cache(1 << 14)
def name_score(name: str) -> float:
    """What a name tells: the sum over its different words, half of it if its last telling word names something else.

    ``apiKey``, ``api_key`` and ``API-KEY`` have the same words.  ``secret_santa`` and ``token_count`` are about a santa and a count.
    """
    words = [w.lower() for w in _WORD.findall(name)]
    score = sum(NAME_SCORES.get(w, 0) for w in set(words))
    if not score:
        return 0.0
    score += 0.75 * any(w in OWNERS for w in words)
    head = next((w for w in reversed(words) if not w.isdigit() and w not in NEUTRAL and w not in OWNERS), "")
    return score if head in NAME_SCORES else score / 2


def _is_filler(text: str, start: int, end: int) -> bool:
    if PLACEHOLDER.match(text, start, end) or text[start:min(end, start + 4)].lower() == "your":
        return True
    return any(end - start >= len(a) + len(b) and text.startswith(a, start, end) and text.endswith(b, start, end) for a, b in BRACKETS)


def _shape_score(counts: Counter, n: int) -> float:
    if any(c.isspace() for c in counts):
        return -2.0
    entropy = -math.fsum(k / n * math.log2(k / n) for k in counts.values())
    kinds = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), not all(c.isalnum() for c in counts)))
    return min(1.0, 0.15 * (entropy - 2) + 0.25 * (kinds - 1))


def literal_scores(text: str, starts: set[int], end: int) -> dict[int, float]:
    """Scores of the literals of one end, from -2 (a placeholder or a word) to 1 (long, mixed); each character is counted once."""
    scores, counts, at = {}, Counter(), end
    for start in sorted(starts, reverse=True):
        counts.update(text[start:at])
        at = start
        scores[start] = -2.0 if end - start < LEAST_ASSIGN or _is_filler(text, start, end) else _shape_score(counts, end - start)
    return scores


def literal_score(literal: str) -> float:
    return literal_scores(literal, {0}, len(literal))[0]


def _joined_score(counts: Counter) -> float:
    n = sum(counts.values())
    return -2.0 if n < LEAST_ASSIGN else _shape_score(counts, n)


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Literals that belong to a sensitive name, directly or through constants; all literals of a joined value."""
    low = text.lower()
    if not any(w in low for w in STEMS):
        return set()
    found = lexed(text)
    spans, parts, later = found.spans, found.parts, found.later
    final: dict[int, int] = {}
    names: dict[int, float] = {}
    for pair in found.pairs:
        score = name_score(pair.name)
        if score + 1 < LEAST_SCORE:  # a literal adds 1 at most
            continue
        node, way = pair.node, {}
        while node not in final and node not in way and later.get(node, node) != node:
            way[node] = None
            node = later[node]
        node = final.get(node, node)
        final.update(dict.fromkeys(way, node))
        if pair.quoted or node != pair.node or not _LETTERS.match(text, *spans[node]):
            names[node] = max(score, names.get(node, 0))
    starts = defaultdict(set)
    for node in names:
        if spans[node]:
            starts[spans[node][1]].add(spans[node][0])
    scores = {(start, end): x for end, use in starts.items() for start, x in literal_scores(text, use, end).items()}
    chosen = [n for n, score in names.items() if spans[n] and score + scores[spans[n]] >= LEAST_SCORE]
    counts: dict[int, Counter] = {}
    for node in sorted(_below(parts, [n for n in names if n in parts])):  # parts come before what is made of them
        if node in parts:
            total = Counter()
            for part in parts[node]:
                total.update(counts[part])
            counts[node] = Counter({c: min(k, MOST_COUNTED) for c, k in total.items()})
            if node in names and names[node] + _joined_score(counts[node]) >= LEAST_SCORE:
                chosen.append(node)
        else:
            counts[node] = Counter(text[slice(*spans[node])])
    return {spans[n] for n in _below(parts, chosen) if spans[n]}


def _below(parts: dict[int, tuple[int, ...]], nodes: list[int]) -> set[int]:
    """The nodes and all that they are made of."""
    seen, todo = set(nodes), list(nodes)
    while todo:
        for part in parts.get(todo.pop(), ()):
            if part not in seen:
                seen.add(part)
                todo.append(part)
    return seen


def joined(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row without its text, with n_assign, n_access, n_hex, base_sha256 and spans."""
    names = (*KINDS, LITERAL)

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def scanned(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text_ = t.as_py() or ""
            base = base_spans(text_)
            n = Counter(k for _, k, _ in base)
            more = [(a, len(KINDS), b) for a, b in literal_spans(text_)]
            rows.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(joined(base, names).encode()).hexdigest(), "spans": joined(base + more, names)})
        return pa.array(rows, pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]))

    found = docs.withColumn("__s", scanned(F.col(text))).drop(text)
    return with_result(found, **{c: F.col(f"__s.{c}") for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}).drop("__s")
