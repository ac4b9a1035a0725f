"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Candidates are the spans of the base patterns and of looser ones (numbers written like phones or identity
numbers, street addresses, and capitalised names).  Regex, gazetteer and context labelers vote for, against or not at all on
each.  The gazetteer of names is learned: words that follow titles and salutations are counted over the whole corpus in
``SLOTS`` hashed slots, and a word is a name if enough of its occurrences are such.  The votes of all candidates are counted by kind and pattern
of votes; on these counts expectation-maximisation estimates each labeler's reliability for each kind and the probability of every pattern, and
a logistic classifier of kind, votes and shape is trained on the result.  Base spans stay; a looser
candidate is added if the classifier gives it at least ``LEAST_PROBABILITY``.

Candidates are stored with their votes, a few bytes each; the counts that reach the driver are bounded by the
slots, kinds, votes and shapes, not by the corpus.

Defined results: null is the empty text; positions are code points, ends exclusive; without candidates nothing is
trained and nothing added; equal rows give equal results.  Every text is read whole.  Columns of the
input named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.textbuf import stored, with_result

#: Fixed values of the contract: the base kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser kinds, only found by the method.
MORE = ("number", "address", "name")
NUMBER = re.compile(r"(?<![0-9+@.\w])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9\w])")
ADDRESS = re.compile(r"(?<![\w.-])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq)\b")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof")
TITLED = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?|\b(?!(?:Dear|Contact|Signed|Call)\x20)[A-Z][a-z]{2,}\x20[A-Z][a-z]{2,}\b")
#: First names known without a corpus.
GAZETTEER = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Laura Hans Klaus Maria Jose Carlos Pierre Marie Jean Sophie Juan Ana".split())
#: Words right before a name that hardly stand before anything else.
BEFORE_NAME = re.compile(r"(?:\b[Dd]ear|\bname is|\bname:|\b[Ss]igned,?|\b[Ss]incerely,?|\b[Rr]egards,?|\bcalled|\bI am)\s{1,2}\Z")
CONTEXT = {
    "email": ("mail", "contact", "write to"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "mastercard", "payment", "credit", "account"),
    "phone": ("call", "phone", "tel", "telephone", "mobile", "fax", "contact"), "number": ("call", "phone", "tel", "telephone", "mobile", "cell", "fax", "ssn", "social security", "passport", "reach", "text"),
    "address": ("address", "live", "lives", "living", "live at", "home", "resides", "ship to", "mail to", "moved to", "deliver to"), "name": ("name", "contact", "dear", "signed", "born", "patient", "customer", "employee", "spoke", "met", "ask for"),
}
AGAINST = ("version", "release", "isbn", "figure", "section", "chapter", "page", "pages", "price", "total", "score", "rows", "code", "model", "in", "visit", "visited", "city", "the")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "against", "isolated")
CONTEXT_CHARS = 40
#: Hashed counts of capitalised words; a word is a name from so many occurrences behind titles and such a part of all.
SLOTS, LEAST_NAMED, LEAST_NAMED_PART = 1 << 18, 2, 0.15
#: Occurrences without any behind a title that speak against a name.
MOST_UNNAMED = 5
EM_ROUNDS, FIT_ROUNDS = 50, 200
LEAST_PROBABILITY = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        free = at + 1
        if m:
            out.append((left, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if _ip(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end): the base spans, and looser ones that touch no base span nor an earlier looser kind."""
    out = base_spans(text)
    for k, pattern in enumerate((NUMBER, ADDRESS, TITLED), len(KINDS)):
        taken, i = sorted((a, b) for _, a, b in out), 0
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else ()
        for m in pattern.finditer(text):
            while i < len(taken) and reach[i] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                out.append((k, m.start(), m.end()))
    return out


def name_words(span: str) -> list[str]:
    return [w for w in span.replace(".", "").split() if w not in TITLES]


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def named(text: str, start: int, span: str) -> bool:
    """Whether a title or a salutation says that the span is a name."""
    return span.split()[0].rstrip(".") in TITLES or bool(BEFORE_NAME.search(text, max(0, start - CONTEXT_CHARS), start))


def votes(text: str, kind: int, start: int, end: int) -> str:
    """One character per labeler: + for, - against, 0 abstains, ? for the gazetteer's vote that needs the corpus; then the shape of the span."""
    name, span = (*KINDS, *MORE)[kind], text[start:end]
    near = " ".join(["", *_WORDS.findall(text[max(0, start - CONTEXT_CHARS):start].lower()), ""])
    digits, groups = _digits(span), [len(g) for g in _GROUPS.findall(span)]
    v = ["+" if kind < len(KINDS) or name == "address" else "0"]
    v.append(("+" if luhn(digits) else "-") if name == "card" else ("+" if groups in _NUMBER_GROUPS else "-" if len(digits) < 9 else "0") if name == "number" else "0")
    v.append(("+" if named(text, start, span) or any(w in GAZETTEER for w in name_words(span)) else "?") if name == "name" else "0")
    v.append("+" if any(f" {c} " in near for c in CONTEXT[name]) else "0")
    last = near.split()[-1:]
    v.append("-" if kind >= len(KINDS) and (last and last[0] in AGAINST) else "0")
    edge = text[start - 1:start] + text[end:end + 1]
    v.append("-" if any(c.isalnum() or c in "/_=#" for c in edge) else "0")
    return "".join(v) + f"{min(len(digits), 20)}.{min(len(span.split()), 5)}.{min(len(groups), 5)}.{int('-' in span)}"


_WORDS, _GROUPS = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")
#: Lengths of the digit groups of phone and social security numbers.
_NUMBER_GROUPS = ([3, 3, 4], [3, 2, 4], [3, 3, 2, 2], [2, 3, 4], [3, 4, 4], [2, 4, 4])


def learned(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """For each slot 1 (a name), -1 (none) or 0, from (slot, occurrences, those said to be names)."""
    known = np.zeros(SLOTS, np.int8)
    for at, n, k in counts:
        known[at] = 1 if k >= LEAST_NAMED and k >= LEAST_NAMED_PART * n else -1 if k == 0 and n >= MOST_UNNAMED else 0
    return known


def completed(vote: str, slots: list[int], known: np.ndarray) -> str:
    """The votes with the gazetteer's; the last word of a name tells less than the first."""
    if "?" not in vote:
        return vote
    said = [int(known[s]) for s in slots]
    return vote.replace("?", "+" if said and (said[0] > 0 or min(said) > 0) else "-" if said and max(said) < 0 else "0")


def fit(counts: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """Probability of each (kind, votes) from the counts of all candidates."""
    if not counts:
        return {}
    kinds, n_lab = len(KINDS) + len(MORE), len(LABELERS)
    kind = np.array([k for k, _, _ in counts])
    vote = np.array([["-0+".index(c) for c in v[:n_lab]] for _, v, _ in counts])  # 0 against, 1 abstains, 2 for
    n = np.array([c for _, _, c in counts], float)
    score = vote - 1
    start = 2.0 * score.sum(axis=1) - 1
    p = 1 / (1 + np.exp(-start))  # majority as the start; without a vote rather not
    for k in range(kinds):  # the labelers' reliabilities are those for one kind
        of = kind == k
        m = n[of]
        for _ in range(EM_ROUNDS if of.any() else 0):
            q = p[of]
            logit = np.full(len(m), np.log(((m * q).sum() + 1) / ((m * (1 - q)).sum() + 2)))
            for j in range(n_lab):
                table = np.array([[(m * r)[vote[of, j] == s].sum() + 1 + (2 if s == want else 0) for s in range(3)] for r, want in ((q, 2), (1 - q, 0))])
                table /= table.sum(axis=1, keepdims=True)
                said = vote[of, j]
                logit += np.where(said == 1, 0.0, np.log(table[0, said] / table[1, said]))  # an abstention tells nothing
            p[of] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    shape = np.array([[float(x) for x in v[n_lab:].split(".")] for _, v, _ in counts]) / (20, 5, 5, 1)
    one = np.eye(kinds)[kind]
    by_kind = [one[:, [k]] * (score == s) for k in range(kinds) for s in (1, -1)]
    x = np.hstack([one, *by_kind, shape]).astype(float)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(FIT_ROUNDS):  # Newton steps, ridge for patterns that separate
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w)), x.T @ (weight * (p - q)) - 1e-4 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(k, v): float(a) for (k, v, _), a in zip(counts, q, strict=True)}


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row without its text, with n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    entry = pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.string()), ("slots", pa.list_(pa.int32())), ("named", pa.int32())])

    @F.arrow_udf("array<struct<kind:int,a:bigint,b:bigint,votes:string,slots:array<int>,named:int>>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s = t.as_py() or ""
            row = []
            for k, a, b in candidates(s):
                person = k == len(KINDS) + MORE.index("name")
                words = name_words(s[a:b]) if person else []
                row.append({"kind": k, "a": a, "b": b, "votes": votes(s, k, a, b), "slots": [slot(w) for w in words], "named": int(person and named(s, a, s[a:b]))})
            out.append(row)
        return pa.array(out, pa.list_(entry))

    @F.arrow_udf("array<struct<kind:int,a:bigint,b:bigint,votes:string>>")
    def voted(lists: pa.Array) -> pa.Array:
        out = [[{"kind": c["kind"], "a": c["a"], "b": c["b"], "votes": completed(c["votes"], c["slots"], gazetteer.value)} for c in one] for one in lists.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([entry.field(i) for i in range(4)])))

    context = docs.sparkSession.sparkContext
    rows = stored(docs.withColumn("__c", found(F.col(text))).drop(text), "candidates")
    said = rows.select(F.explode("__c").alias("c")).select(F.explode("c.slots").alias("slot"), "c.named").groupBy("slot").agg(F.count("*").alias("n"), F.sum("named").alias("k"))
    gazetteer = context.broadcast(learned([(r["slot"], r["n"], r["k"]) for r in said.collect()]))  # SLOTS rows at most
    rows = stored(rows.withColumn("__c", voted("__c")), "votes")
    counts = rows.select(F.explode("__c").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()
    handle = context.broadcast(fit(sorted((r["kind"], r["votes"], r["n"]) for r in counts)))
    names = (*KINDS, *MORE)
    result = pa.struct([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>")
    def decided(lists: pa.Array) -> pa.Array:
        out = []
        for one in lists.to_pylist():
            base = sorted((c["kind"], c["a"], c["b"]) for c in one if c["kind"] < len(KINDS))
            more = [(c["kind"], c["a"], c["b"]) for c in one if c["kind"] >= len(KINDS) and handle.value[c["kind"], c["votes"]] >= LEAST_PROBABILITY]
            n = Counter(k for k, _, _ in base)
            text_of = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for k, a, b in sorted(spans))
            out.append({f"n_{k}": n[i] for i, k in enumerate(KINDS)} | {"base_sha256": hashlib.sha256(text_of(base).encode()).hexdigest(), "spans": text_of(base + more)})
        return pa.array(out, result)

    done = rows.withColumn("__d", decided("__c")).drop("__c")
    return with_result(done, **{f: F.col(f"__d.{f}") for f in (*[f"n_{k}" for k in KINDS], "base_sha256", "spans")}).drop("__d")
