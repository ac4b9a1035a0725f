"""Added spans of personal data on a corpus with planted names, numbers and addresses and with look-alikes."""

import random

import numpy as np

from stepwise.llm import pii

SYLLABLES = ("ka", "lo", "mi", "ra", "ten", "vo", "shu", "ber", "nal", "dri")


def corpus(seed, n=1500):
    """(text, spans of personal data): names are made words that sometimes follow a title; places and products look alike."""
    rnd = random.Random(seed)
    made = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(3)).capitalize()
    first, last, places = [made() + "a" for _ in range(40)], [made() + "son" for _ in range(60)], [made() + "ia" for _ in range(40)]
    def name():
        return f"{rnd.choice(first)} {rnd.choice(last)}"
    def number():
        return rnd.choice(("{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(rnd.randint(200, 999), rnd.randint(200, 999), rnd.randint(1000, 9999))
    out = []
    for i in range(n):
        words = lambda: " ".join(rnd.choice(("then", "we", "saw", "a", "long", "report", "and", "went", "on")) for _ in range(rnd.randint(2, 8)))
        kind = i % 9
        span = name() if kind < 3 else number() if kind < 5 else f"{rnd.randint(1, 900)} {rnd.choice(places)} {rnd.choice(('Street', 'Road', 'Avenue'))}" if kind == 5 else ""
        lead = {0: rnd.choice(("Dear ", "my name is ", "Mr. ", "Signed, ")), 1: "we spoke to ", 2: "", 3: "call ", 4: "my phone is ", 5: "she lives at "}.get(kind, "")
        if kind >= 6:
            lead, span_ = {6: ("they visited ", f"{rnd.choice(places)} {rnd.choice(places)}"), 7: ("version ", f"{rnd.randint(10, 99)}.{rnd.randint(10, 99)}.{rnd.randint(10, 99)}"), 8: ("total ", f"{rnd.randint(10, 99)} {rnd.randint(10, 99)} {rnd.randint(10, 99)}")}[kind]
            out.append((f"{words()} {lead}{span_} {words()}", set()))
            continue
        head = f"{words()} {lead}"
        if lead == "Mr. ":
            head, span = head[:-4], "Mr. " + span
        out.append((f"{head}{span} {words()}", {(len(head), len(head) + len(span))}))
    return out


def test_added_spans_precision_and_recall(spark):
    rows = corpus(4)
    got = pii.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    found = right = wanted = 0
    missed = []
    for r in got:
        spans = {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s and s.split(":")[0] in pii.MORE}
        want = rows[r["doc_id"]][1]
        found, right, wanted = found + len(spans), right + len(spans & want), wanted + len(want)
        if spans != want:
            missed.append((rows[r["doc_id"]], spans))
    print(f"precision {right / found:.3f} recall {right / wanted:.3f}", missed[:12])
    assert right / found >= 0.9 and right / wanted >= 0.9


def test_slots_and_votes_of_the_gazetteer():
    known = pii.learned([(3, 10, 5), (4, 100, 0), (5, 2, 0), (6, 1, 1)])
    assert known[[3, 4, 5, 6]].tolist() == [1, -1, 0, 0] and np.abs(known).sum() == 2
    assert pii.completed("00?0000.2.0.0", [3, 4], known)[2] == "+" and pii.completed("00?000", [4, 4], known)[2] == "-" and pii.completed("00?000", [5, 4], known)[2] == "0"
    assert pii.completed("00+000", [4], known) == "00+000"


def test_looser_spans_touch_no_other():
    text = "10 Main Street, Mr. Main Street 555-123-4567 card 4111 1111 1111 1111 a.b@c.de " * 3
    spans = sorted((a, b) for _, a, b in pii.candidates(text))
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
