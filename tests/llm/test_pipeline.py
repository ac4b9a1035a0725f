"""The pipeline's stages on the smallest tables: rows, columns and decisions."""

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from stepwise.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "benchmark_leaks", "mixture", "sharding"]
    assert [sum(q.startswith(f"op{i}_") for q in QUERIES) for i in range(1, 14)] == [1] * 13


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, SF).persist()
        assert out.dtypes == docs.dtypes, name
        assert out.select("doc_id").distinct().join(seen.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "near_copies":
            assert out.groupBy("text").count().where("count > 1").isEmpty()
        if name == "benchmark_leaks":
            from stepwise.llm import decontam
            assert decontam.decontaminate(out, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").isEmpty()
        seen = out
    last = cp.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count() and {"shard", "slot"} <= set(last.columns)


def _fixture(spark, folder):
    """Documents with clear-cut cases: rejected ones, copies, near copies, passages of the benchmark."""
    rnd = random.Random(11)
    letters = {"aa": "bcdlmnaeiou", "bb": "kwxzyaeiouh", "cc": "prstvqaeiou"}
    words = {k: ["".join(rnd.choice(v) for _ in range(rnd.randint(3, 8))) for _ in range(300)] for k, v in letters.items()}
    prose = lambda k, n: [rnd.choice(words[k]) for _ in range(n)]
    items = [prose("aa", 12), prose("bb", 14), prose("cc", 6)]
    rows = [(i, " ".join(prose(k, rnd.randint(60, 140))), k, f"s{i % 4}") for i, k in ((i, ("aa", "bb", "cc")[i % 3]) for i in range(90))]
    text = lambda i: rows[i][1].split(" ")
    rows += [(100 + i, rows[0][1], "aa", f"s{i % 3}") for i in range(6)]  # exact copies
    rows += [(110 + i, " ".join([*text(1)[:-1], f"end{'abcdef'[i]}"]), "bb", "s1") for i in range(6)]  # one word differs
    rows += [(120, " ".join(text(2)[: len(text(2)) // 2]), "cc", "s2")]  # half of a text is no near copy
    rows += [(130, " ".join([*prose("aa", 40), *items[0][1:11], *prose("aa", 40)]), "aa", "s0"), (131, " ".join([*prose("bb", 40), *items[1], *prose("bb", 40)]), "bb", "s3")]
    rows += [(132, " ".join([*prose("aa", 40), *items[0][:9], *prose("aa", 40)]), "aa", "s0"), (133, " ".join([*prose("cc", 40), *items[2], *prose("cc", 40)]), "cc", "s1")]
    rows += [(140, None, "aa", "s0"), (141, "", "aa", "s0"), (142, "12 34 56", "bb", "s1"), (143, "!? --", None, None)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")), items


def _classes(texts):
    """Ids by class: texts joined by a Jaccard similarity of their five-word shingles of 0.8 or more, all pairs."""
    shingles = {i: {tuple(t.split(" ")[k:k + 5]) for k in range(max(1, len(t.split(" ")) - 4))} for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                root[top(j)] = top(i)
    out = {}
    for i in texts:
        out.setdefault(top(i), set()).add(i)
    return list(out.values())


def test_each_stage_equals_brute_force(spark, tmp_path):
    docs, items = _fixture(spark, tmp_path)
    stages = dict(cp.STAGES)
    kept = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    every = kept(docs)

    spoken = stages["language"](spark, docs, str(tmp_path)).persist()
    now = kept(spoken)
    assert set(now) == {i for i, t in every.items() if re.search("[a-z]", t or "")}

    single = stages["near_copies"](spark, spoken, str(tmp_path)).persist()
    classes = _classes(now)
    assert sorted(map(len, classes))[-2:] == [7, 7]
    left = kept(single)
    assert all(len(c & set(left)) == 1 for c in classes) and len(left) == len(classes) == single.count()

    clean = stages["benchmark_leaks"](spark, single, str(tmp_path)).persist()
    windows = {" ".join(w[k:k + min(10, len(w))]) for w in items for k in range(len(w) - min(10, len(w)) + 1)}
    assert set(kept(clean)) == {i for i, t in left.items() if not any(f" {w} " in f" {t} " for w in windows)}
    assert {130, 131, 133}.isdisjoint(kept(clean)) and 132 in kept(clean)

    mixed = stages["mixture"](spark, clean, str(tmp_path)).persist()
    size, source = {i: len(t.split()) for i, t in kept(clean).items()}, {r["doc_id"]: r["source"] for r in clean.collect()}
    sums = collections.Counter()
    for i, n in size.items():
        sums[source[i]] += n
    weight = dict(zip(sorted(sums), (5, 2, 1) * 3))
    goal, open_, rest = {}, set(sums), 1.5 * sum(sums.values())
    while open_:  # what a source can't take is shared out again
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sums[s]}
        if not full:
            goal |= share
            break
        goal |= {s: 2 * sums[s] for s in full}
        rest -= sum(2 * sums[s] for s in full)
        open_ -= full
    taken, times = collections.Counter(), collections.Counter(r["doc_id"] for r in mixed.collect())
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert max(times.values()) <= 2
    assert all(abs(taken[s] - goal[s]) <= max(n for i, n in size.items() if source[i] == s) for s in sums)
    assert all(times[i] >= int(goal[source[i]] // sums[source[i]]) for i in size)

    rows = stages["sharding"](spark, mixed, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == times
    held, groups, where = collections.Counter(), collections.Counter(), {}
    texts = kept(clean)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(text.encode()) + 8
        assert r["size"] == n
        held[r["shard"]] += n
        groups[text] += n
        assert where.setdefault(text, r["shard"]) == r["shard"]  # equal texts together
    assert set(held) <= set(range(24)) and max(held.values()) <= sum(held.values()) / 24 + max(groups.values())
    for shard in held:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
