"""Batches of encoded turns: texts and not ids are ranked."""

from stepwise.operators import bpe
from stepwise.plans import catalog


def test_ids_are_shuffled_once(spark, tmp_path, monkeypatch):
    rows = [(i // 3, i % 3, "user", None if i == 5 else "ab c" * (i % 4)) for i in range(40)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(catalog, "_model", lambda *a, **k: bpe.BpeModel([*bpe.SPECIALS, "a", "b", "c", " ", "ab"], [("a", "b")]))
    out = catalog.QUERIES["flatten_labels"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.rindex("AdaptiveSparkPlan"):].split("ArrowEvalPython")[0]
    assert above.count("Exchange") == 1
    got = {r["batch"]: r for r in out.collect()}
    assert [got[b]["n_rows"] for b in sorted(got)] == [16, 16, 8]
    ids = {i: catalog.bpe.EOS_ID for i in (0, 4, 5)}
    for i, eos in ids.items():  # empty and null texts have the end alone, padded
        width = got[0]["n_labels"] // 16
        assert got[0]["labels"][i * width:(i + 1) * width] == [eos] + [bpe.PAD_ID] * (width - 1)
