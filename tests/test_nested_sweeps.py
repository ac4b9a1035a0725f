import pytest
from pyspark.sql import functions as F

from stepwise.operators import nested, sweeps


def _nested_df(spark):
    return spark.createDataFrame(
        [("foo", (1, 2), ((1,),))],
        "str string, dict struct<a:int,b:int>, nested struct<dict:struct<a:int>>")


def test_flatten_matches_expected_columns(spark):
    flat = nested.flatten(_nested_df(spark))
    assert flat.columns == ["str", "dict.a", "dict.b", "nested.dict.a"]
    assert tuple(flat.first()) == ("foo", 1, 2, 1)


def test_unflatten_inverts_flatten(spark):
    df = _nested_df(spark)
    back = nested.unflatten(nested.flatten(df))
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.first().asDict(recursive=True) == {"str": "foo", "dict": {"a": 1, "b": 2},
                                                    "nested": {"dict": {"a": 1}}}


def test_unflatten_clash_raises(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `a.b` int")
    with pytest.raises(ValueError):
        nested.unflatten(df)
    df2 = spark.createDataFrame([(1, 2)], "`a.b` int, a int")
    with pytest.raises(ValueError):
        nested.unflatten(df2)


def _axis(spark, name, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos bigint, `{name}` {dtype}")
    return (name, df)


def test_simple_sweep_two_runs(spark):
    axes = [_axis(spark, "model.architecture", ["mlp"]), _axis(spark, "model.width", [10, 20], "int"),
            _axis(spark, "model.depth", [2], "int")]
    rows = sweeps.grid_expand(spark, axes).orderBy("run_id").collect()
    assert [(r["run_id"], r["model.width"]) for r in rows] == [(1, 10), (2, 20)]


def test_paired_sweep_six_runs_last_key_fastest(spark):
    pairs = spark.createDataFrame([(0, 1, 10), (1, 2, 20), (2, 3, 30)], "pos bigint, depth int, epochs int")
    axes = [_axis(spark, "width", [10, 20], "int"), _axis(spark, "optimizer", ["adam"]),
            ("paired", pairs)]
    rows = sweeps.grid_expand(spark, axes).orderBy("run_id").collect()
    assert len(rows) == 6
    assert {r["epochs"] for r in rows} == {10, 20, 30}
    assert [(r["width"], r["depth"]) for r in rows][:3] == [(10, 1), (10, 2), (10, 3)]


def test_empty_list_and_null_param(spark):
    empty = spark.createDataFrame([], "pos bigint, lr double")
    assert sweeps.grid_expand(spark, [_axis(spark, "w", [1, 2], "int"), ("lr", empty)]).count() == 0
    null_axis = spark.createDataFrame([(0, None)], "pos bigint, opt string")
    out = sweeps.grid_expand(spark, [_axis(spark, "w", [1, 2], "int"), ("opt", null_axis)])
    assert out.count() == 2 and "opt" not in out.columns


def test_run_state_latest_transition(spark):
    t = spark.createDataFrame([("r1", "new", 1), ("r1", "running", 2), ("r1", "finished", 3),
                               ("r2", "new", 1)], "run string, state string, ts int")
    st = {r["run"]: r["state"] for r in sweeps.run_state(t, "run", "state", "ts").collect()}
    assert st == {"r1": "finished", "r2": "new"}
    assert [r["run"] for r in sweeps.pending_runs(sweeps.run_state(t, "run", "state", "ts")).collect()] == ["r2"]


def test_default_params_fill_and_add(spark):
    df = spark.createDataFrame([("a", None), ("b", "adam")], "id string, optimizer string")
    out = {r["id"]: (r["optimizer"], r["train_batch"])
           for r in sweeps.default_params(df, {"optimizer": "sgd", "train_batch": 128}).collect()}
    assert out == {"a": ("sgd", 128), "b": ("adam", 128)}


def test_axes_from_params_table(spark):
    params = spark.createDataFrame(
        [("model.width", 1, ["10", "20"]), ("model.architecture", 0, ["mlp"]), ("lr", 2, ["0.1", "0.01", "0.001"])],
        "param string, ord int, values array<string>")
    runs = sweeps.grid_expand(spark, sweeps.axes_from_table(params)).orderBy("run_id").collect()
    assert len(runs) == 6
    assert [(r["model.width"], r["lr"]) for r in runs[:3]] == [("10", "0.1"), ("10", "0.01"), ("10", "0.001")]
    empty = spark.createDataFrame([("a", 0, ["1"]), ("b", 1, [])], "param string, ord int, values array<string>")
    assert sweeps.grid_expand(spark, sweeps.axes_from_table(empty)).count() == 0


def test_axes_from_table_gives_values_their_types_back(spark):
    from stepwise.operators import sweeps
    params = spark.createDataFrame([("m.w", 0, ["2", "10"]), ("m.off", 1, [None])], "param string, ord int, values array<string>")
    grid = sweeps.grid_expand(spark, sweeps.axes_from_table(params, types={"m.w": "int"}))
    assert grid.columns == ["m.w", "run_id"]
    assert [tuple(r) for r in grid.orderBy("run_id").collect()] == [(2, 1), (10, 2)]
