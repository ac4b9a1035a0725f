import __spark_entry__ as se

SF = "/root/testdata/sf0.001"


def _plan(capsys, df):
    df.explain(mode="simple")
    return capsys.readouterr().out


def test_flagship_single_shuffle_and_pruned_scan(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(capsys, se.queries()["best_steps"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastExchange" in plan
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln and "events" in ln][0]
    schema = scan.split("ReadSchema:")[1]
    assert "props" not in schema and "event_type" not in schema


def test_log_summary_single_shuffle(spark, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(capsys, se.queries()["log_summary"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
