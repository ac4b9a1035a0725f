import duckdb
import pytest

import __spark_entry__ as se
from stepwise.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
# trained to full size, one merge at a time is too slow in SQL: tests/test_bpe.py has brute force
NO_ORACLE = {"sweep_train", "sweep_train_log", "bpe_merges_1000", "bpe_merges_10000", "encode_conversations_1000"}


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["run_id", "optimizer", "learning_rate", "depth", "width", "best_loss_step",
                          "best_loss", "best_smoothed_loss_step", "best_smoothed_loss"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    missing = set(se.queries()) - set(se.oracle_sql())
    assert {q for q in missing if q not in se.LLM_QUERIES} == NO_ORACLE


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF)
    cols = df.columns
    rows = sorted("|".join(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(se.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = sorted("|".join(_norm(dict(zip(ocols, r))[c]) for c in sorted(ocols)) for r in res.fetchall())
    assert sorted(cols) == sorted(ocols)
    assert rows == orows
