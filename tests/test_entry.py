"""Driver contract: entry smoke check and every registered query against its SQL oracle."""

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import canon, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "row_type" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_queries_match_oracles(spark):
    con = duck(SF_SMALL)
    bad = []
    for name, fn in E.queries().items():
        sp = fn(spark, SF_SMALL).toPandas()
        sql = E.oracle_sql().get(name)
        if sql is None:
            continue
        dk = con.execute(sql).df()
        if sorted(sp.columns) != sorted(dk.columns) or canon(sp) != canon(dk):
            bad.append(name)
    assert not bad, bad
