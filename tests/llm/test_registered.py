import duckdb
import pytest

import __spark_entry__ as entry
from castplan.llm.oracles import ORACLE_SQL
from castplan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, out.fetchall()))


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("op2_", "op9_"))])
def test_native_queries_have_no_python_nodes(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "ExistingRDD", "CartesianProduct"))
