import inspect

import __spark_entry__ as entry


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
    assert {n for n in q if n[:2] != "op" and n != "pipeline"} <= set(o)  # every query of the core has SQL
    assert all(len(inspect.signature(f).parameters) == 2 for f in q.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "severity" in df.columns
