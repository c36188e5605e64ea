"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from pagemill.plans import queries as core

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rounded = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(([rounded(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    rel = duck.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
