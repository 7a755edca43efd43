import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf_dir, tables, name):
    got = registry.queries()[name](spark, sf_dir)
    con = tables.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, con.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "lang", "n_texts", "mean_density"] and entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark, sf_dir):
    plan = registry.queries()["word_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
