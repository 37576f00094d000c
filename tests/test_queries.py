import importlib.util
import os
import sys

import duckdb
import pytest

from tidewater.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_says_what_its_sql_says(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, rows))


def test_entry_point(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
    assert set(registry.queries()) <= set(module.queries())
    assert "tidewater" in sys.modules


def test_written_tables_are_in_the_shared_folder(spark):
    from tidewater.plans.joins import broadcast_if_small
    from tidewater.plans.storage import discard, materialize, shared_folder

    df = materialize(spark.range(5).toDF("id"), "test")
    files = df.inputFiles()
    assert df.count() == 5 and all(shared_folder(spark).split("://")[-1] in f for f in files)
    assert materialize(spark.createDataFrame([], "a int"), "none").count() == 0
    plan = lambda limit: spark.range(9).join(broadcast_if_small(df, limit), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(5 * 24) and "strategy=broadcast" not in plan(5 * 24 - 1)
    discard(df)
    assert not any(os.path.exists(f.split("://")[-1]) for f in files)


def test_scratch_tables_go_even_if_the_operator_fails(spark):
    from tidewater.plans.storage import materialize, scratch

    with scratch(spark) as keep:
        df = keep(spark.range(5).toDF("id"), "early")
        kept = materialize(df.where("id > 2"), "kept")
        files = df.inputFiles()
    assert kept.count() == 2 and not any(os.path.exists(f.split("://")[-1]) for f in files)
    with pytest.raises(ZeroDivisionError), scratch(spark) as keep:
        files = keep(spark.range(5).toDF("id"), "early").inputFiles()
        raise ZeroDivisionError
    assert not any(os.path.exists(f.split("://")[-1]) for f in files)
