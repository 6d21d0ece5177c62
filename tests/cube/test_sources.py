"""Fact tables from files, and the star-schema queries against SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gridweave import queries
from gridweave.sources.tables import lookup, materialise, read_csv, read_parquet

DIR = "/root/testdata/sf0.001"


def test_csv_and_lookup(spark, tmp_path):
    (tmp_path / "f.csv").write_text("code,n\nDE,1\nXX,2\n,3\n")
    df = read_csv(spark, str(tmp_path / "f.csv")).withColumn("region", lookup("code", {"DE": "Europe"}))
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("DE", 1, "Europe"), ("XX", 2, "Other"), (None, 3, None)]
    assert read_csv(spark, str(tmp_path / "f.csv"), "code string, n double").schema["n"].dataType.simpleString() == "double"


def test_materialised_facts_prune(spark, tmp_path):
    facts = queries.cube(spark, DIR).facts
    again = materialise(facts, str(tmp_path / "facts"), "year", "scenario")
    assert again.columns == facts.columns and again.count() == facts.count()
    plan = again.where("year = '1995'").groupBy("nation").count()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<nation:string>" in plan
    assert read_parquet(spark, str(tmp_path / "facts")).count() == facts.count()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    want = con.execute(queries.SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 0
    key = [c for c in columns if c != "value"]
    got, want = (df[columns].sort_values(key, ignore_index=True).astype({c: str for c in key}) for df in (got, want))
    pd.testing.assert_frame_equal(got.replace("None", "nan"), want.replace({"None": "nan", "<NA>": "nan"}), check_dtype=False, rtol=1e-9)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) == set(queries.SQL)
    df = entry.entry(spark)
    assert df.count() > 0 and "value" in df.columns
