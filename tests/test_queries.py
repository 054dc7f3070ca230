"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glossweave.plans import catalog


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, db, tmp_path, name):
    catalog.queries()[name](spark, sf).write.parquet(str(tmp_path / "out"))
    want = db.execute(catalog.oracle_sql()[name]).to_arrow_table()
    got = duckdb.connect().execute(f"from '{tmp_path}/out/*.parquet'").to_arrow_table()
    cols = sorted(want.column_names)
    assert cols == sorted(got.column_names)
    db.register("want", want.select(cols))
    db.register("got", got.select(cols))
    assert db.execute("select count(*) from ((from want except all from got) union all (from got except all from want))").fetchone()[0] == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_best_mention_is_scored(spark, sf):
    got = catalog.queries()["classifier_scores"](spark, sf)
    want = spark.read.parquet(f"{sf}/best_mentions.parquet").select("doc_id", "bem_index")
    assert got.count() == want.count() and want.exceptAll(got.select("doc_id", "bem_index")).count() == 0
    assert got.filter("confidence between 0 and 1").count() == got.count()
