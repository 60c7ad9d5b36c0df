"""Each query with SQL gives the SQL's rows, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found, wanted = core.queries()[name](spark, SF).toPandas(), con.sql(core.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=repr)
    assert key(found) == key(wanted)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.words > 0 and row.perplexity > 1


def test_streamed_counts_are_batch_counts(spark, tmp_path):
    from lexmill.streaming import counting

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a b a\nb c\n")
    counting.start(counting.word_stream(counting.read_text_stream(spark, str(tmp_path / "in"))), "streamed", str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.word, r.cnt) for r in spark.table("streamed").collect()} == {("a", 2), ("b", 2), ("c", 1)}
