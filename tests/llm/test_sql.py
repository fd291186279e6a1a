"""The n-gram join's query against its SQL, all columns."""

import duckdb

from hyperweft.llm import oracles, queries

FOLDER = "/root/testdata/sf0.001"


def test_ngram_join_has_the_columns_of_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    df, want = queries.op6_ngram_join(spark, FOLDER), con.sql(oracles.SQL["op6_ngram_join"])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
