import __spark_entry__ as E


def test_registry_and_oracle_align():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 40
    assert set(o) <= set(q)


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["query_id", "rank", "ticket_id", "subject", "category", "score", "match_pct"]
    n_q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert len(rows) == 3 * n_q
