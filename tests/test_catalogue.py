from corpusloom.plans import catalogue


def test_queries_match_sql(compare, data):
    assert compare(catalogue.QUERIES, catalogue.ORACLES, data) == []


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_queries_without_sql_give_rows(spark, data):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, data).count() > 0, name


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_reference_rank_is_limited_before_the_shuffle(spark, data):
    plan = catalogue.QUERIES["pick_refs"](spark, data)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_the_columns_it_needs(spark, data):
    plan = catalogue.QUERIES["count_chunks"](spark, data)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:string,n:int>" in plan
