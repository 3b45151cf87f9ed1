from tidegauge import session


def test_small_tables_are_spread_large_ones_are_not(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    t = spark.read.parquet(path)
    count = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    jobs = count()
    small, shuffled = session.spread(t), session.spread(t.groupBy("id").count())
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    large = session.spread(t)
    # Nothing was run, over a shuffle either.
    assert count() == jobs
    assert (small.rdd.getNumPartitions(), large.rdd.getNumPartitions()) == (4, 1) and shuffled.count() == 1000


def test_stored_tables_keep_rows_and_schema(spark):
    t = spark.range(10).selectExpr("id", "cast(null as string) as s", "array(id) as a")
    held = session.stored(t)
    assert held.dtypes == t.dtypes and sorted(map(str, held.collect())) == sorted(map(str, t.collect()))
    assert session.stored(t.where("id < 0")).count() == 0
