import statistics

from pyspark.sql import functions as F

from pointloom.streaming import running


def test_history_tells_the_newest_row(spark, tmp_path):
    """The latest iteration comes in the first batch, so all later rows of the name carry it too."""
    df = spark.range(50).select(F.lit("a").alias("name"), (50 - F.col("id")).alias("iteration"), (F.col("id") * F.col("id")).cast("double").alias("value"))
    s = running.replay(df, str(tmp_path / "in"), 5, "iteration")
    s = running.drained(running.stream_history(s, 4), str(tmp_path), "update")
    rows = sorted(s.collect(), key=lambda r: r.seen)
    assert len({r.iteration for r in rows[-3:]}) == 1 and len(rows) > 1
    want = [float(i * i) for i in range(4)]
    assert rows[-1].seen == 50 and (rows[-1]["mean"], rows[-1]["median"]) == (sum(want) / 4, statistics.median(want))


def test_streams_are_written_by_all_tasks(spark, tmp_path):
    """No go is one file of one task, results stay out of the driver, and rows without a key are kept."""
    df = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") >= 100, F.col("id")).alias("point"), (F.col("id") % 7).alias("class"), F.lit(1.0).alias("weight"))
    s = running.replay(df, str(tmp_path / "in"), 4, "point")
    assert len(spark.read.parquet(str(tmp_path / "in")).inputFiles()) >= 20
    d = running.drained(running.stream_votes(s), str(tmp_path))
    assert len(d.inputFiles()) > 1 and d.columns == ["point", "class", "w"]
    assert d.agg(F.sum("w"), F.count("*")).first()[:] == (4000.0, 3900 + 7)


def test_nothing_streamed(spark, tmp_path):
    df = spark.range(0).select(F.col("id").alias("point"), F.lit(1).alias("class"), F.lit(1.0).alias("weight"))
    assert running.drained(running.stream_votes(running.replay(df, str(tmp_path / "in"), 3, "point")), str(tmp_path)).count() == 0
