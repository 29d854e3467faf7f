"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from tidelane.operators import folds
from tidelane.plans.registry import HOUR, hourly
from tidelane.streaming import candles as C


def split(spark, df, path, parts):
    """df as a file for each part of its time, in order, as a stream reads them."""
    edges = df.approxQuantile("_t", [k / parts for k in range(parts + 1)], 0.0)
    for k in range(parts):
        high = edges[k + 1] + (k == parts - 1)
        df.filter((F.col("_t") >= edges[k]) & (F.col("_t") < high)).drop("_t").coalesce(1).write.mode("append").parquet(path)


def test_candles(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_t", F.unix_millis(F.col("ts").cast("timestamp")))
    split(spark, ticks, f"{tmp_path}/in", 4)
    stream = spark.readStream.schema(ticks.drop("_t").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = C.run_once(C.candles(stream, HOUR, "40 days"), "stream_candles", "update", f"{tmp_path}/cp")
    last = got.groupBy("series", "ts_ms").agg(F.max_by(F.struct("o", "h", "l", "c", "v"), "v").alias("x")).select("series", "ts_ms", "x.*")
    want = hourly(spark, sf_dir).select("series", "ts_ms", "o", "h", "l", "c", "v")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_recursive_indicators(spark, sf_dir, tmp_path):
    bars = hourly(spark, sf_dir).withColumn("_t", F.col("ts_ms"))
    split(spark, bars, f"{tmp_path}/in", 3)
    stream = spark.readStream.schema(bars.drop("_t").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = C.run_once(C.smoothed(stream, 0.1), "stream_smooth", "append", f"{tmp_path}/cp1")
    want = folds.smooth_long(hourly(spark, sf_dir), "c", 0.1, "smooth").select("series", "ts_ms", "smooth")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = C.run_once(C.cycles(stream, "kalman"), "stream_cycle", "append", f"{tmp_path}/cp2").select("series", "bar_idx", "cycle", "fisher")
    want = folds.cycle(hourly(spark, sf_dir), "kalman").select("series", "bar_idx", "cycle", "fisher")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partial_bars_leave_the_state(spark, tmp_path):
    rows = [("a", i, float(i % 5), i % 3 != 2) for i in range(30)]
    spark.createDataFrame(rows, "series string, ts_ms long, c double, final boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("series string, ts_ms long, c double, final boolean").parquet(f"{tmp_path}/in")
    got = {r["ts_ms"]: r for r in C.run_once(C.cycles(stream, final="final"), "stream_partial", "append", f"{tmp_path}/cp").collect()}
    s = C.CycleState()
    for _, ts, c, done in rows:
        if done:
            assert got[ts]["cycle"] == s.step(c)[2]
