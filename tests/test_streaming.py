from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestream.operators import sketches as S
from lodestream.streaming import sketches as T
from lodestream.streaming import sources, windows


def written(spark, folder, n=300):
    rnd = random.Random(6)
    rows = [(k, f"user{rnd.randint(0, 80)}" if rnd.random() < 0.98 else None, f"2016-01-{1 + k // 100:02d} {k % 24:02d}:00:00", "x", "web") for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "seq long, user_id string, ts string, city string, channel string").select("seq", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("ts").cast("timestamp_ntz").alias("arrived_at"), "city", "channel")
    sources.write_blocks(df, str(folder), 100)
    return df.filter("user_id is not null")


def test_bloom_stream_equals_batch(spark, tmp_path):
    df = written(spark, tmp_path / "in")
    state = T.BloomState(str(tmp_path / "state"), bits=997, truth=True)
    out = str(tmp_path / "out")
    q = sources.replay(spark, str(tmp_path / "in")).writeStream.foreachBatch(state.handler(lambda a, _: a.write.mode("append").parquet(out))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("seq", "maybe_seen", "seen").collect())
    want = sorted(tuple(r) for r in S.bloom_answers(df.select("seq", "user_id"), 997).select("seq", "maybe_seen", "seen").collect())
    assert got == want


def _run(spark, df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_aggregate_streams_equal_batch(spark, tmp_path):
    df = written(spark, tmp_path / "in")
    live = sources.replay(spark, str(tmp_path / "in"))
    got = T.fm_estimate(_run(spark, T.fm_registers(live.select("seq", "user_id"), 100), "fm", tmp_path / "c1"))
    want = S.fm_estimates(df.select("seq", "user_id"), 100).select("batch", "estimate")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # order numbers with gaps are as good as dense ones for comparing the two forms
    got = _run(spark, T.reservoir(live.select(F.col("seq").alias("n"), "user_id"), 10), "res", tmp_path / "c2")
    want = S.reservoir_events(df.select(F.col("seq").alias("n"), "user_id"), 10).groupBy("slot").agg(F.max_by("user_id", "n").alias("user_id"), F.max("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows(spark, tmp_path):
    df = written(spark, tmp_path / "in").withColumn("ts", F.col("ts").cast("timestamp"))
    tumbling = windows.windowed_users(df, "1 day", "1 day")
    assert tumbling.agg(F.sum("rows")).first()[0] == df.count()
    sliding = windows.windowed_users(df, "1 day", "1 day", "12 hours")
    assert sliding.agg(F.sum("rows")).first()[0] == 2 * df.count()
    assert windows.sessions(df, "2 hours", "1 day").agg(F.sum("rows")).first()[0] == df.count()
