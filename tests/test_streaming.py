"""The streaming forms give what their batch twins give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import activity
from tandem.streaming import clicks

SCHEMA = "id long, browser_id long, create_time timestamp, user_time int, id1 string, id2 string"


def drained(spark, tmp_path, make, mode, name):
    rows = [(i, i % 3, i * i % 97, i * 7 % 11, "a", f"{i % 4}") for i in range(60)]
    log = spark.createDataFrame(rows, "id long, browser_id long, at long, user_time int, id1 string, id2 string").withColumn("create_time", F.timestamp_seconds(F.col("at") + 1_700_000_000)).select("id", "browser_id", "create_time", "user_time", "id1", "id2")
    log.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    q.awaitTermination(120)
    return log, spark.table(name)


def test_trailing_counts(spark, tmp_path):
    log, got = drained(spark, tmp_path, clicks.trailing_counts, "update", "trailing")
    assert sorted(got.collect()) == sorted(clicks.trailing_counts(log).collect())


def test_sessions(spark, tmp_path):
    log, got = drained(spark, tmp_path, lambda s: clicks.sessions(s, "5 seconds"), "complete", "sessions")
    want = activity.sessions(log, 5000).select("browser_id", "started", "ended", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_first_seen(spark, tmp_path):
    log, got = drained(spark, tmp_path, clicks.first_seen, "append", "first_seen")
    assert got.count() == log.select("browser_id", "id1", "id2").distinct().count()


def test_recent_means(spark, tmp_path):
    log, got = drained(spark, tmp_path, clicks.recent_means, "update", "means")
    last = activity.sliding(log).join(activity.last_n(log, 1).select("id"), "id").select("browser_id", "mean_10", "mean_50")
    assert sorted((r[0], round(r[1], 6), round(r[2], 6)) for r in got.collect()) == sorted(map(tuple, last.collect()))


def test_screens(spark, tmp_path):
    log, got = drained(spark, tmp_path, clicks.screens, "update", "screens")
    last = activity.last_n(log, 2).select("browser_id", "rn", "id2").collect()
    want = {(r["browser_id"], r["rn"]): r["id2"] for r in last}
    assert sorted((r["browser_id"], r["id2"], r["previous2"]) for r in got.collect()) == [(b, want[b, 1], want[b, 2]) for b in range(3)]


def test_latest_neighbours(spark, tmp_path):
    make = lambda s: clicks.latest_neighbours(s.select("browser_id", "create_time", F.array("id1", "id2").alias("neighbours")))
    log, got = drained(spark, tmp_path, make, "complete", "neighbours")
    batch = clicks.latest_neighbours(log.select("browser_id", "create_time", F.array("id1", "id2").alias("neighbours")))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect())) and got.count() >= 3
