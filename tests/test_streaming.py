"""Streams over small file folders."""

import datetime

from pyspark.sql import functions as F

from quillon.streaming import jobs


def files(spark, tmp_path, n=40):
    out = str(tmp_path / "in")
    rows = spark.range(n).select((F.col("id") % 4).alias("who"), F.col("id").alias("item"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 300).alias("at"), F.col("id").cast("double").alias("value"))
    rows.repartition(3).write.parquet(out)
    return jobs.follow(spark, out, rows.schema, "parquet", 1)


def test_windows_and_sessions(spark, tmp_path):
    s = files(spark, tmp_path)
    w = jobs.latest(jobs.collected(jobs.windowed(s, "at", "1 hour", ["who"], "value", late="2 days"), "update"), ["start", "end", "who"])
    assert w.agg(F.sum("n")).first()[0] == 40 and w.agg(F.sum("total")).first()[0] == sum(range(40))


def test_sessions(spark, tmp_path):
    emitted = jobs.collected(jobs.sessions(files(spark, tmp_path), "at", "30 minutes", "who", late="2 days"), "append")
    assert emitted.columns == ["who", "start", "end", "n", "_batch"]


def at(minute):
    return datetime.datetime(2026, 1, 1, 12) + datetime.timedelta(minutes=minute)


def lease_run(spark, tmp_path, rows):
    """The rows as one more file of the folder, through the lease stream; what all runs have told so far."""
    schema = "who string, item int, at timestamp, done boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with jobs.own_state(spark):
        told = jobs.leases(jobs.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "parquet"), minutes=20, done="done")
        jobs.run_available(told, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}")), str(tmp_path / "check"))
    return sorted((r.who, r.item, r.event, r.at, r.expires_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_leases_expire_by_themselves(spark, tmp_path):
    """One open item at a time, over a stop and a start; expiry without a request; what has ended leaves no state."""
    first = [("a", 1, at(0), False), ("a", 2, at(5), False), ("b", 7, at(1), False), ("b", None, at(2), True), ("b", 8, at(3), False), ("c", 9, at(0), False), ("c", 5, at(21), False), ("d", 4, at(30), True)]
    got = lease_run(spark, tmp_path, first)
    want = [("a", 1, "granted", at(0), at(20)), ("a", 1, "kept", at(5), at(20)), ("b", 7, "granted", at(1), at(21)), ("b", 7, "done", at(2), at(21)), ("b", 8, "granted", at(3), at(23)), ("c", 9, "granted", at(0), at(20)), ("c", 9, "expired", at(20), at(20)), ("c", 5, "granted", at(21), at(41))]
    timers = [("a", 1, "expired", at(20), at(20)), ("b", 8, "expired", at(23), at(23))]  # the watermark is at 29 minutes
    assert got == sorted(want + timers)
    # from the checkpoint: c still holds its item, a can have one anew, and the last request of all ends nothing
    got = lease_run(spark, tmp_path, [("c", 6, at(40), False), ("a", 3, at(60), False)])
    more = [("c", 5, "kept", at(40), at(41)), ("c", 5, "expired", at(41), at(41)), ("a", 3, "granted", at(60), at(80))]
    assert got == sorted(want + timers + more)


def test_once_each_goes_on(spark, tmp_path):
    s = files(spark, tmp_path)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    into = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}")
    jobs.run_available(jobs.once_each(s, "who"), into, check)
    jobs.run_available(jobs.once_each(s, "who"), into, check)
    assert sorted(r.who for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def test_edits_within_a_day(spark, tmp_path):
    answers = [("a", 1, at(0)), ("a", 2, at(10)), ("b", 1, at(0))]
    edits = [("a", 1, at(5), "x"), ("a", 1, at(24 * 60), "y"), ("a", 1, at(24 * 60 + 1), "late"), ("a", 2, at(9), "early"), ("b", 2, at(5), "other item"), ("b", 1, at(0), "z")]
    spark.createDataFrame(answers, "who string, item int, at timestamp").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(edits, "who string, item int, at timestamp, labels string").write.parquet(str(tmp_path / "e"))
    stream = lambda n, kind: jobs.follow(spark, str(tmp_path / n), spark.createDataFrame([], kind).schema, "parquet")
    joined = jobs.edits_in_time(stream("a", "who string, item int, at timestamp"), stream("e", "who string, item int, at timestamp, labels string"), ["who", "item"])
    got = jobs.collected(joined).collect()
    assert sorted((r.who, r.item, r.labels, r.answered_at) for r in got) == [("a", 1, "x", at(0)), ("a", 1, "y", at(0)), ("b", 1, "z", at(0))]


def test_device_state_is_released(spark, tmp_path):
    """Accounts without a request for the days leave the state store; answers stay as they'd be with it."""
    schema, day = "who string, device int, at timestamp", 24 * 60
    seen = []

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told = jobs.device_slots(jobs.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "parquet"), days=3, late="1 minute")
        query = told.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return sorted((r.who, r.device, r.at, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    run([("a", 1, at(0)), ("a", 2, at(1)), ("a", 3, at(2)), ("b", 1, at(3))])
    run([("c", 1, at(5 * day))])
    got = run([("a", 3, at(5 * day + 1)), ("a", 1, at(5 * day + 2)), ("a", 2, at(5 * day + 3))])
    assert [r[3] for r in got if r[0] == "a"] == [True, True, True, False, False, True]
    assert seen[0] == 2 and seen[1] == 1 and seen[2] == 2
