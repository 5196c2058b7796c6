import datetime

from pyspark.sql import functions as F

from basalt.streaming import outbox

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(s):
    return T0 + datetime.timedelta(seconds=s)


def run(spark, tmp_path, batches, make, mode="append"):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name := f"t{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_and_limits(spark, tmp_path):
    rows = [(i, at(i * 10), 1, "a", 1.0) for i in range(12)] + [(99, at(5000), 1, "a", 1.0)]
    got = run(spark, tmp_path, [rows], lambda s: outbox.rate_limited(s, "user_id", 5, "1 minute"))
    assert sorted((r.requests, r.limited) for r in got if r.window.start < at(200)) == [(6, True), (6, True)]


def test_first_of_each_key(spark, tmp_path):
    rows = [(1, at(0), 1, "a", 1.0), (1, at(1), 1, "a", 1.0), (2, at(2), 1, "a", 1.0)]
    assert len(run(spark, tmp_path, [rows], lambda s: outbox.once(s, ["event_id"]))) == 2


def test_circuit_breaker(spark, tmp_path):
    rows = [(i, at(i), 1, "call", 0.0) for i in range(5)] + [(6, at(10), 1, "call", 1.0), (7, at(40), 1, "call", 1.0)]
    got = run(spark, tmp_path, [rows], lambda s: outbox.circuit_breaker(s.select("user_id", "ts", (F.col("value") > 0).alias("ok")), "user_id"))
    assert [r.state for r in sorted(got, key=lambda r: r["at"])] == ["closed"] * 4 + ["open", "open", "half-open", "closed"]


def test_publish_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    spark.createDataFrame([(1, at(0), 1, "a", 1.0), (1, at(0), 1, "a", 1.0), (2, at(1), 1, "a", 1.0)], SCHEMA).write.parquet(src)
    for c in ("c1", "c2"):
        outbox.publish(outbox.event_stream(spark, src), out, str(tmp_path / c), "event_id").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
