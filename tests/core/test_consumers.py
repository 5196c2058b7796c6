"""Stale claims and run timeouts with processing-time timers, over a file stream that gets its rows while it runs."""

import time

import pytest

from basalt.streaming import consumers


@pytest.fixture
def stream(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in consumers.STORE}
    for k, v in consumers.STORE.items():
        spark.conf.set(k, v)
    yield lambda schema, out, make: _Running(spark, tmp_path, schema, out, make)
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


class _Running:
    def __init__(self, spark, folder, schema, out, make):
        self.spark, self.folder, self.schema, self.out, self.make = spark, folder, schema, out, make
        (folder / "in").mkdir(exist_ok=True)
        self.name = f"t{abs(hash(str(folder)))}"

    def start(self):
        rows = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").json(str(self.folder / "in"))
        out = self.make(rows).writeStream.format("parquet").option("path", str(self.folder / "out")).outputMode("append")
        self.query = out.option("checkpointLocation", str(self.folder / "c")).trigger(processingTime="1 second").start()
        return self

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(str(self.folder / "in" / str(time.time_ns())))

    def until(self, done, seconds=120):
        end = time.time() + seconds
        while time.time() < end:
            assert self.query.isActive, self.query.exception()
            got = self.rows()
            if done(got):
                return got
            time.sleep(0.5)
        raise AssertionError(self.rows())

    def rows(self):
        return self.spark.read.schema(self.out).parquet(str(self.folder / "out")).collect() if (self.folder / "out").exists() else []


def test_idle_deliveries_are_claimed_again(stream):
    run = stream("message string, event string", consumers.DELIVERIES, lambda s: consumers.consumer_group(s, 3, 2, 3)).start()
    run.add([("a", "publish"), ("b", "publish"), ("b", "publish"), ("c", "ack")])
    run.until(lambda got: {(r.message, r.event) for r in got} >= {("a", "delivered"), ("b", "delivered")})
    run.add([("b", "ack")])
    run.until(lambda got: ("b", "acknowledged") in {(r.message, r.event) for r in got})
    # A query that starts again goes on with its timers.
    run.query.stop()
    got = run.start().until(lambda got: ("a", "dead") in {(r.message, r.event) for r in got})
    run.query.stop()
    a = sorted((r.at, r.delivery, r.event, r.consumer) for r in got if r.message == "a")
    assert [(n, e) for _, n, e, _ in a] == [(1, "delivered"), (2, "claimed"), (3, "claimed"), (3, "dead")]
    assert len({c for *_, c in a[:3]}) == 3 and (a[1][0] - a[0][0]).total_seconds() >= 2
    b = sorted((r.at, r.event) for r in got if r.message == "b" and r.event in ("delivered", "acknowledged", "dead"))
    assert [e for _, e in b] == ["delivered", "acknowledged"]
    assert not [r for r in got if r.message == "c"]


def test_stale_runs_time_out(stream):
    run = stream("run string, status string", consumers.TIMEOUTS, lambda s: consumers.run_timeouts(s, 2)).start()
    run.add([("slow", "running"), ("quick", "running"), ("quick", "completed"), ("never", "completed")])
    got = run.until(lambda got: {r.run for r in got} >= {"slow", "quick"})
    run.add([("slow", "completed")])
    time.sleep(4)
    run.query.stop()
    assert {(r.run, r.status) for r in run.rows()} == {("slow", "timeout"), ("quick", "completed")}
    slow = next(r for r in got if r.run == "slow")
    assert (slow.ended - slow.started).total_seconds() >= 2
