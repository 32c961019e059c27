"""The newest row per key of a stream against the batch operator."""

import pytest
from pyspark.sql import functions as F

from docspark.operators import kb
from docspark.streaming import newest

SCHEMA = "user_id bigint, ts timestamp, event_id bigint, note string"


@pytest.fixture()
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in (newest.STATE_STORE[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*newest.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(spark, tmp_path, batches, delay, **options):
    """Each batch is a file, one per trigger; the rows that were the newest, by key, and the rows dropped as late."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{tmp_path}/in/p{i:03d}")
    stream = spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []

    def keep(batch, number):
        out.extend((number, r) for r in batch.collect())

    writer = newest.newest_by_key(stream, "user_id", "ts", delay, **options).writeStream.outputMode("update")
    query = writer.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return {r["user_id"]: r for _, r in sorted(out, key=lambda x: x[0])}, newest.late_rows(query), out


def test_a_shuffled_replay_gives_the_newest_rows(spark, tmp_path, state_store):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id", F.col("props").alias("note"))
    events = events.unionByName(events.limit(20)).unionByName(spark.createDataFrame([(None, None, 1, "x")], SCHEMA))
    parts = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).orderBy(F.rand(i)) for i in range(4)]
    got, late, sent = replay(spark, tmp_path, parts, "3650 days")
    body = F.sha2(F.to_json(F.struct("user_id", "ts", "event_id", "note"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), 256)
    want = kb.latest_wins(events.where("user_id is not null and ts is not null"), ["user_id"], [F.col("ts"), body])
    assert sorted(got.values()) == sorted(want.collect()) and late == 0
    assert len(sent) <= events.count()  # a row is sent only if it beats what was known


def test_late_rows_are_dropped_and_counted(spark, tmp_path, state_store):
    def rows(*data):
        return spark.createDataFrame(data, "user_id bigint, t string, event_id bigint, note string").select("user_id", F.col("t").cast("timestamp").alias("ts"), "event_id", "note")

    batches = [
        rows((1, "2026-01-01 00:00:00", 1, "a"), (2, "2026-01-01 00:00:00", 2, "b")),
        rows((1, "2026-01-10 00:00:00", 3, "new")),
        # rows are late by the watermark of the batch before the last
        rows((4, "2026-01-09 23:45:00", 6, "other")),
        rows((2, "2026-01-02 00:00:00", 4, "too late"), (3, "2026-01-09 23:30:00", 5, "in time")),
    ]
    got, late, _ = replay(spark, tmp_path, batches, "1 hour")
    assert {k: r["event_id"] for k, r in got.items()} == {1: 3, 2: 2, 3: 5, 4: 6} and late == 1


def test_parameters(spark):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        newest.newest_by_key(rows, "user_id", "ts", "1 hour", keep_hours=0)


def test_state_takes_few_calls_and_timers_move_only_with_the_time():
    """A call of the state server takes as long as many rows, so a key takes as few of them as it can."""
    from pyspark.sql import Row

    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    processor = newest._Newest(10)
    processor.init(Handle())

    def send(*rows):
        calls.clear()
        return [r.body for r in processor.handleInputRows((1,), iter([Row(at=a, tie=t, body=b) for a, t, b in rows]), None)]

    assert send((1000, "a", "x"), (5000, "a", "y"), (2000, "b", "z")) == ["y"] and calls == ["get", "update", ("register", 15)]
    assert send((4000, "a", "old")) == [] and calls == ["get"]
    assert send((5400, "a", "same millisecond")) == ["same millisecond"] and calls == ["get", "update"]
    assert send((9000, "a", "new")) == ["new"] and calls == ["get", "update", ("delete", 15), ("register", 19)]
