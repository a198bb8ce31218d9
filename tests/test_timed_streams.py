"""Event-time streams give what their batch queries give, whatever order rows
arrive in, and end what has ended without another row of the same key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavelark.operators import history, planning, sequences
from wavelark.sources import adapters
from wavelark.streaming import timed

HOUR = 3_600_000_000_000
FAR = 2_000_000_000_000_000_000


def run(spark, rows, last, build, tmp_path, name):
    """rows in three files, shuffled within the delay, and a last one of another
    key far in the future."""
    for n in range(3):
        part = rows.where(F.col("file") == n).drop("file")
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    last.coalesce(1).write.parquet(str(tmp_path / "in/3"))
    stream = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name)


@pytest.fixture(scope="module")
def packets(spark, data):
    rows = adapters.packets(spark, data).where("device < 12").select("device", "capture_time_ns", "archive_path", "offset", "sequence", "payload_size")
    n = F.ntile(3).over(Window.orderBy((F.col("capture_time_ns") / 1e9 + F.pmod(F.xxhash64("offset"), F.lit(7200))))) - 1
    return rows.withColumn("file", n).cache()


def last_packet(spark, packets):
    return spark.createDataFrame([(-1, FAR, "z", 0, 0, 0)], packets.drop("file").schema)


def same(got, want, columns):
    rows = lambda df: sorted(map(str, df.select(*columns).where("device >= 0" if "device" in columns else "true").collect()))
    assert rows(got) == rows(want) and rows(want)


def test_idle_sessions_end_by_timers(spark, packets, tmp_path):
    got = run(spark, packets, last_packet(spark, packets), lambda s: timed.idle_sessions(s, 12 * HOUR, "3 hours"), tmp_path, "idle")
    same(got, sequences.idle_sessions(packets, 12 * HOUR), ["device", "session", "opened_ns", "last_seen_ns", "packets"])


def test_link_findings(spark, packets, tmp_path):
    got = run(spark, packets, last_packet(spark, packets), lambda s: timed.link_findings(s, 24 * HOUR, 8 * HOUR, "3 hours"), tmp_path, "link")
    same(got, sequences.link_findings(packets, 24 * HOUR, 8 * HOUR), ["device", "capture_time_ns", "offset", "code"])


def test_shards(spark, packets, tmp_path):
    policy = planning.Rotation(max_records=7, max_payload=9_000, max_span=200 * HOUR, idle_gap=40 * HOUR)
    got = run(spark, packets, last_packet(spark, packets), lambda s: timed.shards(s, policy, "3 hours"), tmp_path, "shards")
    same(got, planning.rotation(packets, policy), ["device", "archive_path", "offset", "shard", "opened_by"])


def test_sliding(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), rng.randint(0, 400) * 10**9, i, rng.randint(-50, 50)) for i in range(400)]
    table = spark.createDataFrame([(*r, min(2, int((r[1] / 1e9 + rng.randint(0, 50)) / 150))) for r in rows], "channel int, time_ns long, reading_id long, value int, file int")
    last = spark.createDataFrame([(-1, FAR, -1, 0)], "channel int, time_ns long, reading_id long, value int")
    got = run(spark, table, last, lambda s: timed.sliding(s, 30 * 10**9, "60 seconds"), tmp_path, "sliding").where("channel >= 0")
    want = sequences.sliding(table, 30 * 10**9)
    columns = ["channel", "reading_id", "time_ns", "start_ns", "n", "mean", "least", "most"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(got) == rows(want) and got.count() == 400


def test_tracks(spark, tmp_path):
    rng = random.Random(8)
    rows = [(r, n * 60 * 10**9, n, 0.1, [(100_000 * k + rng.choice([0, 4_000, 30_000]), -50.0 + n % 9, 8.0) for k in range(1, 4) if rng.random() < 0.7]) for r in (1, 2) for n in range(40)]
    schema = f"receiver int, time_ns long, frame_id long, ratio double, peaks array<{history.PEAK}>"
    table = spark.createDataFrame([(*r, r[2] * 3 // 40) for r in rows], f"{schema}, file int")
    last = spark.createDataFrame([(-1, FAR, -1, 0.0, [])], schema)
    got = run(spark, table, last, lambda s: timed.tracks(s, 16, delay="60 seconds"), tmp_path, "tracks").collect()
    told = lambda rs: {(r.receiver, r.track, r.nominal_hz, r.points, r.trend, round(r.mean_dbm, 9)) for r in rs}
    assert told(history.tracks(history.latest(table.drop("file"), 16)).collect()) <= told(got)


def test_rotation_in_one_pass(spark, packets):
    for policy in (planning.Rotation(max_records=5, idle_gap=20 * HOUR), planning.Rotation(max_payload=4_000, max_span=90 * HOUR, idle_gap=30 * HOUR, max_bytes=6_000), planning.Rotation(max_records=4, max_span=50 * HOUR)):
        want = []
        for device in range(12):
            before = None
            own = sorted(((r.capture_time_ns, r.archive_path, r.offset, r.payload_size) for r in packets.collect() if r.device == device))
            records = payload = start = number = 0
            for time, path, offset, size in own:
                why = None
                for limit, reached in (
                    ("max_records", policy.max_records and records >= policy.max_records), ("max_payload_bytes", policy.max_payload and payload + size > policy.max_payload), ("max_span_ns", policy.max_span and time - start > policy.max_span),
                    ("max_file_bytes", policy.max_bytes and 36 + payload + size + 16 * (records + 1) > policy.max_bytes), ("idle_gap", policy.idle_gap and before is not None and time - before > policy.idle_gap),
                ):
                    if records and reached:
                        why = why or limit
                if why:
                    number, records, payload = number + 1, 0, 0
                if not records:
                    start = time
                records, payload, before = records + 1, payload + size, time
                want.append((device, path, offset, number, why))
        assert sorted(map(tuple, planning.rotation(packets, policy).collect())) == sorted(want)
