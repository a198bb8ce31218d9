"""Stream operators over files, to the end of what is there."""

from pyspark.sql import functions as F

from wavelark.functions import codec as C
from wavelark.operators import sequences
from wavelark.sources import adapters
from wavelark.streaming import stateful


def run(spark, rows, build, tmp_path, name, mode="append"):
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name)


def test_sessions_equal_batch(spark, data, tmp_path):
    packets = adapters.packets(spark, data)
    got = run(spark, packets, lambda s: stateful.sessions(s, idle_ns=10**18), tmp_path, "sessions")
    events = {r.event: r.n for r in got.groupBy("event").agg(F.count("*").alias("n")).collect()}
    batch = sequences.session_totals(sequences.sessions(packets)).first()
    assert events["packet_seen"] == batch.packets and events["opened"] == batch.devices
    assert events.get("duplicate_sequence", 0) == batch.duplicates and events.get("timestamp_regression", 0) == batch.regressions


def test_resync(spark, tmp_path):
    a, b = (C.encode_packet({"kind": "heartbeat", "device": i, "timestamp_ns": 0, "sequence": i, "payload": b""}) for i in (1, 2))
    bad = bytearray(a)
    bad[20] ^= 1
    chunks = [b"noise" + a[:9], a[9:] + bytes(bad) + b[:3], b[3:]]
    rows = spark.createDataFrame([("l", i, bytearray(c)) for i, c in enumerate(chunks)], "link_id string, chunk int, data binary")
    got = run(spark, rows, stateful.parse, tmp_path, "resync").collect()
    assert [(r.ok, r.device, r.error) for r in got] == [(True, 1, None), (False, None, "checksum_mismatch"), (True, 2, None)]


def test_reassembly(spark, tmp_path):
    rows = [(900, 55, 2, 3, 1, "ef"), (900, 55, 0, 3, 2, "ab"), (900, 55, 0, 3, 3, "xx"), (900, 55, 1, 3, 4, "cd"), (901, 1, 0, 2, 5, "q")]
    df = spark.createDataFrame(rows, "device long, stream_id long, sequence int, count int, arrival long, payload string")
    got = run(spark, df, stateful.reassemble, tmp_path, "whole").collect()
    assert [(r.device, r.payload) for r in got] == [(900, "abcdef")]


def test_tumbling(spark, data, tmp_path):
    packets = adapters.packets(spark, data)
    got = run(spark, packets, lambda s: stateful.tumbling(s, "1 day"), tmp_path, "days", "complete")
    assert got.agg(F.sum("packets")).first()[0] == packets.count()
