"""Replay: the window, every record once across a restart, speed."""

import time

import pytest
from wavelark.functions import codec as C
from wavelark.sources import ath, replay


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("replay") / "in")
    rows = [(1_000 + i, C.encode_packet({"kind": "control", "device": i % 3, "timestamp_ns": i, "sequence": i, "payload": b"x" * (i % 5)})) for i in range(300)]
    ath.write(spark.createDataFrame(rows, "capture_time_ns long, frame binary").repartition(3), path, blockBytes="500")
    return path


def test_window(spark, folder, tmp_path):
    seen = []
    told = replay.emit(spark, folder, lambda b, n: seen.append([r.sequence for r in b.collect()]), str(tmp_path / "cp"), startNs=1_010, endNs=1_199, stepNs=60)
    assert sorted(x for part in seen for x in part) == list(range(10, 200))
    assert told == {"emitted": 190, "bytes": sum(i % 5 for i in range(10, 200))}
    assert len([p for p in seen if p]) == 4 and all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False) if a and b)


def test_every_record_once_after_a_restart(spark, folder, tmp_path):
    seen = []

    def fails(batch, number):
        if number == 2 and not any(n == 2 for n, _ in seen):
            seen.append((2, []))
            raise RuntimeError("lost")
        seen.append((number, [r.sequence for r in batch.collect()]))

    with pytest.raises(Exception, match="lost"):
        replay.emit(spark, folder, fails, str(tmp_path / "cp"), stepNs=50)
    replay.emit(spark, folder, fails, str(tmp_path / "cp"), stepNs=50)
    assert sorted(x for _, part in seen for x in part) == list(range(300))


def test_timing(spark, folder, tmp_path):
    stream = replay.stream(spark, folder, preserveTiming="true", speed=30 / 1e9)  # 30 ns of capture a second
    began = time.time()
    q = stream.writeStream.format("memory").queryName("timed_replay").option("checkpointLocation", str(tmp_path / "cp")).start()
    while spark.table("timed_replay").count() < 120 and time.time() - began < 60:
        time.sleep(0.2)
    passed = time.time() - began
    q.stop()
    got = [r.sequence for r in spark.table("timed_replay").collect()]
    assert sorted(got) == list(range(len(got))) and passed >= 3.9 and len(got) < 300
    with pytest.raises(ValueError, match="speed"):
        replay.ReplayReader({"path": folder, "speed": "0"}, None)
