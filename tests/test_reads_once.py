"""What reads archives reads them once."""

from pyspark.sql import functions as F

from wavelark.functions import codec as C
from wavelark.sources import archives, ath, replay, upkeep


def _folder(tmp_path):
    data = archives.archive_bytes([(100 * i, C.encode_packet({"kind": "control", "device": i % 2, "timestamp_ns": i, "sequence": i, "payload": b"abc"})) for i in range(1, 9)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ath").write_bytes(data)
    (tmp_path / "in" / "b.ath").write_bytes(b"\0" * 8 + data[8:])
    return str(tmp_path / "in")


def test_an_audit_a_fleet_and_a_plan_read_records_once(spark, tmp_path, monkeypatch):
    folder, loads, read = _folder(tmp_path), [], ath.load
    monkeypatch.setattr(ath, "load", lambda *a, **k: loads.append(a) or read(*a, **k))
    for query in (upkeep.audit, upkeep.fleet, upkeep.plan):
        loads.clear()
        rows = query(spark, folder).collect()
        assert len(loads) == 1 and {r.archive_path for r in rows} >= {"b.ath"}
    assert sorted((r.archive_path, r.action, r.salvaged_records) for r in rows) == [("a.ath", "no_op", 0), ("b.ath", "rebuild_from_salvage", 8)]


def test_salvage_opens_only_unsound_files(spark, tmp_path):
    folder = _folder(tmp_path)
    named = spark.createDataFrame([("b.ath",)], "archive_path string")
    assert [r.path for r in upkeep._contents(named, folder).collect()] == ["b.ath"]


def test_a_replayed_batch_is_decoded_once(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.ath").write_bytes(archives.archive_bytes([(100 * i, C.encode_packet({"kind": "control", "device": 1, "timestamp_ns": i, "sequence": i, "payload": b"abc"})) for i in range(1, 9)]))
    seen = []

    def put(batch, number):
        seen.append((batch.storageLevel.useMemory or batch.storageLevel.useDisk, batch.agg(F.count("*")).first()[0]))

    assert replay.emit(spark, str(tmp_path / "one"), put, str(tmp_path / "check")) == {"emitted": 8, "bytes": 24}
    assert [kept for kept, _ in seen] == [True] * len(seen) and sum(n for _, n in seen) == 8
