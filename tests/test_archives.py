"""Archives written, read, damaged and salvaged; UDFs in SQL."""

import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from wavelark.__main__ import main
from wavelark.functions import codec as C
from wavelark.functions import udfs
from wavelark.operators import query, sampling
from wavelark.sources import archives, ath, upkeep


def frame(device, sequence, payload, kind="observation", time=0):
    return C.encode_packet({"kind": kind, "device": device, "timestamp_ns": time, "sequence": sequence, "payload": payload})


@pytest.fixture()
def archive(tmp_path):
    path = tmp_path / "a.ath"
    path.write_bytes(archives.archive_bytes([(100, frame(40, 1, b"a")), (200, frame(41, 2, b"ab")), (300, frame(41, 3, b"abc"))]))
    return str(path)


def test_scan_and_query(spark, archive):
    packets = archives.as_packets(archives.read(spark, [archive], "FAILFAST"))
    assert [r.offset for r in packets.orderBy("offset").collect()][0] == 36
    q = query.Query(start=150, device=41, min_payload=3)
    assert query.archive(packets, q).count() == 1
    s = query.stats(packets, q).first()
    assert (s.scanned, s.matched, s.skipped_by_time, s.skipped_by_payload) == (3, 1, 1, 1)
    assert query.replay(packets, 150, 250).first().asDict() == {"seen": 3, "emitted": 1, "bytes": 2}
    assert archives.headers(spark, [archive]).first()[2:] == (3, 100, 300)


def test_damage(spark, archive, tmp_path):
    data = bytearray(open(archive, "rb").read())
    data[-10] ^= 1
    bad = tmp_path / "bad.ath"
    bad.write_bytes(bytes(data))
    rows = archives.read(spark, [str(bad)]).orderBy("offset").collect()
    assert [r.corrupt for r in rows] == [None, None, "record crc mismatch"]
    with pytest.raises(Exception, match="crc mismatch"):
        archives.read(spark, [str(bad)], "FAILFAST").collect()
    assert archives.salvage(spark, [str(bad)]).where("packet.ok").count() == 2


def test_salvage_in_noise(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes.fromhex("ff001337") + frame(30, 9, b"z"))
    rows = archives.salvage(spark, [str(tmp_path / "x.bin")]).collect()
    assert [(r.offset, r.capture_time_ns, r.packet.device, r.packet.sequence) for r in rows] == [(4, 0, 30, 9)]


def test_batches_and_frames(spark, tmp_path):
    (tmp_path / "b").write_bytes(C.encode_batch([frame(1, 1, b""), frame(2, 2, b"")]))
    (tmp_path / "bad").write_bytes(b"\1\0")
    (tmp_path / "f").write_bytes(frame(3, 3, b""))
    assert archives.read_batches(spark, [str(tmp_path / "b")]).where("packet.ok").count() == 2
    assert archives.read_batches(spark, [str(tmp_path / "bad")]).where("NOT packet.ok").count() == 1
    assert archives.read_frames(spark, [str(tmp_path / "f")]).first().packet.device == 3


def read_rows(spark, folder, **options):
    return ath.load(spark, str(folder), "FAILFAST", **options)


def test_sink_and_ranges(spark, tmp_path):
    rows = [(1000 + i, frame(i % 3, i, b'x' * (i % 7), time=i)) for i in range(2000)]
    frames = spark.createDataFrame(rows, "capture_time_ns long, frame binary").coalesce(1)
    ath.write(frames, str(tmp_path / "out"), blockBytes="1000", fileBytes="30000")
    files = list((tmp_path / "out").glob("*.ath"))
    assert len(files) > 2 and not list((tmp_path / "out" / "_temporary").iterdir())
    whole = read_rows(spark, tmp_path / "out", partitionBytes="4000")
    assert sorted(r.sequence for r in whole.collect()) == list(range(2000))
    assert whole.rdd.getNumPartitions() > 20
    some = whole.where("capture_time_ns between 1500 and 1520 and device in (0, 2)")
    assert sorted(r.sequence for r in some.collect()) == [i for i in range(500, 521) if i % 3 != 1]
    assert some.rdd.getNumPartitions() < 4
    assert whole.where("payload_size > 100").count() == 0
    heads = ath.headers(spark, str(tmp_path / "out")).agg(F.sum("records"), F.min("first_time_ns"), F.max("last_time_ns")).first()
    assert tuple(heads) == (2000, 1000, 2999)
    # an index that doesn't fit its file isn't used
    files[0].write_bytes(archives.archive_bytes([(1510, frame(0, 9999, b"x"))]))
    assert 9999 in {r.sequence for r in read_rows(spark, tmp_path / "out").where("capture_time_ns = 1510").collect()}


def test_ranges_hold_a_piece_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ath, "PIECE", 200)
    monkeypatch.setattr(ath, "KEPT", 300)
    made = ath._File(fs.LocalFileSystem(), str(tmp_path / "a"), 500)
    for i in range(50):
        made.add(i, frame(1, i, b"y" * (i % 40)))
    made.close()
    made.verify()
    assert [p.name for p in tmp_path.iterdir()] == ["a"]
    with open(tmp_path / "a", "rb") as f:
        assert f.read() == archives.archive_bytes([(i, frame(1, i, b"y" * (i % 40))) for i in range(50)])
    data = bytearray((tmp_path / "a").read_bytes())
    data[-6] ^= 1
    (tmp_path / "a").write_bytes(bytes(data))
    with pytest.raises(OSError, match="crc mismatch after writing"):
        made.verify()


def test_overwrite_and_abort(spark, tmp_path):
    out = tmp_path / "out"
    one = spark.createDataFrame([("a.ath", 5, frame(1, 1, b""))], "archive_path string, capture_time_ns long, frame binary")
    ath.write(one, str(out))
    ath.write(one.withColumn("archive_path", F.lit("b.ath")), str(out), mode="overwrite")
    assert sorted(p.name for p in out.glob("*.ath")) == ["b.ath"] and read_rows(spark, out).count() == 1
    with pytest.raises(Exception, match="several places"):
        one.union(one).repartition(2).select("archive_path", "capture_time_ns", "frame").write.format("ath").mode("append").save(str(out))
    assert sorted(p.name for p in out.glob("*.ath")) == ["b.ath"]
    ath.write(one.where("false"), str(tmp_path / "none"))
    os.makedirs(tmp_path / "empty")
    assert read_rows(spark, tmp_path / "empty").count() == 0


def test_repair(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    good = archives.archive_bytes([(100 * i, frame(40 + i % 2, i, b"abc")) for i in range(1, 6)])
    (source / "good.ath").write_bytes(good)
    (source / "head.ath").write_bytes(good[:12] + b"\7" + good[13:])
    middle = bytearray(good)
    middle[len(good) // 2] ^= 1
    (source / "middle.ath").write_bytes(bytes(middle))
    (source / "noise.ath").write_bytes(b"AETHARC1" + b"\0" * 28 + b"\1" * 50)
    plans = upkeep.plan(spark, str(source)).cache()
    said = {r.archive_path: (r.action, r.readable_records, r.expected_records) for r in plans.collect()}
    assert said == {"good.ath": ("no_op", 5, 5), "head.ath": ("rewrite_from_readable_records", 5, 5), "middle.ath": ("rebuild_from_salvage", 2, 4), "noise.ath": ("quarantine_file", 0, 0)}
    done = {r.archive_path: (r.written_records, r.verified) for r in upkeep.repair(spark, str(source), str(out), plans).collect()}
    assert done == {"good.ath": (0, None), "head.ath": (5, True), "middle.ath": (4, True), "noise.ath": (0, None)}
    assert sorted(p.name for p in out.iterdir() if p.is_file()) == ["head.ath.repaired.ath", "middle.ath.repaired.ath", "noise.ath.quarantine"]
    assert sorted(p.name for p in source.iterdir()) == ["good.ath", "head.ath", "middle.ath"]
    again = upkeep.fleet(spark, str(out)).collect()
    assert all(r.ok for r in again) and (out / "head.ath.repaired.ath").read_bytes() == good


def test_udfs_in_sql(spark):
    udfs.register(spark)
    got = spark.sql("SELECT hex(rle_pack(unhex('010101020303030304'))) AS r, crc32c(encode('123456789', 'utf-8')) AS c, decode_packet(unhex('00')).error AS e, rle_unpack(unhex('01')) AS n").first()
    assert (got.r, got.c, got.e, got.n) == ("0301010204030104", 0xA71C05DF, "malformed_packet", None)
    df = spark.createDataFrame([(bytearray(bytes.fromhex("0164000000000000000a000000010007007b000000000000")),), (bytearray(b"\x09"),)], "p binary")
    rows = df.select(udfs.udf("decode_payload")("p").alias("x")).collect()
    assert [r.x.format for r in rows] == ["scalar", "unknown"] and rows[0].x.readings[0].value == 123


def test_record_hash(spark):
    df = spark.createDataFrame([(0, 36, 100, 3, 10, 1, "a.ath")], "archive_ordinal long, offset long, capture_time_ns long, payload_size long, device long, sequence long, archive_path string")
    assert sampling.record_hash(df).first()["hash"] % 2**64 == 5097723472819322427


def test_command_line(spark, archive, capsys):
    assert main(["manifest", archive]) == 0 and "a.ath" in capsys.readouterr().out
    assert main(["inspect", archive, "--filter", "device=41 min_payload = 3"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 3
    assert main(["inspect", archive, "--filter", "nothing=1"]) == 2
    assert main(["replay", archive, "--from-ns", "150"]) == 0 and main(["salvage", archive]) == 0
    assert os.path.exists(archive)


def test_pipeline_allowlist(spark, archive):
    packets = archives.as_packets(archives.read(spark, [archive]))
    allowed = packets.where("device = 41").select("device")
    assert query.steps(packets, allowed, 2).where(F.col("dropped_by").isNull()).count() == 1
