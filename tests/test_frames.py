"""Frames decoded and encoded together against the codec, one by one."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql.types import StructType

from wavelark.functions import codec as C
from wavelark.functions import frames, udfs
from wavelark.sources import archives, ath


def plain(n, **more):
    return C.encode_packet({"kind": C.KINDS[n % 5], "device": (1 << 64) - 1 - n, "timestamp_ns": n << 40, "sequence": n, "payload": b"p" * (n % 7)} | more)


def odd():
    """Frames of every kind that the fast path must leave to the codec."""
    good = plain(3)
    out = [None, b"", good[:-1], good + b"\0", good[:50] + b"\1" + good[51:] if len(good) > 51 else good[:-1] + b"!", good[:-4] + b"\0" * 4, plain(9)]
    out += [plain(4, version=v) for v in (1, 2, 7)] + [plain(4, compression=1, encryption=2)]
    out.append(plain(5, fragment={"stream_id": 1, "sequence": 0, "count": 2}, extensions=[{"type": 3, "value": b"x"}]))
    out.append(plain(6, route={"region": 1, "collector": 2, "priority": 3, "relay_path": [4, 5]}))
    return out + [plain(n) for n in range(20)]


def test_decoded_is_what_the_codec_gives(spark):
    from pyspark.sql.pandas.types import to_arrow_schema

    given = odd()
    got, kinds = frames.Decoded(given), to_arrow_schema(StructType.fromDDL(f"packet {udfs.PACKET}")).field("packet").type
    rows = pa.StructArray.from_arrays([got.column(f.name, f.type) for f in kinds], fields=list(kinds)).to_pylist()
    want = [udfs.packet_row(f) for f in given]
    for a, b in zip(rows, want, strict=True):
        if b["ok"]:
            assert a == b
        else:
            assert (a["ok"], a["error"], a["payload"], a["device"]) == (False, b["error"], None, None)
    assert got.sizes().tolist() == [len(p["payload"]) if p["ok"] else 0 for p in want]


def test_encoded_is_what_the_codec_gives():
    rows = [{"kind": C.KINDS[n % 5], "device": n - 3, "timestamp_ns": -n, "sequence": n, "payload": b"q" * n} for n in range(9)]
    want = [C.encode_packet(r | {k: r[k] & (1 << 64) - 1 for k in ("device", "timestamp_ns")}) for r in rows]
    assert udfs.encode_packet(pd.DataFrame(rows)).tolist() == want
    with pytest.raises(Exception):
        udfs.encode_packet(pd.DataFrame([rows[0] | {"sequence": -1}]))


def test_plain_records_are_not_coded_one_by_one(tmp_path, monkeypatch):
    records = [(10 * n, plain(n)) for n in range(300)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.ath").write_bytes(archives.archive_bytes(records))
    (tmp_path / "c.ath").write_bytes(archives.archive_bytes(records)[:-9])
    from pyspark.sql.types import LongType, StringType, StructField

    schema = StructType([StructField("archive_path", StringType()), StructField("offset", LongType()), StructField("corrupt", StringType()), StructField("device", LongType())])
    sums, many = [], C.crc32c_many
    monkeypatch.setattr(C, "decode_packet", lambda *a, **k: pytest.fail("decoded alone"))
    monkeypatch.setattr(C, "crc32c", lambda *a: pytest.fail("summed alone"))
    monkeypatch.setattr(C, "crc32c_many", lambda rows: sums.append(len(rows)) or many(rows))
    monkeypatch.setattr(frames, "packet_row", lambda frame, crc=None: {"ok": False, "error": "eof"} | dict.fromkeys(udfs._FIELDS) if frame is None else pytest.fail("decoded alone"))
    reader = ath.Reader({"path": str(tmp_path)}, schema)
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [sum(r["archive_path"] == f"{n}.ath" for r in rows) for n in "abc"] == [300, 300, 300]
    assert [r["corrupt"] for r in rows if r["corrupt"]] == ["archive record is truncated"]
    # three small files share the checksums of records and those of frames
    assert len(sums) == 2
    made = list(ath._records([t for t, _ in records], [f for _, f in records]))
    data = b"".join(r for _, r, _, _ in made)
    assert (tmp_path / "a.ath").read_bytes()[36:] == data and made[3][2] == (udfs.signed((1 << 64) - 4),) * 2


def test_a_damaged_record_ends_its_own_file_only(tmp_path):
    whole = archives.archive_bytes([(n, plain(n)) for n in range(5)])
    at = 36 + len(archives.archive_bytes([(0, plain(0)), (1, plain(1))])) - 36 + 20
    hurt = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
    for name, data in (("a", whole), ("b", hurt), ("c", whole)):
        (tmp_path / f"{name}.ath").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "b.ath")) as f:
        assert [r[3] for rows in ath.walk(f, 0, len(hurt), len(hurt)) for r in rows] == [None, None, "archive record crc mismatch"]
    held = []
    for name in "abc":
        with fs.LocalFileSystem().open_input_file(str(tmp_path / f"{name}.ath")) as f:
            held += ath.pieces(f, 0, len(whole), len(whole))
    assert [(len(rows), damaged) for rows, damaged in ath.checked(held)] == [(5, False), (3, True), (5, False)]


def test_salvage_goes_on_behind_what_failed(spark, tmp_path):
    """Against a search that decodes one frame after the other."""
    rng = np.random.default_rng(5)
    data = b"".join(plain(n) if n % 3 else plain(n)[:-6] + b"NOISE" + rng.bytes(n % 5) for n in range(60))
    data += plain(1)[:8] * 40 + plain(2)
    want, at = [], 0
    while (at := data.find(plain(0)[:4], at)) >= 0 and at + 12 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little") + 12
        ok = at + size <= len(data) and udfs.packet_row(data[at : at + size])["ok"]
        want.append((at, ok))
        at += size if ok else 1
    (tmp_path / "x.bin").write_bytes(data)
    rows = archives.salvage(spark, [str(tmp_path / "x.bin")]).select("offset", "packet.ok").collect()
    assert sorted((r.offset, r.ok) for r in rows) == want and any(ok for _, ok in want) and not all(ok for _, ok in want)
