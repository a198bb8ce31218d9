"""Codecs as Arrow UDFs, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import codec as C

PACKET = (
    "struct<ok: boolean, error: string, version: int, kind: string, device: long, timestamp_ns: long, sequence: long, compression: int, encryption: int, "
    "fragment: struct<stream_id: long, sequence: int, count: int>, route: struct<region: int, collector: int, priority: int, relay_path: array<int>>, "
    "capabilities: struct<compression: boolean, encryption: boolean, gps_time: boolean, max_payload: int, sensor_bands: array<string>>, "
    "extensions: array<struct<type: int, value: binary>>, payload: binary>"
)
_FIELDS = ("version", "kind", "device", "timestamp_ns", "sequence", "compression", "encryption", "fragment", "route", "capabilities", "extensions", "payload")


def signed(n: int) -> int:
    """An unsigned 64-bit number as the signed one with the same bits."""
    return n - (1 << 64) if n >> 63 else n


def packet_row(frame: bytes | None, crc: int | None = None) -> dict:
    """A frame's fields, or ok=False and why it can't be decoded."""
    try:
        if frame is None:
            raise C.WireError("eof", "no frame")
        p = C.decode_packet(bytes(frame), crc=crc)
    except C.WireError as e:
        return {"ok": False, "error": e.code} | dict.fromkeys(_FIELDS)
    p["device"], p["timestamp_ns"] = signed(p["device"]), signed(p["timestamp_ns"])
    return {"ok": True, "error": None} | p


def packet_rows(frames: list[bytes | None]) -> list[dict]:
    """packet_row of many frames, their checksums computed together."""
    sums = C.crc32c_many([bytes(f)[:-4] if f is not None else b"" for f in frames]).tolist()
    return [packet_row(f, c) for f, c in zip(frames, sums, strict=True)]


def decode_packet(frames: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(packet_rows(frames.tolist()), columns=["ok", "error", *_FIELDS])


def _binary(call: Callable[..., bytes]):
    """A UDF on binary values; null where a value can't be coded."""

    def one(*values):
        if any(v is None for v in values):
            return None
        try:
            return call(*(bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else int(v) for v in values))
        except C.WireError:
            return None

    return one



def rle_pack(data: pd.Series) -> pd.Series:
    return data.map(_binary(C.rle_compress))


def rle_unpack(data: pd.Series) -> pd.Series:
    return data.map(_binary(C.rle_decompress))


def crc32c(data: pd.Series) -> pd.Series:
    there = data.notna()
    out = pd.Series([None] * len(data), dtype="Int64", index=data.index)
    out[there] = C.crc32c_many([bytes(x) for x in data[there]]).astype("int64")
    return out


def crc16(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else C.crc16_ccitt(bytes(x))).astype("Int64")


def seal(data: pd.Series, key: pd.Series, key_id: pd.Series) -> pd.Series:
    call = _binary(C.seal)
    return pd.Series([call(*x) for x in zip(data, key, key_id, strict=True)], dtype=object)


def unseal(data: pd.Series, key: pd.Series, key_id: pd.Series) -> pd.Series:
    call = _binary(C.unseal)
    return pd.Series([call(*x) for x in zip(data, key, key_id, strict=True)], dtype=object)


PAYLOAD = (
    "struct<format: string, warning: string, items: int, sample_time_ns: long, readings: array<struct<channel: int, value: int, scale: int, quality: string>>, "
    "center_hz: long, bin_width_hz: int, bins: array<struct<power_x10: int, noise_x10: int>>, command: int, correlation_id: long, body: binary, max_payload: int, bands: array<string>>"
)
_PAIR = [("power_x10", pa.int32()), ("noise_x10", pa.int32())]
_READING = [("channel", pa.int32()), ("value", pa.int32()), ("scale", pa.int32()), ("quality", pa.string())]
_PAYLOAD_TYPE = pa.struct(
    [("format", pa.string()), ("warning", pa.string()), ("items", pa.int32()), ("sample_time_ns", pa.int64()), ("readings", pa.list_(pa.struct(_READING))), ("center_hz", pa.int64()), ("bin_width_hz", pa.int32())]
    + [("bins", pa.list_(pa.struct(_PAIR))), ("command", pa.int32()), ("correlation_id", pa.int64()), ("body", pa.binary()), ("max_payload", pa.int32()), ("bands", pa.list_(pa.string()))]
)
_PAYLOAD = ("sample_time_ns", "readings", "center_hz", "bin_width_hz", "bins", "command", "correlation_id", "body", "max_payload", "bands")


#: Payloads that are Python values at a time: a batch's structs and lists as
#: such would take hundreds of bytes for each item.
PAYLOADS = 256


def _parts(values: pa.Array) -> Iterator[list]:
    for at in range(0, len(values), PAYLOADS):
        yield values.slice(at, PAYLOADS).to_pylist()


def decode_payload(data: pa.Array) -> pa.Array:
    """Payloads by their first byte; what can't be decoded becomes a warning."""
    out = []
    for part in _parts(data):
        rows = []
        for x in part:
            try:
                p = C.decode_payload(x or b"")
                items = next((len(p[k]) for k in ("readings", "bins", "body", "bands") if k in p), 0)
                rows.append({"format": p["format"], "warning": None, "items": items} | {k: p.get(k) for k in _PAYLOAD})
            except C.WireError as e:
                rows.append({"format": "unknown", "warning": str(e), "items": 0} | dict.fromkeys(_PAYLOAD))
        out.append(pa.array(rows, _PAYLOAD_TYPE))
    return pa.concat_arrays(out) if out else pa.array([], _PAYLOAD_TYPE)


def _plain(value):
    """Lists and dicts in place of the arrays that Arrow hands over."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, np.ndarray)):
        return [_plain(v) for v in value]
    return value


def encode_packet(packets: pd.DataFrame) -> pd.Series:
    """Frames of packets: structs with the fields that decode_packet gives, of
    which version, compression, encryption and all sections may be left out."""
    from .frames import encoded

    bare = set(packets.columns) == {"kind", "device", "timestamp_ns", "sequence", "payload"}
    # what the codec would refuse, it refuses
    if bare and all(packets[c].dtype == np.int64 for c in ("device", "timestamp_ns", "sequence")) and packets["kind"].isin(C.KINDS).all() and packets["payload"].notna().all() and packets["sequence"].between(0, (1 << 32) - 1).all():
        return pd.Series(encoded(packets["kind"], packets["device"].to_numpy(), packets["timestamp_ns"].to_numpy(), packets["sequence"].to_numpy(), [bytes(x) for x in packets["payload"]]), dtype=object, index=packets.index)
    out = []
    for p in packets.to_dict("records"):
        p = _plain(p)
        out.append(C.encode_packet(p | {k: p[k] & (1 << 64) - 1 for k in ("device", "timestamp_ns")}))
    return pd.Series(out, dtype=object)


def encode_payload(payloads: pa.Array) -> pa.Array:
    """Payloads of structs with a format and its fields."""
    return pa.array((C.encode_payload(p) for part in _parts(payloads) for p in part), pa.binary())


def tlv_pack(types: pd.Series, values: pd.Series) -> pd.Series:
    """Type-length-value bytes of two arrays."""
    return pd.Series([C.encode_tlv(list(zip(map(int, t), v, strict=True))) for t, v in zip(types, values, strict=True)], dtype=object)


def tlv_fields(data: pd.Series) -> pd.Series:
    """The fields of type-length-value bytes; null where they are damaged."""
    out = []
    for x in data:
        try:
            out.append(None if x is None else [{"type": t, "value": v} for t, v in C.parse_tlv(bytes(x))])
        except C.WireError:
            out.append(None)
    return pd.Series(out, dtype=object)


def tlv_unsigned(data: pd.Series) -> pd.Series:
    """Little-endian numbers of 1 to 8 bytes, as signed ones of the same bits."""
    return data.map(_binary(lambda x: signed(C.tlv_unsigned(x)))).astype("Int64")


#: The functions above with the types that they return.
TYPES = {
    "encode_packet": "binary",
    "encode_payload": "binary",
    "tlv_pack": "binary",
    "tlv_fields": "array<struct<type: int, value: binary>>",
    "tlv_unsigned": "long",
    "decode_packet": PACKET,
    "rle_pack": "binary",
    "rle_unpack": "binary",
    "crc32c": "long",
    "crc16": "long",
    "seal": "binary",
    "unseal": "binary",
    "decode_payload": PAYLOAD,
}


#: Those that take and give Arrow arrays instead of series.
ARRAYS = ("encode_payload", "decode_payload")


def udf(name: str):
    """One of the functions above as an Arrow UDF on columns."""
    return (F.arrow_udf if name in ARRAYS else F.pandas_udf)(globals()[name], TYPES[name])


def register(spark: SparkSession) -> None:
    """Makes the codecs callable from SQL."""
    for name in TYPES:
        spark.udf.register(name, udf(name))
