"""Wire formats of packets and payloads as functions on bytes.

Small helpers that Arrow UDFs and the archive source share; each decodes or
encodes one value. Errors are WireError with a code, so that a distributed
decode can keep a bad record as a row.
"""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

# Fixed values of the wire formats.
PACKET_MAGIC = 0x4E485441
ARCHIVE_MAGIC = b"AETHARC1"
MAX_PACKET = 1 << 20
CRC32C_POLYNOMIAL, CRC16_POLYNOMIAL = 0x82F63B78, 0x1021
SECTION_FRAGMENT, SECTION_ROUTE, SECTION_CAPABILITIES, SECTION_EXTENSION = 1, 2, 3, 4
MOST_HOPS, MOST_BANDS, BAND_BYTES = 32, 16, 64
KINDS = ("heartbeat", "observation", "spectrum", "control", "capabilities")
QUALITIES = ("good", "saturated", "missing_calibration", "noisy", "invalid")
FORMATS = ("scalar", "spectrum", "control", "capability")


class WireError(ValueError):
    """code is eof, malformed_packet, checksum_mismatch or unsupported_version."""

    def __init__(self, code: str, said: str):
        super().__init__(said)
        self.code = code


def _table() -> list[int]:
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, (n >> np.uint32(1)) ^ np.uint32(CRC32C_POLYNOMIAL), n >> np.uint32(1))
    return n.tolist()


_CRC = _table()


def crc32c(data: bytes) -> int:
    """Castagnoli, with a register that starts at zero (not at all ones) and
    an inverted result."""
    r = 0
    for b in data:
        r = _CRC[(r ^ b) & 255] ^ (r >> 8)
    return r ^ 0xFFFFFFFF


#: Bytes that a grid of values of one length has at most, beyond one value.
CRC_GRID = 1 << 24


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """crc32c of many values at once. The register starts at zero, so zeros in
    front change nothing and rows of like length can be brought to one."""
    table, out = np.array(_CRC, np.uint32), np.zeros(len(rows), np.uint32)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]), reverse=True)
    at = 0
    while at < len(order):
        width = len(rows[order[at]])
        part = order[at : at + max(1, CRC_GRID // max(width, 1))]
        grid = np.frombuffer(b"".join(rows[i].rjust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        r = np.zeros(len(part), np.uint32)
        for column in np.ascontiguousarray(grid.T):
            r = table[(r ^ column) & 255] ^ (r >> np.uint32(8))
        out[part] = ~r
        at += len(part)
    return out


def crc16_ccitt(data: bytes, seed: int = 0xFFFF) -> int:
    r = seed
    for b in data:
        r ^= b << 8
        for _ in range(8):
            r = ((r << 1) ^ CRC16_POLYNOMIAL if r & 0x8000 else r << 1) & 0xFFFF
    return r


class Reader:
    """Little-endian values from the front of data."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise WireError("eof", "data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def take(self, form: str) -> Any:
        got = struct.unpack("<" + form, self.bytes(struct.calcsize("<" + form)))
        return got if len(got) > 1 else got[0]

    def text(self, most: int) -> str:
        n = self.take("H")
        if n > most:
            raise WireError("malformed_packet", "string is too long")
        return self.bytes(n).decode("utf-8", "replace")

    @property
    def empty(self) -> bool:
        return self.at == len(self.data)


def _bad(said: str) -> WireError:
    return WireError("malformed_packet", said)


def _read_section(p: dict, code: int, body: bytes, strict: bool) -> None:
    r = Reader(body)
    if code == SECTION_FRAGMENT:
        stream, sequence, count = r.take("IHH")
        if count == 0 or sequence >= count:
            raise _bad("invalid fragment coordinates")
        p["fragment"] = {"stream_id": stream, "sequence": sequence, "count": count}
    elif code == SECTION_ROUTE:
        region, collector, priority, hops = r.take("HHBB")
        if hops > MOST_HOPS:
            raise _bad("relay path is too deep")
        p["route"] = {"region": region, "collector": collector, "priority": priority, "relay_path": [r.take("H") for _ in range(hops)]}
    elif code == SECTION_CAPABILITIES:
        flags, most, n = r.take("BHB")
        if n > MOST_BANDS:
            raise _bad("too many bands")
        p["capabilities"] = {"compression": bool(flags & 1), "encryption": bool(flags & 2), "gps_time": bool(flags & 4), "max_payload": most, "sensor_bands": [r.text(BAND_BYTES) for _ in range(n)]}
    elif code == SECTION_EXTENSION:
        kind, size = r.take("HH")
        p["extensions"].append({"type": kind, "value": r.bytes(size)})
    elif strict:
        raise _bad("unknown section")
    if not r.empty:  # holds for unknown sections as well
        raise _bad("section tail not consumed")


def decode_packet(frame: bytes, strict: bool = False, most: int = MAX_PACKET, crc: int | None = None) -> dict:
    """A frame's fields; the payload stays as it is. crc is the frame's own
    checksum where the caller has computed it already."""
    if not 12 <= len(frame) <= most:
        raise _bad("packet length outside bounds")
    magic, size = struct.unpack_from("<II", frame)
    if magic != PACKET_MAGIC:
        raise _bad("packet magic mismatch")
    if size + 12 != len(frame):
        raise _bad("packet length mismatch")
    if (crc32c(frame[:-4]) if crc is None else crc) != struct.unpack_from("<I", frame, len(frame) - 4)[0]:
        raise WireError("checksum_mismatch", "packet crc mismatch")
    r = Reader(frame[8:-4])
    version, kind = r.take("BB")
    if not 1 <= version <= 3:
        raise WireError("unsupported_version", "unsupported protocol version")
    if not 1 <= kind <= len(KINDS):
        raise _bad("unknown packet kind")
    device, time, sequence, compression, encryption = r.take("QQIBB")
    p = {"version": version, "kind": KINDS[kind - 1], "device": device, "timestamp_ns": time, "sequence": sequence, "compression": compression, "encryption": encryption, "fragment": None, "route": None, "capabilities": None, "extensions": []}
    s = Reader(r.bytes(r.take("I")))
    while True:
        if s.empty:
            raise _bad("section terminator missing")
        if (code := s.take("B")) == 0:
            break
        _read_section(p, code, s.bytes(s.take("H")), strict)
    if not s.empty:
        raise _bad("trailing section bytes")
    p["payload"] = r.bytes(r.take("I"))
    if not r.empty:
        raise _bad("trailing packet bytes")
    return p


def _section(code: int, body: bytes) -> bytes:
    return struct.pack("<BH", code, len(body)) + body


def encode_packet(p: dict) -> bytes:
    """The frame of a packet's fields, as decode_packet gives them."""
    s = b""
    if f := p.get("fragment"):
        s += _section(SECTION_FRAGMENT, struct.pack("<IHH", f["stream_id"], f["sequence"], f["count"]))
    if f := p.get("route"):
        if len(f["relay_path"]) > MOST_HOPS:
            raise ValueError("relay path is too deep")
        s += _section(SECTION_ROUTE, struct.pack("<HHBB", f["region"], f["collector"], f["priority"], len(f["relay_path"])) + struct.pack(f"<{len(f['relay_path'])}H", *f["relay_path"]))
    if f := p.get("capabilities"):
        flags = f["compression"] | f["encryption"] << 1 | f["gps_time"] << 2
        bands = [b.encode() for b in f["sensor_bands"]]
        s += _section(SECTION_CAPABILITIES, struct.pack("<BHB", flags, f["max_payload"], len(bands)) + b"".join(struct.pack("<H", len(b)) + b for b in bands))
    for x in p.get("extensions") or ():
        s += _section(SECTION_EXTENSION, struct.pack("<HH", x["type"], len(x["value"])) + x["value"])
    s += b"\0"
    body = struct.pack("<BBQQIBB", p.get("version", 3), KINDS.index(p["kind"]) + 1, p["device"], p["timestamp_ns"], p["sequence"], p.get("compression", 0), p.get("encryption", 0))
    body += struct.pack("<I", len(s)) + s + struct.pack("<I", len(p["payload"])) + p["payload"]
    frame = struct.pack("<II", PACKET_MAGIC, len(body)) + body
    return frame + struct.pack("<I", crc32c(frame))


def encode_batch(frames: list[bytes]) -> bytes:
    return struct.pack("<H", len(frames)) + b"".join(struct.pack("<I", len(f)) + f for f in frames)


def decode_batch(data: bytes) -> list[dict]:
    """The packets of a batch; bytes after the last are an error."""
    r = Reader(data)
    out = [decode_packet(r.bytes(r.take("I"))) for _ in range(r.take("H"))]
    if not r.empty:
        raise _bad("trailing batch bytes")
    return out


def parse_tlv(data: bytes, most_fields: int = 128, most_bytes: int = 65536) -> list[tuple[int, bytes]]:
    r, out = Reader(data), []
    while not r.empty:
        kind, size = r.take("HH")
        if len(out) == most_fields or size > most_bytes:
            raise _bad("tlv limit exceeded")
        out.append((kind, r.bytes(size)))
    return out


def encode_tlv(fields: list[tuple[int, bytes]]) -> bytes:
    return b"".join(struct.pack("<HH", kind, len(value)) + value for kind, value in fields)


def tlv_unsigned(value: bytes) -> int:
    if not 1 <= len(value) <= 8:
        raise _bad("tlv integer width")
    return int.from_bytes(value, "little")


def tlv_text(value: bytes, most: int = 4096) -> str:
    if len(value) > most or b"\0" in value:
        raise _bad("tlv string")
    return value.decode("utf-8", "replace")


def rle_compress(data: bytes) -> bytes:
    """(run, byte) pairs with runs of 1 to 255."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    cuts = np.concatenate([[0], np.nonzero(a[1:] != a[:-1])[0] + 1, [len(a)]])
    out = bytearray()
    for start, n in zip(cuts[:-1].tolist(), np.diff(cuts).tolist(), strict=True):
        while n > 0:
            out += bytes((min(n, 255), data[start]))
            n -= 255
    return bytes(out)


def rle_decompress(data: bytes, most: int = MAX_PACKET) -> bytes:
    if len(data) % 2:
        raise _bad("malformed rle stream")
    a = np.frombuffer(data, np.uint8)
    if int(a[::2].sum()) > most:
        raise _bad("rle output limit exceeded")
    return np.repeat(a[1::2], a[::2]).tobytes()


def _mask(data: bytes, key: bytes, key_id: int) -> bytes:
    k = np.frombuffer(key, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ k[(np.arange(len(data)) + key_id) % len(k)]).tobytes()


def seal(plain: bytes, key: bytes, key_id: int) -> bytes:
    """Masks and tags data. It shows tampering by accident; it is no security."""
    return struct.pack("<I", crc32c(key) ^ crc32c(plain)) + _mask(plain, key, key_id)


def unseal(sealed: bytes, key: bytes, key_id: int) -> bytes:
    if len(sealed) < 4 or not key:
        raise _bad("bad envelope")
    plain = _mask(sealed[4:], key, key_id)
    if struct.unpack_from("<I", sealed)[0] != crc32c(key) ^ crc32c(plain):
        raise WireError("checksum_mismatch", "envelope tag mismatch")
    return plain


_READING = np.dtype([("channel", "<u2"), ("value", "<i4"), ("scale", "<i2"), ("quality", "u1")])
_BIN = np.dtype([("power_x10", "<i2"), ("noise_x10", "<i2")])


def _items(r: Reader, kind: np.dtype, most: int) -> np.ndarray:
    n = r.take("H")
    if n > most:
        raise _bad("too many items")
    return np.frombuffer(r.bytes(n * kind.itemsize), kind)


def decode_payload(data: bytes) -> dict:
    """A payload by its first byte; the format and its fields."""
    r = Reader(data)
    marker = r.take("B")
    if not 1 <= marker <= len(FORMATS):
        raise _bad("unknown payload format")
    out: dict[str, Any] = {"format": FORMATS[marker - 1]}
    if marker == 1:
        out["sample_time_ns"], out["sample_rate_hz"] = r.take("QI")
        a = _items(r, _READING, 512)
        if len(a) and a["quality"].max() >= len(QUALITIES):
            raise _bad("unknown quality")
        out["readings"] = [{"channel": int(x["channel"]), "value": int(x["value"]), "scale": int(x["scale"]), "quality": QUALITIES[x["quality"]]} for x in a]
    elif marker == 2:
        out["center_hz"], out["span_hz"], out["bin_width_hz"] = r.take("QIH")
        out["bins"] = [{"power_x10": int(x["power_x10"]), "noise_x10": int(x["noise_x10"])} for x in _items(r, _BIN, 8192)]
    elif marker == 3:
        out["command"], out["flags"], out["correlation_id"], n = r.take("HHII")
        if n > 1 << 20:
            raise _bad("control body is too large")
        out["body"] = r.bytes(n)
    else:
        out["max_payload"], flags, n = r.take("HBH")
        if n > 128:
            raise _bad("too many bands")
        out |= {"compression": bool(flags & 1), "encryption": bool(flags & 2), "gps_time": bool(flags & 4), "bands": [r.text(128) for _ in range(n)]}
    if not r.empty:
        raise _bad("trailing payload bytes")
    return out


def encode_payload(p: dict) -> bytes:
    """The bytes of what decode_payload gives."""
    marker = FORMATS.index(p["format"]) + 1
    if marker == 1:
        body = struct.pack("<QIH", p["sample_time_ns"], p["sample_rate_hz"], len(p["readings"]))
        return bytes([marker]) + body + np.array([(x["channel"], x["value"], x["scale"], QUALITIES.index(x["quality"])) for x in p["readings"]], _READING).tobytes()
    if marker == 2:
        body = struct.pack("<QIHH", p["center_hz"], p["span_hz"], p["bin_width_hz"], len(p["bins"]))
        return bytes([marker]) + body + np.array([(x["power_x10"], x["noise_x10"]) for x in p["bins"]], _BIN).tobytes()
    if marker == 3:
        return bytes([marker]) + struct.pack("<HHII", p["command"], p["flags"], p["correlation_id"], len(p["body"])) + p["body"]
    bands = [b.encode() for b in p["bands"]]
    return bytes([marker]) + struct.pack("<HBH", p["max_payload"], p["compression"] | p["encryption"] << 1 | p["gps_time"] << 2, len(bands)) + b"".join(struct.pack("<H", len(b)) + b for b in bands)
