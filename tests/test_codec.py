"""Byte vectors, round trips and damage."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelark.functions import codec as C

FRAMES = (
    "4154484e2100000003012a00000000000000e803000000000000070000000000010000000000000000bf154917",
    "4154484e4700000003032a000000000000000000000000000000090000000000230000000108005000000001000200020a0007000c0003020400050004070084030300010203000400000008060705c0805a85",
    "4154484e2d0000000305050000000000000000000000000000000100000000000d0000000309000300100103007568660000000000df0869e9",
)
PAYLOADS = ("0164000000000000000a000000010007007b000000000000", "020018dd190000000080841e00102702002cfcf0fb94fdf0fb", "03010000000700000002000000aabb", "0400100501000300756866")
h = bytes.fromhex


def test_checksums():
    assert C.crc32c(b"") == 0xFFFFFFFF and C.crc32c(b"123456789") == 0xA71C05DF
    assert C.crc16_ccitt(b"123456789") == 0x29B1
    rows = [b"", b"123456789", b"\0\0a", b"x" * 100]
    assert C.crc32c_many(rows).tolist() == [C.crc32c(r) for r in rows]


@pytest.mark.parametrize("frame", FRAMES)
def test_frames(frame):
    assert C.encode_packet(C.decode_packet(h(frame))) == h(frame)
    for i in range(len(h(frame))):
        bad = bytearray(h(frame))
        bad[i] ^= 1
        with pytest.raises(C.WireError):
            C.decode_packet(bytes(bad))
    with pytest.raises(C.WireError):
        C.decode_packet(h(frame)[:-1])


def resealed(frame, at, value):
    bad = bytearray(frame[:-4])
    bad[at] = value
    return bytes(bad) + struct.pack("<I", C.crc32c(bytes(bad)))


def test_rejects():
    for at, value, code in ((8, 0, "unsupported_version"), (8, 4, "unsupported_version"), (9, 6, "malformed_packet")):
        with pytest.raises(C.WireError) as e:
            C.decode_packet(resealed(h(FRAMES[0]), at, value))
        assert e.value.code == code


@pytest.mark.parametrize("payload", PAYLOADS)
def test_payloads(payload):
    assert C.encode_payload(C.decode_payload(h(payload))) == h(payload)
    with pytest.raises(C.WireError):
        C.decode_payload(h(payload) + b"x")


def test_envelope_and_tlv():
    plain, key, sealed = h("010101020303030304"), h("41455448"), h("94b12cf2494044564b4246574c")
    assert C.seal(plain, key, 3) == sealed and C.unseal(sealed, key, 3) == plain
    with pytest.raises(C.WireError):
        C.unseal(sealed, b"other", 3)
    fields = [(10, b"east collector"), (11, b"\7")]
    assert C.parse_tlv(h("0a000e006561737420636f6c6c6563746f720b00010007")) == fields and C.parse_tlv(C.encode_tlv(fields)) == fields
    assert C.tlv_unsigned(b"\7") == 7 and C.tlv_text(b"abc") == "abc"


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_rle_round_trip(data):
    assert C.rle_decompress(C.rle_compress(data)) == data


def test_rle_rejects():
    assert C.rle_compress(h("010101020303030304")) == h("0301010204030104")
    for bad in (b"\1", b"\xff\0" * 5000):
        with pytest.raises(C.WireError):
            C.rle_decompress(bad)


def test_batch():
    frames = [h(f) for f in FRAMES]
    assert len(C.decode_batch(C.encode_batch(frames))) == 3
    with pytest.raises(C.WireError):
        C.decode_batch(C.encode_batch(frames) + b"x")
