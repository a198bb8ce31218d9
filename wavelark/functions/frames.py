"""Many frames at once: the codec's packets without sections as columns.

Frames that have sections, or are damaged, go through the codec one by one; the
rest share a fixed head, so that numpy decodes and encodes them together.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from . import codec as C
from .udfs import packet_row

#: A frame without sections up to its payload, and what it has besides.
HEAD = np.dtype(
    [("magic", "<u4"), ("size", "<u4"), ("version", "u1"), ("kind", "u1"), ("device", "<i8"), ("timestamp_ns", "<i8"), ("sequence", "<u4"), ("compression", "u1"), ("encryption", "u1"), ("sections", "<u4"), ("end", "u1"), ("payload", "<u4")]
)
BESIDES = HEAD.itemsize + 4
_NUMBERS = ("version", "device", "timestamp_ns", "sequence", "compression", "encryption")
_NONE = b"\0" * HEAD.itemsize


class Decoded:
    """Frames (null: none) as columns; what packet_row gives of each."""

    def __init__(self, frames: list[bytes | None]):
        n, self.frames = len(frames), frames
        self.lengths = np.fromiter((0 if f is None else len(f) for f in frames), np.int64, n)
        whole = self.lengths >= BESIDES
        heads = np.frombuffer(b"".join([f[: HEAD.itemsize] if w else _NONE for f, w in zip(frames, whole, strict=True)]), HEAD)
        stated = np.frombuffer(b"".join([f[-4:] if w else b"\0" * 4 for f, w in zip(frames, whole, strict=True)]), "<u4")
        sums = C.crc32c_many([b"" if f is None else f[:-4] for f in frames])
        plain = whole & (heads["magic"] == C.PACKET_MAGIC) & (heads["size"] + np.int64(12) == self.lengths) & (self.lengths <= C.MAX_PACKET) & (sums == stated)
        plain &= (heads["version"] >= 1) & (heads["version"] <= 3) & (heads["kind"] >= 1) & (heads["kind"] <= len(C.KINDS))
        plain &= (heads["sections"] == 1) & (heads["end"] == 0) & (heads["payload"] + np.int64(BESIDES) == self.lengths)
        self.heads, self.plain = heads, plain
        self.rest = {int(i): packet_row(frames[i], int(sums[i])) for i in np.flatnonzero(~plain)}
        self.ok = plain.copy()
        for i, p in self.rest.items():
            self.ok[i] = p["ok"]

    def sizes(self) -> np.ndarray:
        """Bytes of payloads; 0 where there is no packet."""
        out = np.where(self.plain, self.lengths - BESIDES, 0)
        for i, p in self.rest.items():
            out[i] = len(p["payload"]) if p["ok"] else 0
        return out

    def numbers(self, name: str) -> np.ndarray:
        out = self.heads[name].astype(np.int64)
        for i, p in self.rest.items():
            out[i] = p[name] if p["ok"] else 0
        return out

    def errors(self) -> list[str | None]:
        out: list[str | None] = [None] * len(self.frames)
        for i, p in self.rest.items():
            out[i] = p["error"]
        return out

    def column(self, name: str, kind: pa.DataType) -> pa.Array:
        """A field of PACKET, or payload_size, as an array of a type."""
        if name == "ok":
            return pa.array(self.ok)
        if name == "error":
            return pa.array(self.errors(), kind)
        if name == "payload_size":
            return pa.array(self.sizes(), mask=~self.ok).cast(kind)
        if name in _NUMBERS:
            return pa.array(self.numbers(name), mask=~self.ok).cast(kind)
        if name == "kind":
            ranks = self.heads["kind"].astype(np.int64) - 1
            for i, p in self.rest.items():
                ranks[i] = C.KINDS.index(p["kind"]) if p["ok"] else 0
            return pa.array(C.KINDS, kind).take(pa.array(ranks, mask=~self.ok))
        if name == "payload":
            out = [f[HEAD.itemsize : -4] if q else None for f, q in zip(self.frames, self.plain, strict=True)]
            for i, p in self.rest.items():
                out[i] = p["payload"]
            return pa.array(out, kind)
        empty = [] if name == "extensions" else None
        if empty is None and not any(p[name] is not None for p in self.rest.values()):
            return pa.nulls(len(self.frames), kind)
        cells = [empty] * len(self.frames)
        for i, p in self.rest.items():
            cells[i] = p[name]
        return pa.array(cells, kind)


def encoded(kinds: Iterable[str], devices: np.ndarray, times: np.ndarray, sequences: np.ndarray, payloads: list[bytes]) -> list[bytes]:
    """Frames of version 3 without sections."""
    heads = np.zeros(len(payloads), HEAD)
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    rank = {k: i + 1 for i, k in enumerate(C.KINDS)}
    heads["magic"], heads["size"], heads["version"], heads["kind"] = C.PACKET_MAGIC, sizes + (BESIDES - 12), 3, [rank[k] for k in kinds]
    heads["device"], heads["timestamp_ns"], heads["sequence"], heads["sections"], heads["payload"] = devices, times, sequences, 1, sizes
    data, step = heads.tobytes(), HEAD.itemsize
    bodies = [data[i * step : (i + 1) * step] + p for i, p in enumerate(payloads)]
    return with_sums(bodies)


def with_sums(bodies: list[bytes]) -> list[bytes]:
    """Bytes with their checksum behind them."""
    sums = C.crc32c_many(bodies).astype("<u4").tobytes()
    return [b + sums[4 * i : 4 * i + 4] for i, b in enumerate(bodies)]


def sealed(times: list[int], frames: list[bytes]) -> list[bytes]:
    """Archive records of frames."""
    heads = np.zeros(len(frames), np.dtype([("time", "<i8"), ("size", "<u4")]))
    heads["time"], heads["size"] = times, np.fromiter(map(len, frames), np.int64, len(frames))
    data = heads.tobytes()
    return with_sums([data[12 * i : 12 * i + 12] + f for i, f in enumerate(frames)])
