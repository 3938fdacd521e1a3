"""A small EXIF reader: the first directories of a TIFF block, alone or in a JPEG's APP1 segment.

Bytes may be a ``Seeking`` view of a file, of which only the parts that are asked for are read, wherever they stand."""

from __future__ import annotations

import struct

# TIFF tags and the sizes of their types.
IFD0 = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "modified"}
SUB = {0x9003: "original", 0xA431: "serial"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class Seeking:
    """A file's bytes by offset: the first ``head`` once, others as they are asked for."""

    def __init__(self, read_at, size: int, head: int = 1 << 16):
        self.read_at, self.size = read_at, size
        self.head = read_at(min(head, size), 0)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at : at + 1][0]
        lo, hi, _ = at.indices(self.size)
        return self.head[lo:hi] if hi <= len(self.head) else self.read_at(hi - lo, lo) if hi > lo else b""


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF block of a file: from an APP1 segment, or the file itself if it is TIFF-like."""
    if data[:4] in (b"II*\0", b"MM\0*", b"IIU\0", b"IIRO", b"IIRS"):
        return data
    at = 2 if data[:2] == b"\xff\xd8" else None
    while at is not None and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker in (0xDA, 0xD9):
            return None
        at += 2 + size
    return None


def _value(block: bytes, order: str, kind: int, count: int, raw: bytes):
    size = SIZES.get(kind, 0) * count
    if not size or size > 1 << 16:
        return None
    if size > 4:
        at = struct.unpack(order + "I", raw)[0]
        raw = block[at : at + size]
        if len(raw) < size:
            return None
    raw = raw[:size]
    if kind in (2, 7, 1):
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        n = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
        return [a / b if b else 0.0 for a, b in zip(n[::2], n[1::2])]
    n = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw)
    return n[0] if count == 1 else list(n)


def _directory(block: bytes, order: str, at: int, names: dict[int, str], links: dict[int, str]) -> dict:
    out = {}
    if at + 2 > len(block):
        return out
    n = struct.unpack(order + "H", block[at : at + 2])[0]
    for k in range(n):
        entry = block[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if tag in names or tag in links:
            out[names.get(tag) or links[tag]] = _value(block, order, kind, count, entry[8:])
    return out


def read(data: bytes) -> dict:
    """make, model, serial, timestamp, orientation, lat, lat_ref, lon, lon_ref; absent keys are unknown.
    Damaged blocks give what could be read."""
    try:
        block = tiff_block(data)
        if not block or len(block) < 8:
            return {}
        order = "<" if block[:2] == b"II" else ">"
        first = _directory(block, order, struct.unpack(order + "I", block[4:8])[0], IFD0, {0x8769: "sub", 0x8825: "gps"})
        out = {k: first[k] for k in ("make", "model", "orientation") if first.get(k)}
        sub = _directory(block, order, first["sub"], SUB, {}) if isinstance(first.get("sub"), int) else {}
        if sub.get("serial"):
            out["serial"] = sub["serial"]
        if sub.get("original") or first.get("modified"):
            out["timestamp"] = sub.get("original") or first["modified"]
        if isinstance(first.get("gps"), int):
            gps = _directory(block, order, first["gps"], GPS, {})
            out |= {k: v for k, v in gps.items() if v and (k.endswith("ref") or isinstance(v, list))}
        return out
    except (struct.error, KeyError, TypeError):
        return {}
