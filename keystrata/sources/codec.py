"""The binary log: five record layouts, batches, and what counts as the end of a log.

Fixed values of the format, little-endian. A record is crc (4 bytes), version (1), the fields of its
version, key, value; crc is CRC-32 of all bytes after itself.

    version 0 or 1 (the byte is the type): key length 4, value length 4
    version 2: type 1, written 8, key length, value length
    version 3: type, written, expires 8, key length, value length
    version 4: type, written, number 8, key length, value length
    version 5: type, written, expires, number, key length, value length

A batch is a record of type 2 with an empty key, whose value is the byte length (8) of the records that
follow and belong to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from keystrata.schema import DELETED, MARKER, NORMAL

_FIELDS = {0: ("", ()), 1: ("", ()), 2: ("Bq", ("rtype", "ts_ns")), 3: ("Bqq", ("rtype", "ts_ns", "expires_ns")), 4: ("BqQ", ("rtype", "ts_ns", "seq")), 5: ("BqqQ", ("rtype", "ts_ns", "expires_ns", "seq"))}
_HEADERS = {v: (struct.Struct("<IB" + f + "II"), names) for v, (f, names) in _FIELDS.items()}
_SPAN = struct.Struct("<q")


class Corrupt(Exception):
    """The log cannot be read from `offset` on."""

    def __init__(self, offset: int):
        super().__init__(f"damaged at byte {offset}")
        self.offset = offset


@dataclass(frozen=True)
class Record:
    key: bytes
    value: bytes = b""
    rtype: int = NORMAL
    ts_ns: int = 0
    expires_ns: int = 0
    seq: int = 0
    version: int | None = None  # None: the narrowest that holds the fields

    @property
    def layout(self) -> int:
        if self.version is not None:
            return self.version
        return 2 + (1 if self.expires_ns else 0) + (2 if self.seq else 0)


def encode(record: Record) -> bytes:
    v = record.layout
    header, names = _HEADERS[v]
    version = record.rtype if v < 2 else v
    body = header.pack(0, version, *(getattr(record, n) for n in names), len(record.key), len(record.value)) + record.key + record.value
    return struct.pack("<I", zlib.crc32(body[4:])) + body[4:]


def encode_batch(records: Iterable[Record], ts_ns: int = 0, seq: int = 0) -> bytes:
    """A marker and its records; nothing for no records."""
    inner = b"".join(map(encode, records))
    return encode(Record(b"", _SPAN.pack(len(inner)), MARKER, ts_ns, 0, seq)) + inner if inner else b""


@dataclass(frozen=True)
class Decoded:
    pos: int
    next_pos: int
    record: Record
    crc: int
    good: bool  # whether the checksum holds
    batch_pos: int | None = None


def decode_at(data: bytes, pos: int, end: int | None = None) -> Decoded:
    """The record at pos, which must lie before end as a whole; its checksum is not demanded."""
    end = len(data) if end is None else end
    if pos + 5 > end or data[pos + 4] not in _HEADERS:
        raise Corrupt(pos)
    v = data[pos + 4]
    header, names = _HEADERS[v]
    if pos + header.size > end:
        raise Corrupt(pos)
    crc, _, *fields, key_length, value_length = header.unpack_from(data, pos)
    stop = pos + header.size + key_length + value_length
    if stop > end:
        raise Corrupt(pos)
    at = pos + header.size
    given = dict(zip(names, fields, strict=True)) or {"rtype": v}
    record = Record(bytes(data[at : at + key_length]), bytes(data[at + key_length : stop]), version=v, **given)
    return Decoded(pos, stop, record, crc, zlib.crc32(data[pos + 4 : stop]) == crc)


def walk(data: bytes, start: int = 0) -> Iterator[Decoded]:
    """The records of a log in order from the unit at `start` on, without markers; a batch comes as a whole or
    not at all. Raises Corrupt where the log cannot be followed; single records come whether their
    checksums hold or not."""
    pos = start
    while pos < len(data):
        d = decode_at(data, pos)
        if d.record.rtype != MARKER:
            yield d
            pos = d.next_pos
            continue
        span = _SPAN.unpack(d.record.value)[0] if len(d.record.value) == _SPAN.size and not d.record.key else 0
        stop = d.next_pos + span
        if span <= 0 or stop > len(data):
            raise Corrupt(pos)
        inside, at = [], d.next_pos
        while at < stop:
            try:
                r = decode_at(data, at, stop)
            except Corrupt:
                raise Corrupt(pos) from None
            if r.record.rtype == MARKER or not r.good:
                raise Corrupt(pos)
            inside.append(r)
            at = r.next_pos
        for r in inside:
            yield Decoded(r.pos, r.next_pos, r.record, r.crc, True, pos)
        pos = stop


def good_prefix(data: bytes) -> tuple[list[Decoded], int]:
    """What recovery keeps: the records before the first that is damaged in any way, and how many bytes they fill."""
    kept: list[Decoded] = []
    end = 0
    try:
        for d in walk(data):
            if not d.good:
                return kept, d.pos
            kept.append(d)
            end = d.next_pos
    except Corrupt as e:
        return kept, e.offset
    return kept, end


__all__ = ["DELETED", "Corrupt", "Decoded", "Record", "decode_at", "encode", "encode_batch", "good_prefix", "walk"]
