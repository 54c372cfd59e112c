"""Joining Parquet files by copying their encoded column blocks.

Column chunks are copied byte by byte into a larger file and only the footer is written anew: the
row groups' metadata is decoded from its compact binary form, its offsets are moved, and all else
is kept as it was. Nothing is decompressed or decoded, so the cost is that of copying bytes.
"""

import struct
from collections.abc import Iterable
from dataclasses import dataclass

MAGIC = b"PAR1"

# Compact-protocol type numbers.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class _Reader:
    """Decodes a compact-protocol struct into [(field id, type, value)], keeping unknown fields."""

    def __init__(self, data: bytes):
        self.b, self.i = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            x = self.b[self.i]
            self.i += 1
            out |= (x & 127) << shift
            if x < 128:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            self.i += 1
            return self.b[self.i - 1]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            self.i += 8
            return self.b[self.i - 8 : self.i]
        if kind == BINARY:
            n = self.varint()
            self.i += n
            return self.b[self.i - n : self.i]
        if kind in (LIST, SET):
            head = self.b[self.i]
            self.i += 1
            n, of = head >> 4, head & 15
            n = self.varint() if n == 15 else n
            if of in (TRUE, FALSE):
                self.i += n
                return of, [self.b[self.i - n + k] for k in range(n)]
            return of, [self.value(of) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            if not n:
                return 0, 0, []
            kinds = self.b[self.i]
            self.i += 1
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown type {kind} in a footer")

    def struct(self) -> list:
        out, last = [], 0
        while (head := self.b[self.i]) != 0:
            self.i += 1
            kind, delta = head & 15, head >> 4
            last = last + delta if delta else self.zigzag()
            out.append([last, kind, self.value(kind)])
        self.i += 1
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint((n << 1) ^ (n >> 63))


def _write_value(kind: int, v) -> bytes:
    if kind in (TRUE, FALSE):
        return b""
    if kind == BYTE:
        return bytes([v])
    if kind in (I16, I32, I64):
        return _zigzag(v)
    if kind == DOUBLE:
        return v
    if kind == BINARY:
        return _varint(len(v)) + v
    if kind in (LIST, SET):
        of, xs = v
        head = bytes([len(xs) << 4 | of]) if len(xs) < 15 else bytes([0xF0 | of]) + _varint(len(xs))
        return head + (bytes(xs) if of in (TRUE, FALSE) else b"".join(_write_value(of, x) for x in xs))
    if kind == MAP:
        a, b, xs = v
        return _varint(len(xs)) + (bytes([a << 4 | b]) + b"".join(_write_value(a, x) + _write_value(b, y) for x, y in xs) if xs else b"")
    return v if isinstance(v, bytes) else _write_struct(v)


def _write_struct(fields: list) -> bytes:
    out, last = [], 0
    for at, kind, v in fields:
        kind = (TRUE if v else FALSE) if kind in (TRUE, FALSE) else kind
        delta = at - last
        out.append(bytes([delta << 4 | kind]) if 0 < delta <= 15 else bytes([kind]) + _zigzag(at))
        out.append(_write_value(kind, v))
        last = at
    return b"".join(out) + b"\0"


def _get(fields: list, at: int, default=None):
    return next((f[2] for f in fields if f[0] == at), default)


def _set(fields: list, at: int, value) -> None:
    for f in fields:
        if f[0] == at:
            f[2] = value


@dataclass
class Footer:
    """A file's metadata: fields 2 schema, 3 row count, 4 row groups, 5 key-value pairs."""

    fields: list

    @property
    def schema(self) -> bytes:
        return _write_value(LIST, _get(self.fields, 2))

    @property
    def rows(self) -> int:
        return _get(self.fields, 3)

    @property
    def groups(self) -> list:
        return _get(self.fields, 4, (STRUCT, []))[1]

    @property
    def pairs(self) -> bytes:
        """The key-value pairs that readers interpret (logical schemas), as bytes."""
        kv = _get(self.fields, 5)
        return _write_value(LIST, kv) if kv else b""


def read_footer(f) -> Footer:
    """The footer of an open file; ValueError if it isn't a whole Parquet file."""
    f.seek(0, 2)
    size = f.tell()
    if size < 12:
        raise ValueError("too short for a Parquet file")
    f.seek(0)
    head = f.read(4)
    f.seek(size - 8)
    n, magic = struct.unpack("<I4s", f.read(8))
    if head != MAGIC or magic != MAGIC or n + 12 > size:
        raise ValueError("not a whole, unencrypted Parquet file")
    f.seek(size - 8 - n)
    foot = Footer(_Reader(f.read(n)).struct())
    for g in foot.groups:
        for col in _get(g, 1)[1]:
            if (meta := _get(col, 3)) is not None:
                start, length = _chunk_range(meta)
                if length and start < 4 or length < 0 or start + length > size - 8 - n:
                    raise ValueError("a column chunk reaches beyond the data")
    return foot


def _chunk_range(meta: list) -> tuple[int, int]:
    """Start and length of a column chunk's pages."""
    data, dictionary = _get(meta, 9), _get(meta, 11)
    return min(x for x in (data, dictionary) if x) if data or dictionary else 0, _get(meta, 7)


def concat_files(sources: Iterable, target) -> dict:
    """Writes the row groups of the open files `sources` into `target`; returns what was validated.

    Each file is done with before the next is asked for, so an iterator may open them one by one. Of
    the blocks copied only their new metadata, as bytes, are kept until the end.

    All files must have one schema (and one set of key-value pairs, which hold readers' schemas).
    Page indexes and bloom filters are optional and aren't carried over. Checked: row groups and
    rows written equal those read, and every block is copied whole.
    """
    first, groups, rows, copied = None, [], 0, 0
    target.write(MAGIC)
    at = len(MAGIC)
    expected_groups = expected_rows = 0
    for f in sources:
        foot = read_footer(f)
        if first is None:
            first = foot
        elif foot.schema != first.schema or foot.pairs != first.pairs:
            raise ValueError("the files differ in their schemas")
        expected_rows += foot.rows
        expected_groups += len(foot.groups)
        for g in foot.groups:
            begin = at
            for col in _get(g, 1)[1]:
                meta = _get(col, 3)
                if meta is None or _get(col, 1):
                    raise ValueError("a column chunk lies outside its file")
                start, length = _chunk_range(meta)
                f.seek(start)
                left = length
                while left:
                    part = f.read(min(left, 1 << 20))
                    if not part:
                        raise ValueError("a column chunk is cut short")
                    target.write(part)
                    left -= len(part)
                for k in (9, 10, 11):
                    if v := _get(meta, k):
                        _set(meta, k, v - start + at)
                meta[:] = [x for x in meta if x[0] not in (14, 15)]
                col[:] = [x for x in col if x[0] not in (4, 5, 6, 7)]
                _set(col, 2, at)
                at += length
                copied += length
            _set(g, 5, begin)
            if _get(g, 7) is not None:
                _set(g, 7, len(groups) & 0x7FFF)
            rows += _get(g, 3)
            groups.append(_write_struct(g))
    if first is None:
        raise ValueError("no file to copy from")
    if rows != expected_rows or len(groups) != expected_groups:
        raise ValueError(f"{rows} rows in {len(groups)} blocks, {expected_rows} in {expected_groups} expected")
    fields = [f for f in first.fields if f[0] <= 7]
    _set(fields, 3, rows)
    _set(fields, 4, (STRUCT, groups))
    foot = _write_struct(fields)
    target.write(foot + struct.pack("<I", len(foot)) + MAGIC)
    return {"rows": rows, "blocks": len(groups), "bytes": at + len(foot) + 8, "copied": copied}
