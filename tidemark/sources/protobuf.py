"""Fields of schema-less protobuf payloads, with the span of each, as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it; ValueError beyond 70 bits or the end."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number does not end")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, int | float | None, int, int]]:
    """(number, wire type, value, start, end) of each field; values of length-delimited fields are their span."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, wire = key >> 3, key & 7
        if not number:
            raise ValueError("field 0")
        value = None
        if wire == 0:
            start = at
            value, at = varint(data, at)
        elif wire in (1, 5):
            start, size = at, 8 if wire == 1 else 4
            at += size
            if at > len(data):
                raise ValueError("a field is cut short")
            (value,) = struct.unpack_from("<d" if wire == 1 else "<f", data, start)
        elif wire == 2:
            size, start = varint(data, at)
            at = start + size
            if at > len(data):
                raise ValueError("a field is cut short")
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value, start, at


def read_fields(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, number, wire, value (numbers), start and end of the fields of each binary payload."""
    kind = dict(payloads.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, w, None if v is None else float(v), a, b) for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if data is not None for n, w, v, a, b in fields(data)]
            if rows:
                types = [batch.column(0).type, pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[key, "number", "wire", "value", "start", "end"])

    return payloads.select(key, payload).mapInArrow(run, f"`{key}` {kind}, number int, wire int, value double, start long, end long")


def get(data: bytes, *path: int) -> bytes | int | float | None:
    """What the first field of each number leads to, level by level; None where one is not there."""
    found: bytes | int | float | None = data
    for number in path:
        found = next((data[a:b] if w == 2 else v for n, w, v, a, b in fields(data) if n == number), None)
        if not isinstance(found, bytes):
            return found if number == path[-1] else None
        data = found
    return found


def place(data: bytes, base: int, number: int) -> tuple[bytes, int] | None:
    """The first message of a number, and where it starts if data starts at base."""
    return next(((data[a:b], base + a) for n, w, _, a, b in fields(data) if n == number and w == 2), None)


def packed(data: bytes, kind: str = "float") -> list[int | float]:
    """The numbers of a packed field: 'float' (32 bits) or 'varint'."""
    if kind == "float":
        return [x for (x,) in struct.iter_unpack("<f", data[: len(data) // 4 * 4])]
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


#: Levels that a dump goes down to, and fields of one number and level that it tells.
DEPTH, REPEATS = 12, 3


def dump(data: bytes, depth: int = DEPTH, repeats: int = REPEATS, above: str = "") -> Iterator[tuple[str, str, int, str]]:
    """(path, kind, size, value) of the fields of a payload that no schema tells of.

    kind: varint, float, double, text, message or bytes. Messages come before their fields; nothing comes of a
    payload that is no message.
    """
    try:
        found = list(fields(data))
    except ValueError:
        return
    met: dict[int, int] = {}
    for number, wire, value, start, end in found:
        path, part = f"{above}.{number}" if above else str(number), data[start:end]
        met[number] = met.get(number, 0) + 1
        if wire != 2:
            yield path, {0: "varint", 1: "double", 5: "float"}[wire], end - start, str(value)
        elif met[number] <= repeats:
            if part and all(32 <= c < 127 or c in (9, 10, 13) for c in part):
                yield path, "text", len(part), part.decode("ascii")
            elif len(path.split(".")) <= depth and is_message(part):
                yield path, "message", len(part), ""
                yield from dump(part, depth, repeats, path)
            else:
                yield path, "bytes", len(part), part[:32].hex()


def is_message(data: bytes) -> bool:
    try:
        return sum(1 for _ in fields(data)) > 0
    except ValueError:
        return False


def read_dump(payloads: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, place (from 0), path, kind, size and value of the fields of each binary payload."""
    kinds = dict(payloads.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*key, i, *x) for *key, data in zip(*(c.to_pylist() for c in batch.columns)) if data is not None for i, x in enumerate(dump(data))]
            if rows:
                types = [*(batch.column(i).type for i in range(len(keys))), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[*keys, "place", "path", "kind", "size", "value"])

    return payloads.select(*keys, payload).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", place int, path string, kind string, size long, value string")
