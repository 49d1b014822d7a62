"""Arrays zipped in a file (npz) as rows, and rows as such files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from ..operators.groups import whole_groups

#: Rows that are read from each member of a file at once.
BLOCK = 1 << 14

_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}
_FORMAT = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}


def _header(member: BinaryIO) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(member)
    if version not in _FORMAT:
        raise ValueError(f"array format {version}")
    shape, by_column, dtype = _FORMAT[version](member)
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return shape, by_column, dtype


def _blocks(member: BinaryIO, rows: int) -> Iterator[np.ndarray]:
    """The array's rows, some at a time, whose further dimensions are one; an array by columns is read whole."""
    shape, by_column, dtype = _header(member)
    n, width = (shape[0] if shape else 1), int(np.prod(shape[1:], dtype=np.int64))
    flat = len(shape) < 2
    whole = None
    if by_column and not flat:
        whole = np.frombuffer(member.read(n * width * dtype.itemsize), dtype).reshape(shape, order="F").reshape(n, width)
    for k in range(0, n, rows):
        size = min(rows, n - k)
        if whole is not None:
            part = whole[k : k + size]
        else:
            data = member.read(size * width * dtype.itemsize)
            if len(data) < size * width * dtype.itemsize:
                raise ValueError("an array is cut short")
            part = np.frombuffer(data, dtype).reshape((size,) if flat else (size, width)) if dtype.itemsize else np.zeros((size,) if flat else (size, width), dtype)
        yield part.astype(part.dtype.newbyteorder("="))


def _values(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if x.dtype.kind in "US":
        x = np.array([v.decode() if isinstance(v, bytes) else v for v in x.tolist()], object)
    return pa.array(x, from_pandas=True).cast(kind)


def _column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        if x.ndim > 1:
            raise ValueError("a member with rows of several values needs an array column")
        return _values(x, kind)
    rows = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * rows.shape[1]), _values(rows.reshape(-1), kind.value_type))


def _arrow_types(schema: str) -> dict[str, pa.DataType]:
    fields = StructType.fromDDL(schema).fields
    return {f.name: pa.list_(_ARROW[f.dataType.elementType.simpleString()]) if isinstance(f.dataType, ArrayType) else _ARROW[f.dataType.simpleString()] for f in fields}


def members_of(contents: DataFrame) -> DataFrame:
    """file, member, dtype, shape and by_column of each array of npz files (path, content), from their headers alone."""
    schema = pa.schema([("file", pa.string()), ("member", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("by_column", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for name in z.namelist():
                        with z.open(name) as member:
                            shape, by_column, dtype = _header(member)
                        rows.append({"file": file, "member": name.removesuffix(".npy"), "dtype": dtype.str, "shape": list(shape), "by_column": by_column})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return contents.select("path", "content").mapInArrow(run, "file string, member string, dtype string, shape array<long>, by_column boolean")


def rows_of(contents: DataFrame, schema: str) -> DataFrame:
    """file, place (from 0) and the members that schema names, of npz files (path, content), a row for each of their rows.

    Only those members are unzipped, a block of rows at a time. Types are boolean, int, bigint, float, double and string, and arrays of these for members
    of two dimensions or more, whose further ones become one. NaN is null. A member that a file lacks is null; a file without any has no
    rows. An error where members differ in length, hold objects, or do not fit their type without loss.
    """
    types = _arrow_types(schema)
    whole = pa.schema([("file", pa.string()), ("place", pa.int64()), *types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    there = [n for n in types if f"{n}.npy" in z.namelist()]
                    if not there:
                        continue
                    opened = [z.open(f"{n}.npy") for n in there]
                    at = 0
                    try:
                        for parts in zip(*(_blocks(m, BLOCK) for m in opened), strict=True):
                            n = len(parts[0])
                            if any(len(p) != n for p in parts):
                                raise ValueError(f"{file}: arrays differ in length")
                            named = {name: _column(p, types[name]) for name, p in zip(there, parts)}
                            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(at, at + n)), *(named[k] if k in named else pa.nulls(n, t) for k, t in types.items())], schema=whole)
                            at += n
                    finally:
                        for m in opened:
                            m.close()

    return contents.select("path", "content").mapInArrow(run, f"file string, place long, {schema}")


def files_of(df: DataFrame, key: str, order: list[str], columns: list[str], compressed: bool = True) -> DataFrame:
    """path (the key, a string) and content: an npz file of the columns of each key's rows in order. A key's rows must fit into a task.

    A missing number is NaN, for which whole numbers become doubles; a missing flag or string is an error. Arrays must be of one length in a file.
    """

    def array(c: pa.ChunkedArray) -> np.ndarray:
        if pa.types.is_list(c.type):
            return np.array([np.array(v, c.type.value_type.to_pandas_dtype()) for v in c.to_pylist()])
        if pa.types.is_string(c.type) or pa.types.is_boolean(c.type):
            if c.null_count:
                raise ValueError("a missing flag or string has no form in an array")
            return np.array(c.to_pylist(), bool if pa.types.is_boolean(c.type) else str)
        return c.to_numpy()

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for i, j in zip(starts, np.append(starts[1:], table.num_rows)):
            body = io.BytesIO()
            (np.savez_compressed if compressed else np.savez)(body, **{c: array(table[c].slice(i, j - i)) for c in columns})
            out.append(body.getvalue())
        return pa.table({"path": table[key].take(pa.array(starts)), "content": pa.array(out, pa.binary())})

    return whole_groups(df.select(key, *order, *(c for c in columns if c not in (key, *order))), [key], order, run, "path string, content binary")
