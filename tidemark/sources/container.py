"""Spark data sources over ISO base media files: their boxes, and the sample tables of their tracks.

A reading task opens the files of its partition through Spark's own binary reader, so any store that Spark
knows will do; what is computed from the tables - offsets and times of samples - are window sums
(sample_offsets, sample_times), not loops over samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Boxes that hold boxes, and the bytes of a version and flags before those of one kind.
CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl", "edts", "udta", "meta", "dinf", "moof", "traf")
FULL_CONTAINER = {"meta": 4}


def boxes(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int, int]]:
    """(path, offset, size, header size) of all boxes; a box that reaches beyond its parent ends the walk there."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        name = kind.decode("latin-1")
        yield f"{path}/{name}", start, size, head
        if name in CONTAINERS:
            yield from boxes(data, start + head + FULL_CONTAINER.get(name, 0), start + size, f"{path}/{name}")
        start += size


def _table(data: bytes, at: int, head: int, width: int, lead: int = 4) -> list[tuple]:
    """The rows of a table box: a count, then rows of `width` big-endian 32-bit numbers."""
    (count,) = struct.unpack_from(">I", data, at + head + lead)
    return [struct.unpack_from(f">{width}I", data, at + head + lead + 4 + 4 * width * i) for i in range(count)]


def tracks(data: bytes) -> list[dict]:
    """For each track its number, formats, time scale, handler, and the rows of its sample tables.

    chunks: (number, offset); runs: (first chunk, samples a chunk); times: (count, step); sizes: one a sample.
    """
    out: list[dict] = []
    for path, at, size, head in boxes(data):
        kind = path.rsplit("/", 1)[1]
        if kind == "trak":
            out.append({"id": None, "formats": [], "scale": None, "handler": None, "chunks": [], "runs": [], "times": [], "sizes": []})
        elif not out:
            continue
        elif kind == "tkhd":
            out[-1]["id"] = struct.unpack_from(">I", data, at + head + (20 if data[at + head] == 1 else 12))[0]
        elif kind == "stsd":
            (count,), entry = struct.unpack_from(">I", data, at + head + 4), at + head + 8
            for _ in range(count):
                length, name = struct.unpack_from(">I4s", data, entry)
                out[-1]["formats"].append(name.decode("latin-1"))
                entry += length
        elif kind == "mdhd":
            out[-1]["scale"] = struct.unpack_from(">I", data, at + head + (20 if data[at + head] == 1 else 12))[0]
        elif kind == "hdlr" and out[-1]["handler"] is None:
            out[-1]["handler"] = data[at + head + 8 : at + head + 12].decode("latin-1")
        elif kind == "stsz":
            fixed, count = struct.unpack_from(">II", data, at + head + 4)
            out[-1]["sizes"] = [fixed] * count if fixed else list(struct.unpack_from(f">{count}I", data, at + head + 12))
        elif kind == "stz2":
            raise ValueError("compact sample sizes are not supported")
        elif kind == "stco":
            out[-1]["chunks"] = [(i + 1, x[0]) for i, x in enumerate(_table(data, at, head, 1))]
        elif kind == "co64":
            out[-1]["chunks"] = [(i + 1, (x[0] << 32) | x[1]) for i, x in enumerate(_table(data, at, head, 2))]
        elif kind == "stsc":
            out[-1]["runs"] = [x[:2] for x in _table(data, at, head, 3)]
        elif kind == "stts":
            out[-1]["times"] = _table(data, at, head, 2)
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files under path. Spark reads files of up to 2 GB so, each as one row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """boxes_of() of the files under path."""
    return boxes_of(files(spark, path))


def boxes_of(contents: DataFrame, bodies: tuple[str, ...] = ()) -> DataFrame:
    """file, box (its path of names), offset, size, header, and body if the box is one of bodies, of each box.

    contents: path and content, one row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                rows = [(file, name, at, size, head, data[at + head : at + size] if name in bodies else None) for name, at, size, head in boxes(data)]
                if rows:
                    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["file", "box", "offset", "size", "header", "body"])

    return contents.select("path", "content").mapInArrow(run, "file string, box string, offset long, size long, header long, body binary")


_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """tracks_of() of the files under path."""
    return tracks_of(files(spark, path))


def tracks_of(contents: DataFrame) -> DataFrame:
    """file, track, id, formats, scale, handler and the sample tables (arrays of pairs a, b; sizes) of each track."""
    fields = pa.schema([("file", pa.string()), ("track", pa.int32()), ("id", pa.int64()), ("formats", pa.list_(pa.string())), ("scale", pa.int64()), ("handler", pa.string()), ("chunks", _PAIRS), ("runs", _PAIRS), ("times", _PAIRS), ("sizes", pa.list_(pa.int64()))])
    pairs = "array<struct<a: long, b: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [{"file": file, "track": i, **t, **{k: [dict(zip("ab", x)) for x in t[k]] for k in ("chunks", "runs", "times")}} for i, t in enumerate(tracks(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return contents.select("path", "content").mapInArrow(run, f"file string, track int, id long, formats array<string>, scale long, handler string, chunks {pairs}, runs {pairs}, times {pairs}, sizes array<long>")


def sample_offsets(found: DataFrame) -> DataFrame:
    """file, track, sample, offset and size: samples fill the chunks in order, each chunk from its own offset."""
    key = ["file", "track"]
    chunk = found.select(*key, F.explode("chunks").alias("c")).select(*key, F.col("c.a").alias("chunk"), F.col("c.b").alias("base"))
    run = found.select(*key, F.explode("runs").alias("r")).select(*key, F.col("r.a").alias("chunk"), F.col("r.b").alias("n"))
    by = Window.partitionBy(*key).orderBy("chunk")
    counted = chunk.join(run, [*key, "chunk"], "left").withColumn("n", F.last("n", ignorenulls=True).over(by))
    counted = counted.withColumn("first", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = counted.select(*key, "chunk", "base", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("_p", "sample"))
    sized = found.select(*key, F.posexplode("sizes").alias("sample", "size")).withColumn("sample", F.col("sample").cast("long"))
    within = Window.partitionBy(*key, "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(sized, [*key, "sample"]).select(*key, "sample", (F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("offset"), "size")


def sample_times(found: DataFrame) -> DataFrame:
    """file, track, sample and t, in seconds: the steps of the samples before."""
    key = ["file", "track"]
    runs = found.select(*key, "scale", F.posexplode("times").alias("i", "t"))
    each = runs.select(*key, "scale", "i", F.col("t.b").alias("step"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("t.a"))).alias("k"))
    by = Window.partitionBy(*key).orderBy("i", "k")
    ticks = F.coalesce(F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select(*key, (F.row_number().over(by) - 1).cast("long").alias("sample"), (ticks / F.col("scale")).alias("t"))


def packets_of(contents: DataFrame, form: str) -> DataFrame:
    """file, sample, t (seconds; null beyond the table of times), offset and payload of each packet of the first track of
    a format in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                track = next((t for t in tracks(data) if t["formats"][:1] == [form]), None)
                rows = [(file, i, None if ticks is None else ticks / track["scale"], at, data[at : at + size]) for i, (ticks, at, size) in enumerate(_packets(track))] if track else []
                if rows:
                    types = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["file", "sample", "t", "offset", "payload"])

    return contents.select("path", "content").mapInArrow(run, "file string, sample long, t double, offset long, payload binary")


def _packets(track: dict) -> Iterator[tuple[int | None, int, int]]:
    """(ticks, offset, size) of each sample of a track, as sample_offsets() and sample_times() tell for many."""
    steps = (step for count, step in track["times"] for _ in range(count))
    ticks, sample, runs, per = 0, 0, dict(track["runs"]), 0
    for chunk, at in track["chunks"]:
        per = runs.get(chunk, per)
        for size in track["sizes"][sample : sample + per]:
            step = next(steps, None)
            yield (ticks if step is not None else None), at, size
            ticks, at, sample = ticks + (step or 0), at + size, sample + 1
