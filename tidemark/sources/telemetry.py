"""Telemetry of recordings: clip headers, frames and attitude samples from the packets of a metadata track.

A packet is a protobuf payload. What is in it is read where the packet is; times, the order of samples and
the sign of their rotations are column expressions and windows over all packets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from . import container
from . import protobuf as P

# Formats of the two metadata tracks, and field numbers.
FORMAT, REFERENCE_FORMAT = "djmd", "dbgi"
CLIP, STREAM, FRAME = 1, 2, 3
HEADER_FIELDS = {1: "proto_file", 2: "library_version", 3: "product_version", 5: "serial", 6: "firmware", 9: "clip_stamp", 10: "product"}
CLIP_FIELDS = {"readout_ns": (4, 1), "read_direction": (5, 1), "focal_length": (8, 1), "stabilised": (9, 1), "imu_hz": (10, 1), "sensor_fps": (11, 1)}
DISTORTION, VIDEO_SIZE, VIDEO_FPS = (3, 1), ((3, 1), (3, 2)), (3, 3)
FRAME_STAMP, ATTITUDE = (1, 2), (3, 2)
STAMP, VSYNC, QUATERNION, OFFSET = 1, 2, 3, 4
REFERENCE = (2, 1, 11, 7, 4)


def _number(x) -> float | None:
    return None if x is None or isinstance(x, bytes) else float(x)


def clips(packets: DataFrame) -> DataFrame:
    """A row for each file, from its first packet: what the header says, and fps_ratio (video over sensor)."""
    numbers = [*CLIP_FIELDS, "width", "height", "fps"]
    schema = pa.schema([("file", pa.string()), *((x, pa.string()) for x in HEADER_FIELDS.values()), *((x, pa.float64()) for x in numbers), ("distortion", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clip, stream = P.get(data, CLIP) or b"", P.get(data, STREAM) or b""
                head = P.get(clip, 1) or b""
                row = {"file": file, "distortion": P.packed(P.get(clip, *DISTORTION) or b"") or None}
                for n, w, v, a, b in P.fields(head):
                    if n in HEADER_FIELDS:
                        row[HEADER_FIELDS[n]] = head[a:b].decode("utf-8", "replace") if w == 2 else str(v)
                row |= {x: _number(P.get(clip, *path)) for x, path in CLIP_FIELDS.items()}
                row |= dict(zip(("width", "height", "fps"), (_number(P.get(stream, *x)) for x in (*VIDEO_SIZE, VIDEO_FPS))))
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    columns = ", ".join([f"{x} string" for x in ("file", *HEADER_FIELDS.values())] + [f"{x} double" for x in numbers] + ["distortion array<double>"])
    found = packets.where("sample = 0").select("file", "payload").mapInArrow(run, columns)
    return found.withColumn("fps_ratio", F.try_divide("fps", "sensor_fps"))


def frames(packets: DataFrame) -> DataFrame:
    """file, frame, t, stamp, imu_stamp, vsync, sample_offset and quats (w, x, y, z and the place of the record in the file) of
    each packet with a stamp and an attitude."""
    quat = pa.struct([*((k, pa.float64()) for k in "wxyz"), ("at", pa.int64())])
    schema = pa.schema([("file", pa.string()), ("frame", pa.int64()), ("t", pa.float64()), ("stamp", pa.int64()), ("imu_stamp", pa.int64()), ("vsync", pa.int64()), ("sample_offset", pa.float64()), ("quats", pa.list_(quat))])

    def one(file, frame, t, base, data):
        whole = P.place(data, base, FRAME)
        stamp = P.get(whole[0], *FRAME_STAMP) if whole else None
        part = whole
        for number in ATTITUDE:
            part = P.place(*part, number) if part else None
        if stamp is None or not part:
            return None
        quats, start = [], 0
        for n, w, _, a, b in P.fields(part[0]):
            if n == QUATERNION and w == 2:
                v = {k: x for k, wire, x, *_ in P.fields(part[0][a:b]) if wire == 5}
                quats.append({**{k: v.get(i, 0.0) for i, k in enumerate("wxyz", 1)}, "at": part[1] + start})
            start = b
        if not quats:
            return None
        return {"file": file, "frame": frame, "t": t, "stamp": stamp, "imu_stamp": P.get(part[0], STAMP), "vsync": P.get(part[0], VSYNC), "sample_offset": P.get(part[0], OFFSET) or 0.0, "quats": quats}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for x in (one(*r) for r in zip(*(c.to_pylist() for c in batch.columns))) if x]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return packets.select("file", "sample", "t", "offset", "payload").mapInArrow(run, "file string, frame long, t double, stamp long, imu_stamp long, vsync long, sample_offset double, quats array<struct<w: double, x: double, y: double, z: double, at: long>>")


def samples(found: DataFrame, heads: DataFrame) -> DataFrame:
    """file, frame, index, t_us, sensor (the rotation as it is stored), camera (in the camera's frame, of one sign with the
    sample before), inverted and at of each sample of frames() that is a rotation. heads: clips()."""
    one = Window.partitionBy("file")
    timed = found.withColumn("first", F.min_by("stamp", "frame").over(one)).join(heads.select("file", "sensor_fps", "fps_ratio"), "file")
    each = timed.select("*", F.posexplode("quats").alias("index", "s"))
    parts = [F.col(f"s.{k}") for k in "wxyz"]
    good = ~F.greatest(*(F.isnan(p) for p in parts)) & (F.greatest(*(F.abs(p) for p in parts)) > 0)
    ms = (F.col("stamp") - F.col("first")) / 1000.0 + (F.col("index") - F.col("sample_offset")) / F.size("quats") * (1000.0 / F.greatest("sensor_fps", F.lit(1.0)))
    each = each.where(good).select("file", "frame", "index", (ms / F.col("fps_ratio") * 1000).alias("t_us"), Q.quat(*parts).alias("sensor"), F.col("s.at").alias("at"))
    by = one.orderBy("frame", "index")
    each = each.withColumn("camera", Q.to_camera(F.col("sensor"))).withColumn("before", F.lag("camera").over(by))
    gap = sum(((F.col("camera")[k] - F.col("before")[k]) * (F.col("camera")[k] - F.col("before")[k]) for k in "wxyz"), F.lit(0.0))
    turned = F.sum(F.when(gap > 1.5 * 1.5, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    each = each.withColumn("inverted", turned)
    return each.select("file", "frame", "index", "t_us", "sensor", F.when(F.col("inverted"), Q.negate(F.col("camera"))).otherwise(F.col("camera")).alias("camera"), "inverted", "at")


def reference_slots(contents: DataFrame) -> DataFrame:
    """file, frame and slot: which sample of a frame's block the second metadata track repeats bit for bit; the first of
    equal ones, null where there is none. Only files with both tracks have rows."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = [P.get(x, *REFERENCE) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x if isinstance(x, bytes) and len(x) == 16 else None for x in refs], pa.binary())], names=["file", "frame", "ref"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, frame, data in zip(*(c.to_pylist() for c in batch.columns)):
                att = P.get(data, FRAME, *ATTITUDE) or b""
                quats = [att[a:b] for n, w, _, a, b in P.fields(att) if n == QUATERNION and w == 2]
                # a record is four times a tag and four bytes
                rows += [(file, frame, k, b"".join(q[i + 1 : i + 5] for i in range(0, 20, 5))) for k, q in enumerate(quats)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["file", "frame", "slot", "ref"])

    read = lambda form: container.packets_of(contents, form).select("file", F.col("sample").alias("frame"), "payload")
    refs = read(REFERENCE_FORMAT).mapInArrow(told, "file string, frame long, ref binary")
    slots = read(FORMAT).mapInArrow(blocks, "file string, frame long, slot int, ref binary")
    return refs.join(slots, ["file", "frame", "ref"], "left").groupBy("file", "frame").agg(F.min("slot").alias("slot"))


def read_telemetry(contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """clips, frames and samples of recordings (path, content); a file without a sample has none of them."""
    packets = container.packets_of(contents, FORMAT)
    heads, found = clips(packets), frames(packets)
    return heads, found, samples(found, heads)
