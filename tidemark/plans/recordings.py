"""Queries over recordings: files with a container, two metadata tracks and protobuf packets.

The driver's tables hold no recordings, so they are written here from embeddings, a file for each label and stretch of
STRETCH ids, with frames of five samples, so that no file grows with the table; the SQL tells from the same table what must be read back.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..sources import container, npz, protobuf, telemetry
from .views import flat, r6, s6, table

PER_FRAME, SCALE, STEP, FPS, SENSOR_FPS = 5, 60000, 1001, 59.94, 59.5
STRETCH = 1 << 10


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _nested(path: tuple[int, ...], body: bytes) -> bytes:
    for number in reversed(path):
        body = _field(number, body)
    return body


def _box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _full(kind: bytes, *numbers: int) -> bytes:
    return _box(kind, struct.pack(f">I{len(numbers)}I", 0, *numbers))


def _track(number: int, form: bytes, sizes: list[int], chunk: int) -> bytes:
    """A track whose samples lie in one chunk."""
    n = len(sizes)
    stbl = _box(b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), struct.pack(">I4s", 16, form) + bytes(8)), _full(b"stts", 1, n, STEP), _full(b"stsc", 1, 1, n, 1), _full(b"stsz", 0, n, *sizes), _full(b"stco", 1, chunk))
    return _box(b"trak", _full(b"tkhd", 0, 0, number, 0, n * STEP), _box(b"mdia", _full(b"mdhd", 0, 0, SCALE, n * STEP, 0), _box(b"hdlr", struct.pack(">II4s", 0, 0, b"meta"), bytes(12)), _box(b"minf", stbl)))


def _recording(rows: pd.DataFrame) -> bytes:
    packets, refs = [], []
    rows = rows.sort_values("vec_id")
    for k in range(0, len(rows), PER_FRAME):
        part = rows.iloc[k : k + PER_FRAME]
        stamp = int(part["vec_id"].iloc[0]) * 1000
        records = [b"".join(_field(i, float(x)) for i, x in enumerate(q, 1)) for q in part[list("wxyz")].to_numpy()]
        attitude = _field(1, stamp + 7) + _field(2, k // PER_FRAME) + b"".join(_field(3, x) for x in records) + _field(4, 0.5)
        frame = _field(3, _field(1, _field(2, stamp)) + _field(3, _field(2, attitude)))
        if not packets:
            head = _field(1, b"clip.proto") + _field(6, b"01.02") + _field(9, stamp) + _field(10, b"Model " + str(rows["label"].iloc[0]).encode())
            clip = _field(1, head) + _nested((3, 1), struct.pack("<2f", 0.5, 0.25)) + _nested((4,), _field(1, 13580000)) + _nested((10,), _field(1, 2000)) + _nested((11,), _field(1, SENSOR_FPS))
            frame = _field(1, clip) + _field(2, _field(3, _field(1, 3840) + _field(2, 2160) + _field(3, FPS))) + frame
        packets.append(frame)
        middle = records[len(records) // 2]
        refs.append(_nested((2, 1, 11, 7, 4), b"".join(middle[i + 1 : i + 5] for i in range(0, 20, 5))))
    start = _box(b"ftyp", b"isomiso2")
    data = _box(b"mdat", *packets, *refs)
    first = len(start) + 8
    moov = _box(b"moov", _track(1, b"djmd", [len(x) for x in packets], first), _track(2, b"dbgi", [len(x) for x in refs], first + sum(map(len, packets))))
    return start + data + moov


def recordings(spark, sf_dir) -> DataFrame:
    """path and content; rows with vec_id in the 41s have no rotation, and in the 43s no number."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.when(F.col("vec_id") % 41 == 0, 0.0).when(F.col("vec_id") % 43 == 0, F.lit(float("nan"))).otherwise(F.col("embedding")[i].cast("float").cast("double"))
    path = F.format_string("clip-%d-%d.mp4", "label", F.floor(F.col("vec_id") / STRETCH))
    rows = e.select(path.alias("path"), "label", "vec_id", *(part(i).alias(k) for i, k in enumerate("wxyz")))
    return rows.groupBy("path").applyInPandas(lambda g: pd.DataFrame({"path": [g["path"].iloc[0]], "content": [_recording(g)]}), "path string, content binary")


def s01_boxes(spark, sf_dir):
    """The boxes of each file in order, with their names from the top."""
    found = container.boxes_of(recordings(spark, sf_dir))
    sized = F.col("box").rlike("(ftyp|tkhd|mdhd|hdlr|stsd|stts|stsc|stsz|stco)$")
    return found.groupBy("file", "box").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(sized, F.col("size"))).alias("size"), F.max("header").alias("header"))


def s02_box_bodies(spark, sf_dir):
    found = container.boxes_of(recordings(spark, sf_dir), ("/ftyp", "/moov/trak/mdia/minf/stbl/stts"))
    return found.where("body is not null").select("file", "box", F.lower(F.hex("body")).alias("body")).distinct()


def s03_tracks(spark, sf_dir):
    t = container.tracks_of(recordings(spark, sf_dir))
    return t.select("file", "track", "id", F.col("formats")[0].alias("format"), "scale", "handler", F.size("sizes").cast("long").alias("samples"))


def s04_track_offsets(spark, sf_dir):
    """Where every sample of the second track lies behind its first one, from chunks, runs and sizes."""
    o = container.sample_offsets(container.tracks_of(recordings(spark, sf_dir))).where("track = 1")
    first = o.groupBy("file").agg(F.min("offset").alias("first"))
    return o.join(first, "file").select("file", "sample", (F.col("offset") - F.col("first")).alias("behind"), "size")


def s05_track_times(spark, sf_dir):
    t = container.sample_times(container.tracks_of(recordings(spark, sf_dir)))
    return t.select("file", "track", "sample", r6(F.col("t")).alias("t"))


def s06_packets(spark, sf_dir):
    """Every packet of the second track: time, size, and where it lies behind the first one of its file."""
    p = container.packets_of(recordings(spark, sf_dir), telemetry.REFERENCE_FORMAT)
    first = p.groupBy("file").agg(F.min("offset").alias("first"))
    return p.join(first, "file").select("file", "sample", r6(F.col("t")).alias("t"), F.octet_length("payload").cast("long").alias("size"), (F.col("offset") - F.col("first")).alias("behind"))


def s07_numbers(spark, sf_dir):
    """Whole numbers of one to seven bytes, and those with their sign in the lowest bit, read from bytes."""
    e = F.col("event_id")
    top, low = e % 16384, F.repeat(F.hex((e % 128).bitwiseOR(128)), (e % 6).cast("int"))
    last = F.when(top < 128, F.lpad(F.hex(top), 2, "0")).otherwise(F.concat(F.hex(top.bitwiseAND(127).bitwiseOR(128)), F.lpad(F.hex(F.shiftright(top, 7)), 2, "0")))
    bodies = table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(F.lit("08"), low, last)).alias("body"))
    found = protobuf.read_fields(bodies, "event_id", "body")
    n = F.col("value").cast("long")
    return found.select("event_id", n.alias("value"), F.shiftright(n, 1).bitwiseXOR(-n.bitwiseAND(1)).alias("signed"), "end")


def s08_fields(spark, sf_dir):
    p = container.packets_of(recordings(spark, sf_dir), telemetry.REFERENCE_FORMAT).withColumn("key", F.concat_ws(" ", "file", F.col("sample").cast("string")))
    return protobuf.read_fields(p, "key", "payload").select("key", "number", "wire", "start", "end")


def s09_dump(spark, sf_dir):
    """The messages of each packet; the sixteen bytes of the last may look like anything."""
    p = container.packets_of(recordings(spark, sf_dir), telemetry.REFERENCE_FORMAT)
    return protobuf.read_dump(p, ["file", "sample"], "payload").where("path not like '2.1.11.7.4%'").select("file", "sample", "place", "path", "kind", "size")


def s10_accessors(spark, sf_dir):
    """The numbers of packed fields of the headers."""
    heads, _, _ = telemetry.read_telemetry(recordings(spark, sf_dir))
    return heads.select("file", F.posexplode("distortion").alias("k", "v")).select("file", "k", r6(F.col("v")).alias("v"))


def s11_clips(spark, sf_dir):
    heads, _, _ = telemetry.read_telemetry(recordings(spark, sf_dir))
    return heads.select("file", "proto_file", "firmware", "clip_stamp", "product", r6(F.col("readout_ns") / 1e6 / F.col("fps_ratio")).alias("readout_ms"), "imu_hz", r6(F.col("sensor_fps")).alias("sensor_fps"), r6(F.col("fps")).alias("fps"), "width", "height")


def s13_telemetry(spark, sf_dir):
    """All samples: time, rotation in the camera's frame with a sign that does not jump, and whether it was turned."""
    _, _, found = telemetry.read_telemetry(recordings(spark, sf_dir))
    return found.select("file", "frame", "index", F.round("t_us", 3).alias("t_us"), "inverted", *flat(F.col("camera"), "c"))


def s13_frames(spark, sf_dir):
    _, found, _ = telemetry.read_telemetry(recordings(spark, sf_dir))
    return found.select("file", "frame", r6(F.col("t")).alias("t"), "stamp", "imu_stamp", "vsync", "sample_offset", F.size("quats").cast("long").alias("n"))


def s14_reference_slots(spark, sf_dir):
    return telemetry.reference_slots(recordings(spark, sf_dir))


def _archives(spark, sf_dir):
    """Arrays of each stretch of ids in a zipped file; x is NaN for the 43s."""
    e = table(spark, sf_dir, "embeddings")
    part = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("float"))
    x = F.when(F.col("vec_id") % 43 == 0, float("nan")).otherwise(F.col("embedding")[3].cast("double"))
    d = e.select(F.format_string("part-%d.npz", F.floor(F.col("vec_id") / STRETCH)).alias("path"), "vec_id", "label", part.alias("v"), x.alias("x"), (F.col("vec_id") % 3 == 0).alias("flag"), F.format_string("row %d", "vec_id").alias("name"))
    return npz.files_of(d, "path", ["vec_id"], ["vec_id", "label", "v", "x", "flag", "name"])


def s15_arrays(spark, sf_dir):
    """Every row of the arrays, typed; what is not a number is null, and so is an array that is not there."""
    d = npz.rows_of(_archives(spark, sf_dir), "vec_id bigint, label int, v array<double>, x double, flag boolean, name string, other double")
    return d.select("file", "place", "vec_id", "label", *(r6(F.col("v")[k]).alias(f"v{k}") for k in range(3)), r6(F.col("x")).alias("x"), "flag", "name", "other")


def s15_members(spark, sf_dir):
    """The form of every array, from its header."""
    m = npz.members_of(_archives(spark, sf_dir))
    return m.select("file", "member", F.when(F.col("member") != "name", F.col("dtype")).alias("dtype"), F.array_join(F.col("shape").cast("array<string>"), " x ").alias("shape"))


def s24_record_places(spark, sf_dir):
    """Where the records of a frame lie, behind its first one: 22 bytes each."""
    _, found, _ = telemetry.read_telemetry(recordings(spark, sf_dir))
    each = found.select("file", "frame", F.posexplode("quats").alias("index", "s"), F.col("quats")[0]["at"].alias("first"))
    return each.select("file", "frame", "index", (F.col("s.at") - F.col("first")).alias("behind"))


_CLIPS = f"""e AS (SELECT label, vec_id, embedding, 'clip-' || label || '-' || (vec_id // {STRETCH}) || '.mp4' AS file, row_number() OVER (PARTITION BY label, vec_id // {STRETCH} ORDER BY vec_id) - 1 AS k FROM embeddings),
    f AS (SELECT *, k // {PER_FRAME} AS frame, (k % {PER_FRAME})::INTEGER AS index FROM e), clip AS (SELECT file, label, max(frame) + 1 AS n, min(vec_id) AS first FROM f GROUP BY ALL),
    fr AS (SELECT file, frame, min(vec_id) * 1000 AS stamp, count(*) AS n FROM f GROUP BY ALL)"""
_T = "/moov/trak/mdia/minf/stbl/"
_HEAD = f"""sm AS (SELECT f.file, f.frame, index, stamp, fr.n, first, CASE WHEN vec_id % 41 = 0 OR vec_id % 43 = 0 THEN NULL ELSE [embedding[i]::FLOAT::DOUBLE FOR i IN [1, 2, 3, 4]] END AS q FROM f JOIN fr USING (file, frame) JOIN clip USING (file)),
    tm AS (SELECT file, frame, index, q, ((stamp - first * 1000) / 1000.0::DOUBLE + (index - 0.5::DOUBLE) / n * (1000.0::DOUBLE / {SENSOR_FPS}::FLOAT::DOUBLE)) / ({FPS}::FLOAT::DOUBLE / {SENSOR_FPS}::FLOAT::DOUBLE) * 1000 AS t FROM sm WHERE q IS NOT NULL),
    g AS (SELECT *, lag(q) OVER w AS b FROM tm WINDOW w AS (PARTITION BY file ORDER BY frame, index)), p AS (SELECT *, sum(CASE WHEN (q[1]-b[1])**2 + (q[2]-b[2])**2 + (q[3]-b[3])**2 + (q[4]-b[4])**2 > 2.25 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY frame, index) % 2 = 1 AS inverted FROM g)"""
_CAMERA = ["-(-q[1] - q[2] + q[3] - q[4])", "(q[1] - q[2] + q[3] + q[4])", "(q[1] + q[2] + q[3] - q[4])", "-(-q[1] + q[2] + q[3] + q[4])"]
_SIGNED = ", ".join(f"{s6(f'{c} / 2 * CASE WHEN inverted THEN -1 ELSE 1 END')} AS c{k}" for k, c in zip("wxyz", _CAMERA))
_BOXES = [("/ftyp", 1, "16"), ("/mdat", 1, "NULL"), ("/moov", 1, "NULL"), ("/moov/trak", 2, "NULL"), ("/moov/trak/tkhd", 2, "64"), ("/moov/trak/mdia", 2, "NULL"), ("/moov/trak/mdia/mdhd", 2, "64"), ("/moov/trak/mdia/hdlr", 2, "64"), ("/moov/trak/mdia/minf", 2, "NULL"), (_T[:-1], 2, "NULL"), (_T + "stsd", 2, "64"), (_T + "stts", 2, "48"), (_T + "stsc", 2, "56"), (_T + "stsz", 2, "40 + 8 * n"), (_T + "stco", 2, "40")]

ORACLE = {
    "s01_boxes": f"WITH {_CLIPS} " + " UNION ALL ".join(f"SELECT file, '{b}' AS box, {n}::BIGINT AS n, ({size})::BIGINT AS size, 8::BIGINT AS header FROM clip" for b, n, size in _BOXES),
    "s02_box_bodies": f"WITH {_CLIPS} SELECT file, '/ftyp' AS box, '69736f6d69736f32' AS body FROM clip UNION ALL SELECT file, '{_T}stts', printf('0000000000000001%08x%08x', n, {STEP}) FROM clip",
    "s03_tracks": f"WITH {_CLIPS} SELECT file, track, track + 1 AS id, format, {SCALE} AS scale, 'meta' AS handler, n AS samples FROM clip, (VALUES (0, 'djmd'), (1, 'dbgi')) t(track, format)",
    "s04_track_offsets": f"WITH {_CLIPS} SELECT file, frame AS sample, 26 * frame AS behind, 26 AS size FROM fr",
    "s05_track_times": f"WITH {_CLIPS} SELECT file, track, frame AS sample, {s6(f'frame * {STEP} / {SCALE}::DOUBLE')} AS t FROM fr, range(0, 2) t(track)",
    "s06_packets": f"WITH {_CLIPS} SELECT file, frame AS sample, {s6(f'frame * {STEP} / {SCALE}::DOUBLE')} AS t, 26 AS size, 26 * frame AS behind FROM fr",
    "s07_numbers": """SELECT event_id, v AS value, xor(v >> 1, -(v & 1)) AS signed, k + CASE WHEN top < 128 THEN 2 ELSE 3 END AS "end" FROM (SELECT event_id, k, top, top * (1::BIGINT << (7 * k)::INTEGER) + event_id % 128 * (((1::BIGINT << (7 * k)::INTEGER) - 1) // 127) AS v
        FROM (SELECT event_id, event_id % 6 AS k, event_id % 16384 AS top FROM events))""",
    "s08_fields": f"WITH {_CLIPS} SELECT file || ' ' || frame AS key, 2 AS number, 2 AS wire, 2 AS start, 26 AS \"end\" FROM fr",
    "s09_dump": f"WITH {_CLIPS} SELECT file, frame AS sample, place, path, 'message' AS kind, size FROM fr, (VALUES (0, '2', 24), (1, '2.1', 22), (2, '2.1.11', 20), (3, '2.1.11.7', 18)) t(place, path, size)",
    "s10_accessors": f"WITH {_CLIPS} SELECT file, k, v FROM clip, (VALUES (0, 0.5::DOUBLE), (1, 0.25::DOUBLE)) t(k, v)",
    "s11_clips": f"""WITH {_CLIPS} SELECT file, 'clip.proto' AS proto_file, '01.02' AS firmware, (first * 1000)::VARCHAR AS clip_stamp, 'Model ' || label AS product, {s6(f'13.58::DOUBLE / ({FPS}::FLOAT::DOUBLE / {SENSOR_FPS}::FLOAT::DOUBLE)')} AS readout_ms,
        2000::DOUBLE AS imu_hz, {s6(f'{SENSOR_FPS}::FLOAT::DOUBLE')} AS sensor_fps, {s6(f'{FPS}::FLOAT::DOUBLE')} AS fps, 3840::DOUBLE AS width, 2160::DOUBLE AS height FROM clip""",
    "s13_telemetry": f"WITH {_CLIPS}, {_HEAD} SELECT file, frame, index, round(t, 3) AS t_us, coalesce(inverted, false) AS inverted, {_SIGNED} FROM p",
    "s13_frames": f"WITH {_CLIPS} SELECT file, frame, {s6(f'frame * {STEP} / {SCALE}::DOUBLE')} AS t, stamp, stamp + 7 AS imu_stamp, frame AS vsync, 0.5::DOUBLE AS sample_offset, n FROM fr",
    "s14_reference_slots": f"""WITH {_CLIPS}, v AS (SELECT file, frame, index, CASE WHEN vec_id % 41 = 0 THEN 'none' WHEN vec_id % 43 = 0 THEN 'nan' ELSE vec_id::VARCHAR END AS v FROM f),
        m AS (SELECT v.file, v.frame, v.v FROM v JOIN fr USING (file, frame) WHERE index = n // 2) SELECT file, frame, min(index) AS slot FROM v JOIN m USING (file, frame, v) GROUP BY ALL""",
    "s15_arrays": f"""SELECT 'part-' || (vec_id // {STRETCH}) || '.npz' AS file, row_number() OVER (PARTITION BY vec_id // {STRETCH} ORDER BY vec_id) - 1 AS place, vec_id, label, {', '.join(f'{s6(f"embedding[{k + 1}]::DOUBLE")} AS v{k}' for k in range(3))},
        {s6('CASE WHEN vec_id % 43 <> 0 THEN embedding[4]::DOUBLE END')} AS x, vec_id % 3 = 0 AS flag, 'row ' || vec_id AS name, NULL::DOUBLE AS other FROM embeddings""",
    "s15_members": f"""WITH f AS (SELECT 'part-' || (vec_id // {STRETCH}) || '.npz' AS file, count(*)::VARCHAR AS n FROM embeddings GROUP BY ALL)
        SELECT file, member, dtype, n || more AS shape FROM f, (VALUES ('vec_id', '<i8', ''), ('label', '<i4', ''), ('v', '<f4', ' x 3'), ('x', '<f8', ''), ('flag', '|b1', ''), ('name', NULL, '')) t(member, dtype, more)""",
    "s24_record_places": f"WITH {_CLIPS} SELECT file, frame, index, 22 * index AS behind FROM f",
}

QUERIES = {name: globals()[name] for name in ORACLE}
