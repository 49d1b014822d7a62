import json
import struct
from pathlib import Path

import pytest

from tidemark.sources import container, protobuf, session


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *numbers):
    return box(kind, struct.pack(f">I{len(numbers)}I", 0, *numbers))


def movie():
    """One track: chunks of 2, 2 and 1 samples at 1000, 2000 and 3000."""
    stbl = box(b"stbl", full(b"stsz", 0, 5, 10, 20, 30, 40, 50) + full(b"stco", 3, 1000, 2000, 3000) + full(b"stsc", 2, 1, 2, 1, 3, 1, 1) + full(b"stts", 2, 3, 100, 2, 50))
    mdhd, hdlr = full(b"mdhd", 0, 0, 600, 0, 0), box(b"hdlr", struct.pack(">II4s", 0, 0, b"meta") + bytes(12))
    big = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    return box(b"ftyp", b"isom") + big + box(b"moov", box(b"trak", box(b"mdia", mdhd + hdlr + box(b"minf", stbl)))) + struct.pack(">I4s", 0, b"mdat") + bytes(9)


def test_boxes_and_sample_tables(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie())
    path = f"file://{tmp_path}"
    found = {r.box: r for r in container.read_boxes(spark, path).collect()}
    assert found["/free"].header == 16 and found["/free"].size == 20 and found["/mdat"].size == 17
    assert "/moov/trak/mdia/minf/stbl/stts" in found
    t = container.read_tracks(spark, path)
    (row,) = t.collect()
    assert (row.scale, row.handler) == (600, "meta")
    offsets = [(r["sample"], r["offset"], r["size"]) for r in container.sample_offsets(t).orderBy("sample").collect()]
    assert offsets == [(0, 1000, 10), (1, 1010, 20), (2, 2000, 30), (3, 2030, 40), (4, 3000, 50)]
    times = [r.t * 600 for r in container.sample_times(t).orderBy("sample").collect()]
    assert times == pytest.approx([0, 100, 200, 300, 350])


def test_a_cut_file_ends_the_walk():
    whole = list(container.boxes(movie()))
    assert len(list(container.boxes(movie()[:60]))) < len(whole)


def test_protobuf_fields(spark):
    data = bytes([0x08, 0x96, 0x01]) + bytes([0x12, 3]) + b"abc" + bytes([0x1D]) + struct.pack("<f", 1.5) + bytes([0x21]) + struct.pack("<d", -2.0)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, payload binary")
    rows = [(r.id, r.number, r.wire, r.value, r.start, r.end) for r in protobuf.read_fields(df, "id", "payload").collect()]
    assert rows == [(1, 1, 0, 150.0, 1, 3), (1, 2, 2, None, 5, 8), (1, 3, 5, 1.5, 9, 13), (1, 4, 1, -2.0, 14, 22)]
    assert [protobuf.unzigzag(x) for x in (0, 1, 2, 3)] == [0, -1, 1, -2]
    for bad in (b"\x80", b"\x00\x00", b"\x12\x05a", b"\x0b"):
        with pytest.raises(ValueError):
            list(protobuf.fields(bad))


def test_session_series_and_lens(spark, tmp_path):
    df = spark.createDataFrame([(0.02 * i, i, i + 1, 1.0, float("nan") if i == 3 else 2.0, 3.0, 1.0, 300) for i in range(5)], session.SERIES)
    session.write_series(df.coalesce(1), f"file://{tmp_path}/series")
    back = session.read_series(spark, f"file://{tmp_path}/series").orderBy("frame_a").collect()
    assert len(back) == 5 and back[3].y_deg_s is None and back[2].y_deg_s == 2.0
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        session.read_series(spark, f"file://{tmp_path}/other.csv").collect()
    profile = {"name": "p", "calib_dimension": {"w": 1920, "h": 1440}, "fisheye_params": {"camera_matrix": [[800, 0, 960], [0, 800, 720], [0, 0, 1]], "distortion_coeffs": [0.1, 0, 0, 0]}}
    (tmp_path / "lens.json").write_text(json.dumps(profile))
    (r,) = session.read_lens(spark, f"file://{tmp_path}/lens.json", 3840, 2880).collect()
    assert (r.fx, r.cx, r.cy) == (1600, 1920, 1440)


def test_lens_profiles_share_files(spark, tmp_path):
    from pyspark.sql import functions as F

    names = [(k, f"p{k}") for k in [*range(40), 1000, 1000]]  # one key twice, as its profiles are two
    profile = F.struct("name", F.struct(F.lit(1920).alias("w"), F.lit(1440).alias("h")).alias("calib_dimension"), F.struct(F.array(*(F.array(*(F.col("k") + i for _ in range(3))) for i in range(3))).alias("camera_matrix"), F.array(F.lit(0.5)).alias("distortion_coeffs")).alias("fisheye_params"))
    df = spark.createDataFrame(names, "k long, name string").select("k", profile.alias("profile"))
    session.write_lens(df, f"file://{tmp_path}/lenses", "k", "profile", 16)
    assert len(list(tmp_path.glob("lenses/part=*/*.txt"))) == 4  # 0 to 15, 16 to 31, 32 to 39, and that of 1000
    (tmp_path / "lenses" / "part=0" / "one.json").write_text(json.dumps({"name": "alone", "calib_dimension": {"w": 3840, "h": 2880}, "fisheye_params": {"camera_matrix": [[7, 0, 0], [0, 0, 0], [0, 0, 0]]}}))
    found = sorted((r.name, r.fx, r.fy) for r in session.read_lens(spark, f"file://{tmp_path}/lenses", 3840, 2880).collect())
    assert found == sorted([("alone", 7.0, 0.0), *((n, k * 2.0, (k + 1) * 2.0) for k, n in names)])


def test_supplier_profiles_are_few_files(spark):
    from tidemark.plans import files
    from tidemark.shared import _folder

    before = set(tmp_files(_folder(spark)))
    found = files.s18_lens_profiles(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len({r.name for r in found}) == 100
    assert len(set(tmp_files(_folder(spark))) - before) == 1  # not one for each supplier


def tmp_files(folder, what="lenses"):
    return list(Path(folder.removeprefix("file://")).glob(f"files/{what}-*/**/*.txt"))


def test_exports_of_users_are_few_files(spark):
    import duckdb

    from tidemark.plans import files
    from tidemark.shared import _folder

    sf = "/root/testdata/sf0.001"
    before = set(tmp_files(_folder(spark), "exports"))
    found = sorted(map(tuple, files.s21_render_exports(spark, sf).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
        wanted = sorted(c.execute(files.ORACLE["s21_render_exports"]).fetchall())
    assert len(found) == len(wanted) and all(a == pytest.approx(b) for a, b in zip(found, wanted))
    users = {r[0] for r in wanted}
    assert len(users) > 10 and len(set(tmp_files(_folder(spark), "exports")) - before) <= 8  # tasks of the session, not users
