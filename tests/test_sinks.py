import glob
import json
import struct

from pyspark.sql import functions as F

from tidemark.plans import recordings
from tidemark.sources import sinks, telemetry

SF = "/root/testdata/sf0.001"


def lines(path):
    (name,) = glob.glob(f"{path}/part-*")
    with open(name) as f:
        return f.read().splitlines()


def test_samples_and_dump_keep_every_digit(spark, tmp_path):
    _, _, found = telemetry.read_telemetry(recordings.recordings(spark, SF))
    sinks.write_samples(found, f"file://{tmp_path}/csv")
    sinks.write_dump(found, f"file://{tmp_path}/dump", ["file"])
    read = spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()
    dump = {(r.file, r.frame, r["index"]): r for r in spark.read.parquet(f"file://{tmp_path}/dump").collect()}
    assert len(read) == len(dump) == found.count() and len(read[0]) == 14
    single = lambda x: struct.pack("<f", float(x))
    for r in read:
        own = dump[r.file, int(r.frame), int(r.idx)]
        assert [single(r[f"q{k}"]) for k in "wxyz"] == [single(own.sensor[k]) for k in "wxyz"]
        assert (r.inverted == "1") == own.inverted and int(r.place) == own["at"]


def test_log_has_its_header_first_and_rows_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.5, None), ("b", 1, 0.25, 1.0), ("a", 7, -1.0, 2.0), *(("c", i, float(i), 0.0) for i in range(500, 0, -1))], "clip string, n int, x double, y double")
    sinks.write_log(df.repartition(5), f"file://{tmp_path}/log", "clip", "n", ["x", "y"], ["LOG", "version,1", "x,y"])
    assert lines(f"{tmp_path}/log/clip=b") == ["LOG", "version,1", "x,y", "2.50000000e-01,1.00000000e+00", "5.00000000e-01,"]
    assert lines(f"{tmp_path}/log/clip=a")[3:] == ["-1.00000000e+00,2.00000000e+00"]
    assert [float(x.split(",")[0]) for x in lines(f"{tmp_path}/log/clip=c")[3:]] == [float(i) for i in range(1, 501)]


def test_reports_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None)], "clip string, rms double, note string").withColumn("bands", F.array(F.lit(1), F.lit(2))).coalesce(1)
    sinks.write_reports(df, f"file://{tmp_path}/json")
    assert json.loads(lines(f"{tmp_path}/json")[0]) == {"clip": "a", "rms": 1.5, "note": None, "bands": [1, 2]}
    sinks.report_index(df, f"file://{tmp_path}/index", ["clip", "rms"])
    assert lines(f"{tmp_path}/index") == ["clip,rms", "a,1.5"]
    unit = {"w": 1.0, "x": 0.0, "y": 0.0, "z": 0.0}
    (tmp_path / "e.json").write_text(json.dumps({"frames": [{"time": t, "org": unit, "stab": unit, "euler": [t, 0.0, 1.0], "fov": 90.0} for t in (0.0, 0.5)]}, indent=1))
    found = sinks.read_exports(spark, f"file://{tmp_path}/e.json").orderBy("place").collect()
    assert [(r.place, r.time, r.org.w, r.euler[0], r.fov) for r in found] == [(0, 0.0, 1.0, 0.0, 90.0), (1, 0.5, 1.0, 0.5, 90.0)]
