"""Zipped arrays as rows: types, missing values, forms of storage and faults."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import npz


def zipped(save=np.savez, **arrays):
    body = io.BytesIO()
    save(body, **arrays)
    return body.getvalue()


def contents(spark, *files):
    return spark.createDataFrame([(f"f{i}", bytearray(x)) for i, x in enumerate(files)], "path string, content binary")


def read(spark, schema, *files):
    return sorted(map(tuple, npz.rows_of(contents(spark, *files), schema).collect()))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_types_and_missing_values(spark, save):
    file = zipped(save, a=np.array([1.5, np.nan, -2], ">f4"), n=np.array([3, -4, 5], np.int16), q=np.asfortranarray(np.arange(6.0).reshape(3, 2)), s=np.array(["ä", "", "xyz"]), b=np.array([True, False, True]), cube=np.arange(12).reshape(3, 2, 2), unread=np.zeros(9))
    got = read(spark, "a double, n bigint, q array<double>, s string, b boolean, cube array<int>, none string", file)
    assert got == [("f0", 0, 1.5, 3, [0.0, 1.0], "ä", True, [0, 1, 2, 3], None), ("f0", 1, None, -4, [2.0, 3.0], "", False, [4, 5, 6, 7], None), ("f0", 2, -2.0, 5, [4.0, 5.0], "xyz", True, [8, 9, 10, 11], None)]


def test_many_rows_single_values_and_none(spark):
    n = npz.BLOCK * 2 + 5
    long, one, empty, other = zipped(np.savez_compressed, x=np.arange(n)), zipped(x=np.float64(7)), zipped(x=np.zeros(0)), zipped(y=np.zeros(4))
    d = npz.rows_of(contents(spark, long, one, empty, other), "x bigint")
    got = {r.file: (r.n, r.s) for r in d.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("place")).alias("s")).collect()}
    assert got == {"f0": (n, sum(i * i for i in range(n))), "f1": (1, 0)}
    assert npz.rows_of(contents(spark, one).where("false"), "x bigint").count() == 0


@pytest.mark.parametrize("schema,file", [("x double, y double", zipped(x=np.zeros(3), y=np.zeros(2))), ("x double, y double", zipped(x=np.zeros(npz.BLOCK), y=np.zeros(npz.BLOCK + 1))), ("x int", zipped(x=np.array([2**40]))), ("x bigint", zipped(x=np.array([0.5]))), ("x double", zipped(x=np.zeros((2, 2)))), ("x double", zipped(x=np.array([None, 1], object)))])
def test_faults_are_errors(spark, schema, file):
    with pytest.raises(Exception):
        read(spark, schema, file)


def test_members_and_round_trip(spark):
    rows = [(k, i, None if i == 2 else i / 3, [i, i + 1], f"s{i}", i % 2 == 0) for k in ("a", "b") for i in range(5)]
    d = spark.createDataFrame(rows, "k string, i bigint, x double, v array<int>, s string, b boolean").repartition(4)
    files = npz.files_of(d, "k", ["i"], ["i", "x", "v", "s", "b"])
    assert sorted(map(tuple, npz.rows_of(files, "i bigint, x double, v array<int>, s string, b boolean").collect())) == sorted((k, i, i, x, v, s, b) for k, i, x, v, s, b in rows)
    forms = {(r.file, r.member): (r.dtype, r["shape"], r.by_column) for r in npz.members_of(files).collect()}
    assert forms["a", "v"] == ("<i4", [5, 2], False) and forms["b", "s"] == ("<U2", [5], False) and len(forms) == 10
    with pytest.raises(Exception, match="missing"):
        npz.files_of(d.withColumn("s", F.lit(None).cast("string")), "k", ["i"], ["s"]).collect()
