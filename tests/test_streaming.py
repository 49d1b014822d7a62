import pytest
from pyspark.sql import functions as F

from tidemark.streaming import series

SOURCE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def events(spark, tmp_path):
    """A batch of events, and a stream that has each of them twice."""
    batch = spark.read.parquet(SOURCE).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.union(batch).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "3650 days")


def seen(spark, stream, mode, folder):
    q = stream.writeStream.format("memory").queryName(f"seen_{mode}").outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted(map(tuple, spark.table(f"seen_{mode}").collect()))


def test_windows_of_a_stream_match_a_batch(spark, events, tmp_path):
    batch, stream = events
    found = series.rates(stream, "ts", ["event_type"], "1 day", n=F.count(F.lit(1)), top=F.max("value"))
    expected = series.rates(batch.union(batch), "ts", ["event_type"], "1 day", n=F.count(F.lit(1)), top=F.max("value"))
    assert seen(spark, found, "complete", tmp_path / "a") == sorted(map(tuple, expected.collect()))


def test_each_sample_counts_once(spark, events, tmp_path):
    batch, stream = events
    once = series.deduplicated(stream, ["event_id"]).select("event_id", "value")
    assert seen(spark, once, "append", tmp_path / "b") == sorted(map(tuple, batch.select("event_id", "value").collect()))
