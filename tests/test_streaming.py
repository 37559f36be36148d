"""Streams that end give what the batch gives."""

from conftest import DATA
from pyspark.sql import functions as F

from pictorium.streaming import capture


def events(reader, spark):
    schema = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").schema
    raw = reader.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{DATA}/sf0.001/")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("image_id"), F.lit("m").alias("camera_make"), F.col("user_id").cast("string").alias("camera_model"))


def run(df, name):
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_timeline(spark):
    want = capture.timeline(events(spark.read, spark), "30 days").collect()
    got = run(capture.timeline(events(spark.readStream, spark), "30 days"), "stream_timeline").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_sessions(spark):
    want = capture.sessions(events(spark.read, spark), "12 hours").collect()
    got = run(capture.sessions(events(spark.readStream, spark), "12 hours"), "stream_sessions").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
