"""Streams give what batches give."""

from pyspark.sql import functions as F

from gridloom.operators import ordered
from gridloom.sources import tables
from gridloom.streaming import passages

FOLDER = "/root/testdata/sf0.001"


def drained(spark, stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_passages_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    frames = tables.series(spark, FOLDER).select("key", "frame", "s")
    for n, part in enumerate((frames.where("frame < 4"), frames.where("frame >= 4"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = drained(spark, passages.passages(stream, 15.0, 70.0), "passages", "append")
    want = ordered.crossings(frames, ["key"], 15.0, 70.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_of_a_stream_equal_those_of_a_batch(spark):
    events = tables.table(spark, FOLDER, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{FOLDER}/events.parquet*")
    got = drained(spark, passages.windowed(stream, "1 day", "40 days"), "windows", "complete")
    want = passages.windowed(events, "1 day", "40 days")
    plain = lambda df: sorted(map(str, df.withColumn("mean", F.round("mean", 6)).collect()))
    assert plain(got) == plain(want)
