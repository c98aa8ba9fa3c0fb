"""What a finished stream leaves behind: files, not rows in the driver."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import streaming_queries


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_finished_streams_stand_in_files(spark, sf_dir, mode):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = streaming_queries.event_stream(spark, sf_dir)
    if mode == "append":
        out, want = streaming_queries.finished(stream.select("event_id"), mode), events.select("event_id")
    else:
        count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
        out, want = streaming_queries.finished(count(stream), mode), count(events)
    assert out.inputFiles() and sorted(out.collect()) == sorted(want.collect())


def test_finished_stream_without_rows(spark, sf_dir):
    out = streaming_queries.finished(streaming_queries.event_stream(spark, sf_dir).where("false").select("event_id"), "append")
    assert out.columns == ["event_id"] and out.collect() == []
