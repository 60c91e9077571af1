"""The streamed operators give what the batch ones do."""

from ledgerloom.streaming.progress import hourly_failures, read_events, replay, run_progress

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = read_events(spark, str(tmp_path / "in"), events.schema)
    for name, op in (("progress", run_progress), ("failures", hourly_failures)):
        query = replay(op(stream), name, "complete", str(tmp_path / name))
        query.awaitTermination()
        assert rows(spark.table(name)) == rows(op(events))
