import os

import pytest

from sparkloom.streaming.windows import deduplicated, read_stream, sessions, windowed

SF = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def events(spark, tmp_path):
    if not os.path.exists(SF):
        pytest.skip("no test data")
    df = spark.read.parquet(SF)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, read_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)


def collect(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_windows_of_a_stream_match_those_of_the_table(spark, events):
    batch, stream = events
    how = {"n": "count(*)", "total": "round(sum(value), 2)"}
    want = windowed(batch, "ts", "1 day", how, categories="event_type")
    got = collect(spark, windowed(stream, "ts", "1 day", how, late="400 days", categories="event_type"), "w", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_and_duplicates(spark, events):
    batch, stream = events
    n = sessions(batch, "ts", "1 hour", {"n": "count(*)"}, categories="user_id")
    assert n.agg({"n": "sum"}).first()[0] == batch.count()
    got = collect(spark, deduplicated(stream, "user_id", "ts", "400 days"), "d")
    assert got.count() == batch.select("user_id").distinct().count()
