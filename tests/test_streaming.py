"""Streams give what batches give; sinks may be written again."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.sources import connectors, sinks
from agora.streaming import usage
from tests.conftest import DATA

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_files(spark, path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(path)
    return events


def test_hourly_stream_is_the_batch(spark, tmp_path):
    events = event_files(spark, f"{tmp_path}/in")
    stream = usage.hourly(usage.files(spark, f"{tmp_path}/in", SCHEMA))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, usage.hourly(events).collect()))


def test_drained_goes_on_where_it_stopped(spark, tmp_path):
    events = event_files(spark, f"{tmp_path}/in")
    for _ in range(2):
        usage.drained(usage.once(usage.files(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").select("event_id").distinct().count() == spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_sessions_and_sliding_windows(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert usage.sessions(events).agg(F.sum("n")).first()[0] == events.count()
    assert usage.sliding(events).where("users < 1").count() == 0


def test_batches_replace_themselves(spark, tmp_path):
    rows = spark.range(10)
    write = sinks.append_batch(f"{tmp_path}/ledger")
    for batch in (0, 1, 1):
        write(rows, batch)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 20
    sinks.replace_partitions(rows.withColumn("k", F.col("id") % 2), f"{tmp_path}/p", "k")
    sinks.replace_partitions(rows.where("id < 4").withColumn("k", F.lit(1)), f"{tmp_path}/p", "k")
    assert spark.read.parquet(f"{tmp_path}/p").groupBy("k").count().orderBy("k").collect() == [(0, 5), (1, 4)]


def test_encodings(spark):
    rows = [("é".encode(), "é"), ("é€".encode("cp1252"), "é€"), (b"\x81x", "\x81x"), (b"", "")]
    got = spark.createDataFrame([(bytearray(b),) for b, _ in rows], "b binary").select(connectors.decoded(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == [t for _, t in rows]


def test_transcripts(spark):
    raw = ['[{"start": 1.5, "text": "a"}]', '{"chunks": [{"timestamp": "1:02:03", "end": 4000, "speaker": "X", "text": "b"}]}', "junk"]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(connectors.transcript_segments(F.col("r")).alias("s")).collect()
    assert [[tuple(s) for s in r.s] if r.s else None for r in got] == [[(1.5, 6.5, None, "a")], [(3723.0, 4000.0, "X", "b")], None]


def test_folders_and_feeds(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "Agenda.txt").write_text("x")
    files = connectors.text_files(spark, str(tmp_path))
    assert [(r.has_agenda, r.has_minutes, r.files) for r in connectors.folder_documents(files).collect()] == [(True, False, 1)]
    feed = "<rss><item><title><![CDATA[A & b]]></title><link>/x</link></item></rss>"
    assert spark.range(1).select(connectors.feed_items(F.lit(feed)).alias("i")).first().i[0].title == "A & b"
