"""Sessions as a stream with state and timers equal those in batch; small readers' and gates' cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.operators import gates
from quire.sources import readers
from quire.streaming import sessions


def test_session_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = events.agg(F.max("ts")).first()[0] + timedelta(days=3)
    ordered = events.orderBy("ts").collect()
    extra = [(5, None, "x"), (None, ordered[0].ts, "x"), (5, ordered[0].ts, None)]
    size = len(ordered) // 4 + 1
    for i in range(0, len(ordered), size):
        part = [tuple(r) for r in ordered[i : i + size]] + (extra if i == 0 else [])
        spark.createDataFrame(part, events.schema).repartition(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spark.createDataFrame([(-1, last, "end")], events.schema).repartition(1).write.mode("append").parquet(f"file://{tmp_path}/in")  # moves the watermark past all gaps
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = sessions.session_stream(stream, delay="1 hour").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    assert out.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
    want = sorted(map(tuple, sessions.sessions(events).collect()))
    assert got == want and len(want) > 50


def test_sessions(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(1, at(0), "a"), (1, at(30), "b"), (1, at(60.5), "a"), (1, at(0), "a"), (2, at(5), "c"), (None, at(1), "a"), (3, None, "a"), (3, at(1), None)]
    got = sorted(map(tuple, sessions.sessions(spark.createDataFrame([(*r, 1) for r in rows], "user_id long, ts timestamp, event_type string, n int")).collect()))
    assert got == [(1, at(0), at(30), 3, "a,b"), (1, at(60.5), at(60.5), 1, "a"), (2, at(5), at(5), 1, "c")]


def test_readmes_of_folders_with_one_name(spark):
    files = spark.createDataFrame([("/a/x/README.md", "1"), ("/b/x/README.md", "2"), ("/b/x/readme", "3"), ("/b/x/README.md", "2"), (None, "4")], "path string, text string")
    assert sorted((r.path, r.text, r.slug) for r in readers.preferred_readmes(files).collect()) == [("/a/x/README.md", "1", "x"), ("/b/x/README.md", "2", "x")]


def test_gates_leave_columns_of_their_names(spark):
    f = spark.createDataFrame([(1, "a", "clarity", 5, 7, 8), (1, "a", "clarity", 6, 7, 8), (2, "a", "safety", 1, 7, 8)], "doc_id int, id string, band string, pos int, allowed int, place int")
    allowed = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id int, id string")
    assert sorted((r.doc_id, r.pos, r.allowed, r.suppressed) for r in gates.suppress(f, allowed).collect()) == [(1, 5, 7, True), (1, 6, 7, True), (2, 1, 7, False)]
    assert [(r.pos, r.place) for r in gates.past_allowance(f, 1).collect()] == [(6, 8)]
