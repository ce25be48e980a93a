"""Streams give what the same operators give on whole tables; late events are left out, repeats dropped."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliant.streaming import pages

SF = "/root/testdata/sf0.001"


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_profile_of_a_stream(spark, tmp_path):
    events = pages.event_time(spark.read.parquet(f"{SF}/events.parquet"))
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = run(pages.profile(stream, "1 day"), "whole", "complete")
    want = pages.profile(events, "1 day")
    key = lambda df: sorted((r.start, r.op, r.calls, round(r.total, 6), r.peak) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) > 5
    assert pages.sessions(events, "10 minutes").agg(F.sum("calls")).head()[0] == events.count()


def test_late_events_and_repeats(spark, tmp_path):
    start = datetime(2026, 1, 1)
    batches = [[("a", 0), ("b", 1)], [("c", 60)], [("c", 62)], [("d", 2), ("a", 61), ("e", 90)], [("f", 200)]]  # d comes an hour late
    for k, rows in enumerate(batches):
        spark.createDataFrame([(n, start + timedelta(minutes=m), 1.0) for n, m in rows], "event_type string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
        for f in (tmp_path / f"s{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.op, r.start.minute + 60 * r.start.hour) for r in run(pages.profile(stream, "10 minutes", late="5 minutes"), "late").collect()}
    assert ("a", 0) in got and ("b", 0) in got and ("c", 60) in got and not any(op == "d" for op, _ in got)
    kept = run(pages.drop_repeats(stream, "event_type", "ts", "3 hours"), "once")
    assert sorted(r.event_type for r in kept.collect()) == ["a", "b", "c", "d", "e", "f"]


def test_predictions_and_pictures(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.jsonl").write_text('{"file": "a"}\n\n{"file": "b"}\n')
    assert sorted(r.file for r in run(pages.prediction_stream(spark, str(tmp_path / "p"), "file string"), "lines").collect()) == ["a", "b"]
    (tmp_path / "i").mkdir()
    for k in range(3):
        (tmp_path / "i" / f"{k}.png").write_bytes(bytes([k]))
    seen = []
    q = pages.picture_batches(spark, str(tmp_path / "i"), str(tmp_path / "c"), lambda df, k: seen.append((k, sorted(bytes(r.content)[0] for r in df.collect()))), files=2)
    q.processAllAvailable()
    q.stop()
    assert sorted(b for _, own in seen for b in own) == [0, 1, 2] and [k for k, _ in seen] == list(range(len(seen)))
