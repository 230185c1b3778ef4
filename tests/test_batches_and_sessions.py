"""The table of batches, and sessions with state that ends."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import sessions
from pagewarden.sources import batches
from pagewarden.streaming import jobs

T = dt.datetime(2024, 1, 1)
SCANS = "id long, ts timestamp, level string"
STEPS = "session long, step long, ts timestamp, hash string, fingerprint string"


def scans(spark, *rows):
    return spark.createDataFrame([(i, T + dt.timedelta(minutes=m), level) for i, m, level in rows], SCANS)


def stored(spark, folder):
    return sorted((r.id, r.level) for r in batches.read_batches(spark, folder, SCANS).collect())


def test_batches_count_once(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert stored(spark, folder) == []
    first = scans(spark, (1, 0, "old"), (1, 5, "new"), (2, 0, "two"), (2, 0, "two"))
    assert batches.save_batch(first, folder, 0) == 2
    assert batches.save_batch(first, folder, 0) == 0  # replayed
    assert batches.save_batch(scans(spark, (1, 9, "late"), (3, 0, "three")), folder, 1) == 1  # a stored id stays as it was
    assert batches.save_batch(scans(spark, (1, 9, "late")), folder, 2) == 0
    assert stored(spark, folder) == [(1, "new"), (2, "two"), (3, "three")]
    assert sorted(r.batch for r in batches.manifest_of(spark, folder).collect()) == [0, 1, 2]


def test_readers_see_whole_batches_only(spark, tmp_path, monkeypatch):
    """An attempt that ends between data and manifest is not read; the next one adds its rows once."""
    folder = f"file://{tmp_path}/t"
    batches.save_batch(scans(spark, (1, 0, "one")), folder, 0)

    def killed(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(batches, "name_attempt", killed)
        with pytest.raises(RuntimeError):
            batches.save_batch(scans(spark, (2, 0, "two"), (3, 0, "three")), folder, 1)
    assert stored(spark, folder) == [(1, "one")]
    assert spark.read.parquet(f"{folder}/rows").count() == 3
    assert batches.save_batch(scans(spark, (2, 0, "two"), (3, 0, "three")), folder, 1) == 2
    assert stored(spark, folder) == [(1, "one"), (2, "two"), (3, "three")]
    # two attempts of one batch that were both named count as one
    batches.write_rows(scans(spark, (4, 0, "four")), folder, "2-a")
    batches.write_rows(scans(spark, (4, 0, "four")), folder, "2-b")
    for attempt in ("2-b", "2-a"):
        batches.name_attempt(spark, folder, 2, attempt, 1)
    assert stored(spark, folder) == [(1, "one"), (2, "two"), (3, "three"), (4, "four")]


def test_a_stream_saves_each_id_once(spark, tmp_path):
    place, folder = tmp_path / "in", f"file://{tmp_path}/t"
    place.mkdir()
    for k, rows in enumerate([[(1, 0, "a"), (None, 0, "n")], [(1, 1, "b"), (2, 0, "c"), (None, 1, "m")]]):
        scans(spark, *rows).coalesce(1).write.mode("append").parquet(str(place))
        stream = spark.readStream.schema(SCANS).parquet(str(place))
        jobs.save_first(stream, folder, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    # a new checkpoint sends everything again, as batch 0, which is stored
    jobs.save_first(spark.readStream.schema(SCANS).parquet(str(place)), folder, f"{tmp_path}/other").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, batches.read_batches(spark, folder, SCANS).select("id", "level").collect()), key=repr)
    assert got == [(1, "a"), (2, "c"), (None, "n")]


def run(spark, tmp_path, parts, job, wait=0):
    """Runs a job on parts, one file each; a job with timeouts never rests, so its rows are waited for."""
    place, out, due = tmp_path / "in", [], 0
    place.mkdir()
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(place))
    query = job(stream).writeStream.trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:
        for k, rows in enumerate(parts):
            time.sleep(wait if k else 0)
            spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("append").parquet(str(place))
            due, until = due + len(rows), time.time() + 60
            while len(out) < due and time.time() < until:
                time.sleep(0.2)
    finally:
        query.stop()
    return out


def steps(n, sessions_=3):
    return [(s, k, T + dt.timedelta(seconds=k), f"h{(k * (s + 1)) % 5}" if (k + s) % 4 else None, f"p{k // (s + 2)}" if k % 7 else None) for k in range(n) for s in range(sessions_)]


def test_session_loops_equal_the_batch(spark, tmp_path):
    rows = steps(40)
    out = run(spark, tmp_path, [rows[:30], rows[30:33], rows[33:]], lambda s: jobs.session_loops(s, window=6))
    assert len(out) == len(rows)
    frame = spark.createDataFrame(rows, STEPS)
    counted = sessions.repetition(frame.where("hash IS NOT NULL").withColumn("action", F.lit("x")), window=6)
    streaks = sessions.stagnation(frame.where("fingerprint IS NOT NULL"))
    want = {(r.session, r.step): r.max_repetition for r in counted.collect()}
    same = {(r.session, r.step): r.stagnation for r in streaks.collect()}
    got = {(r.session, r.step): (r.max_repetition, r.stagnation) for r in out}
    assert all(got[k][0] == v for k, v in want.items()) and all(got[k][1] == v for k, v in same.items())


def test_idle_sessions_leave_the_state(spark, tmp_path):
    row = lambda k: [(1, k, T + dt.timedelta(seconds=k), "h", "p")]
    out = run(spark, tmp_path, [row(0) + row(1), row(2)], lambda s: jobs.session_loops(s, idle=2), wait=6)
    assert sorted((r.step, r.max_repetition, r.stagnation) for r in out) == [(0, 1, 0), (1, 2, 1), (2, 1, 0)]


def test_rolling_counts(spark, tmp_path):
    """Days of a stream in windows of a week, one a day; a window is told when the watermark has passed it."""
    day = dt.timedelta(days=1)
    place = tmp_path / "in"
    place.mkdir()
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(place))
    out = []
    query = jobs.rolling_counts(stream, days=2).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:
        for days in ([0, 0, 1], [9], [12]):
            spark.createDataFrame([(T + d * day,) for d in days], "ts timestamp").coalesce(1).write.mode("append").parquet(str(place))
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(tuple(r) for r in out)[:3] == [(T - day, 2), (T, 3), (T + day, 1)]
