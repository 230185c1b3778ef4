"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect
from ..sources import batches


def first_by_id(stream: DataFrame, key: str = "id", ts: str = "ts", late: str = "30 days") -> DataFrame:
    """Each id once, within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def save_first(stream: DataFrame, folder: str, checkpoint: str, key: str = "id", ts: str = "ts"):
    """A query that adds each id once to a table of batches (see ``sources.batches``): a retried batch and an id that is stored add nothing,
    however late they come."""
    return stream.writeStream.foreachBatch(batches.batch_writer(folder, key, ts)).option("checkpointLocation", checkpoint)


def daily_trend(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    day = F.window(ts, "1 day")
    grouped = stream.withWatermark(ts, late).groupBy(day).agg(F.floor(F.avg("score") + 0.5).cast("long").alias("avg_score"), F.count(F.lit(1)).alias("scan_count"))
    return grouped.select(F.to_date("window.start").alias("date"), "avg_score", "scan_count")


def rolling_counts(stream: DataFrame, days: int = 7, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{days} days", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("from"), "n")


def loops(stream: DataFrame, window: int = 20) -> DataFrame:
    """session, ts, hash and the highest frequency of one hash in the last ``window`` actions, by arrival."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values(["ts", "step"])
            most = []
            for h in frame["hash"]:
                last = [*last, h][-window:]
                most.append(max(last.count(x) for x in set(last)))
            yield pd.DataFrame({"session": key[0], "step": frame["step"], "max_repetition": most})
        state.update((last,))

    return stream.groupBy("session").applyInPandasWithState(
        update, "session bigint, step bigint, max_repetition int", "last array<string>", "append", GroupStateTimeout.NoTimeout
    )


def session_loops(stream: DataFrame, window: int = 20, kept: int = 5, idle: int = 3_600) -> DataFrame:
    """session, step, max_repetition, stagnation of steps (session, step, ts, hash, fingerprint) by arrival: the highest frequency of one hash in the
    last ``window`` actions (a null hash is none) and for how many steps the page's fingerprint has not changed (a null one is not looked at). State
    is those hashes, the last ``kept`` fingerprints, the streak and the time of the last step; a session that is idle for ``idle`` seconds leaves it and begins
    anew when it comes back."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        hashes, prints, streak, seen = state.get if state.exists else ((), (), 0, now)
        hashes, prints, streak = (list(hashes), list(prints), streak) if now - seen < idle * 1000 else ([], [], 0)
        for frame in frames:
            out = []
            for step, action, page in frame.sort_values(["ts", "step"])[["step", "hash", "fingerprint"]].itertuples(index=False):
                if isinstance(action, str):
                    hashes = [*hashes, action][-window:]
                if isinstance(page, str):
                    streak = streak + 1 if prints and prints[-1] == page else 0
                    prints = [*prints, page][-kept:]
                out.append((key[0], step, max((hashes.count(h) for h in set(hashes)), default=0), streak))
            yield pd.DataFrame(out, columns=["session", "step", "max_repetition", "stagnation"])
        state.update((hashes, prints, int(streak), now))
        state.setTimeoutDuration(idle * 1000)

    return stream.groupBy("session").applyInPandasWithState(
        update, "session bigint, step bigint, max_repetition int, stagnation int", "hashes array<string>, prints array<string>, streak int, seen bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def session_phases(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Progress of sessions (session, ts, type, phase): the newest phase, steps begun, ended and open, by session window. Events later than
    the watermark are left out; an older event never replaces a newer phase."""
    grouped = stream.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("during"))
    counted = grouped.agg(F.max_by("phase", "ts").alias("phase"), F.count_if(F.col("type") == "step-start").alias("begun"), F.count_if(F.col("type").isin("step-complete", "step-fail")).alias("ended"))
    return counted.select("session", F.col("during.start").alias("since"), "phase", "begun", "ended", (F.col("begun") - F.col("ended")).alias("open"))


def keep_newest(folder: str, key: str = "page_id", ts: str = "ts"):
    """A ``foreachBatch`` function that writes the newest row of each key of a batch; a batch that is tried again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch, key, ts).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def newest(rows: DataFrame, key: str = "page_id", ts: str = "ts") -> DataFrame:
    """The row of each key with the latest time; of equal times the greatest row."""
    rest = [c for c in rows.columns if c not in (key, ts)]
    best = rows.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("r_"))
    return best.select(key, *[F.col(f"r_.{c}").alias(c) for c in (ts, *rest)])


def plan_gates(stream: DataFrame) -> DataFrame:
    """plan, step, status of steps as they arrive (plan, step, depends_on, ok), in step order from 1: a step waits for those before it, is skipped if
    a dependency is not completed, and the first failure ends the plan."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, over, done, ids, oks, needs = state.get if state.exists else (1, False, [], [], [], [])
        held = {i: (ok, list(n)) for i, ok, n in zip(ids, oks, needs)}
        for frame in frames:
            for step, need, ok in zip(frame["step"], frame["depends_on"], frame["ok"]):
                if step >= at:
                    held.setdefault(int(step), (bool(ok), [] if need is None else [int(n) for n in need]))
        out, done = [], list(done)
        while at in held and not over:
            ok, need = held.pop(at)
            status = "skipped" if not set(need) <= set(done) else "completed" if ok else "failed"
            if status == "completed":
                done.append(at)
            over = status == "failed"
            out.append((key[0], at, status))
            at += 1
        if over:
            held = {}
        state.update((at, over, done, list(held), [h[0] for h in held.values()], [h[1] for h in held.values()]))
        yield pd.DataFrame(out, columns=["plan", "step", "status"])

    return stream.groupBy("plan").applyInPandasWithState(
        update, "plan string, step bigint, status string", "at bigint, over boolean, done array<bigint>, ids array<bigint>, oks array<boolean>, needs array<array<bigint>>", "append", GroupStateTimeout.NoTimeout
    )


def scan_arriving(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, kind (pii or injection), category, value, start of what the rules find in each arriving page: no state, so a
    stream gives the same rows as a batch."""
    pii = detect.pii_matches(pages, key, html).select(key, F.lit("pii").alias("kind"), "category", "value", "start")
    found = detect.injections(pages, (key,), html).select(key, F.lit("injection").alias("kind"), F.col("type").alias("category"), F.col("content").alias("value"), "start")
    return pii.unionByName(found)


def arriving_messages(messages: DataFrame, now: Column, keyword: str = "", minutes: int = 5, text: str = "text") -> DataFrame:
    """Messages (ts, text) newer than ``minutes`` before ``now`` that hold the keyword, in either case."""
    recent = messages.where(F.col("ts") > now - F.make_dt_interval(mins=F.lit(minutes)))
    return recent.where(F.contains(F.lower(text), F.lit(keyword.lower()))) if keyword else recent
