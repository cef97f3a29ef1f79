"""Streams of requests: rate limits with keyed state, late data, and running states of jobs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import admit


def rate_limited(requests: DataFrame, key: str = "client", time: str = "requested_at", tie: str = "job_id", span_seconds: int = 3600, most: int = 12, late: str = "2 hours") -> DataFrame:
    """(key, tie, time, accepted) of a stream; the state of a key is its accepted times, ``most`` at the most.

    Within a micro-batch requests are decided in order of time. State goes when the watermark, ``late`` behind the
    latest request, has passed the span after a key's last one.
    """
    kind, tie_kind = requests.schema[key].dataType.simpleString(), requests.schema[tie].dataType.simpleString()
    span = span_seconds * 1_000_000

    def decide(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values([time, tie], kind="stable")
        micros = rows[time].astype("datetime64[us]").astype("int64")
        accepted = [admit(log, int(t), span, most) for t in micros]
        state.update((list(log),))
        state.setTimeoutTimestamp(max(int(micros.iloc[-1]) // 1000 + span_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], tie: rows[tie], time: rows[time], "accepted": accepted})

    return requests.select(key, tie, time).withWatermark(time, late).groupBy(key).applyInPandasWithState(decide, f"{key} {kind}, {tie} {tie_kind}, {time} timestamp, accepted boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(requests: DataFrame, time: str = "requested_at", late: str = "2 hours", width: str = "1 hour", by: str = "kind") -> DataFrame:
    """Requests in each window of event time; what comes later than ``late`` no longer counts."""
    return requests.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def once_each(requests: DataFrame, keys: list[str], time: str = "requested_at", late: str = "2 hours") -> DataFrame:
    """Requests delivered again within the watermark are dropped."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def job_states(requests: DataFrame, job: str = "job_id", kind: str = "kind", time: str = "requested_at") -> DataFrame:
    """The running first and last event of each job, for an update or complete sink."""
    return requests.groupBy(job).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.max_by(kind, F.struct(time, kind)).alias("last_kind"), F.count("*").alias("events"))


#: Where each kind of request leads from a state; any other request leaves the state as it is.
TRANSITIONS = {("none", "create"): "queued", ("queued", "start"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled"}


def job_machine(requests: DataFrame, deadline_seconds: dict[str, int], job: str = "job_id", kind: str = "kind", mode: str = "run_mode", time: str = "requested_at", late: str = "2 hours", transitions: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(job, at, state) of every change of state of a stream of requests, deadlines included.

    A job that is still queued or running when its mode's deadline has passed since it was made becomes ``timed_out`` at that
    moment: seen by a later request of the job, or else by the watermark, ``late`` behind the latest request. Within a
    micro-batch requests are taken in order of time. Finished jobs keep their state until the watermark has passed their
    deadline, so that what is repeated within it changes nothing; after that the state goes.
    """
    steps = transitions or TRANSITIONS
    kind_of_job = requests.schema[job].dataType.simpleString()
    default = max(deadline_seconds.values())
    open_states = ("queued", "running")

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, deadline = state.get if state.exists else ("none", 0)
        changes: list[tuple[int, str]] = []
        if state.hasTimedOut:
            if current in open_states:
                changes.append((deadline, "timed_out"))
            state.remove()
        else:
            rows = pd.concat(list(frames))
            rows = rows.assign(__at=rows[time].astype("datetime64[us]").astype("int64")).sort_values(["__at", kind], kind="stable")
            for what, how, at in zip(rows[kind], rows[mode], rows["__at"]):
                if current in open_states and at > deadline:
                    current = "timed_out"
                    changes.append((deadline, current))
                following = steps.get((current, what))
                if following is not None:
                    if current == "none":
                        deadline = int(at) + deadline_seconds.get(how, default) * 1_000_000
                    current = following
                    changes.append((int(at), current))
            if current == "none":
                return
            state.update((current, deadline))
            state.setTimeoutTimestamp(max(deadline // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if changes:
            yield pd.DataFrame({job: name[0], "at": pd.to_datetime([at for at, _ in changes], unit="us"), "state": [what for _, what in changes]})

    return (
        requests.select(job, kind, mode, time)
        .withWatermark(time, late)
        .groupBy(job)
        .applyInPandasWithState(step, f"{job} {kind_of_job}, at timestamp, state string", "state string, deadline long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def append_versions(path: str):
    """A foreachBatch function that writes each batch to a folder of its own; a batch tried again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_versions(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """The last version of each key among all batches written by :func:`append_versions`; of equals the later batch."""
    log = spark.read.parquet(path)
    columns = [c for c in log.columns if c not in (*keys, "batch")]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(version, "batch", *[c for c in columns if c != version])).alias("r"))
    return best.select(*keys, "r.*")
