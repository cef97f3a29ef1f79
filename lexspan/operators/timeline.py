"""Events of a job folded into its state, order-free where the rule allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_of(elapsed: Column, steps: list[tuple[int, str, int]]) -> Column:
    """struct(stage, progress) of the last step whose second has come."""
    out = F.struct(F.lit(steps[0][1]).alias("stage"), F.lit(steps[0][2]).alias("progress"))
    for second, name, progress in steps[1:]:
        out = F.when(elapsed >= second, F.struct(F.lit(name).alias("stage"), F.lit(progress).alias("progress"))).otherwise(out)
    return out


def progress_log(events: DataFrame, job: str, time: str, tie: list[str], steps: list[tuple[int, str, int]]) -> DataFrame:
    """Each event with its seconds since the job's first, its stage, and the progress, which never falls."""
    w = Window.partitionBy(job).orderBy(time, *tie)
    elapsed = F.floor((F.unix_micros(time) - F.min(F.unix_micros(time)).over(Window.partitionBy(job))) / 1_000_000).cast("bigint")
    staged = events.withColumn("elapsed", elapsed).withColumn("__s", stage_of(F.col("elapsed"), steps))
    top = F.max("__s.progress").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return staged.withColumns({"stage": F.col("__s.stage"), "progress": top}).drop("__s")


def final_states(events: DataFrame, job: str, time: str, kind: str, deadline_seconds: int) -> DataFrame:
    """(job, created_at, ended_at, state): created, then cancelled or timed out, one aggregate a job."""
    created = F.min(F.when(F.col(kind) == "create", F.col(time)))
    cancelled = F.min(F.when(F.col(kind) == "cancel", F.col(time)))
    per = events.groupBy(job).agg(created.alias("created_at"), cancelled.alias("__cancel"), F.max(time).alias("last_at"))
    live = F.col("__cancel").isNotNull() & (F.col("__cancel") >= F.col("created_at")) & (F.unix_micros("__cancel") <= F.unix_micros("created_at") + deadline_seconds * 1_000_000)
    state = F.when(F.col("created_at").isNull(), "unknown").when(live, "cancelled").when(F.unix_micros("last_at") > F.unix_micros("created_at") + deadline_seconds * 1_000_000, "timed_out").otherwise("open")
    return per.select(job, "created_at", "last_at", state.alias("state"))


def expired(states: DataFrame, now: Column, keep_seconds: int) -> DataFrame:
    """Jobs whose last event is older than they are kept."""
    return states.where(F.unix_micros(now) - F.unix_micros("last_at") > keep_seconds * 1_000_000)
