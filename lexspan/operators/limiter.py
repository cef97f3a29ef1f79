"""Sliding-log rate limits: at most n accepted requests of a key within a span; rejected ones don't count.

Each decision depends on the ones before it, so requests of a key are folded in order. State is forgotten
after a pause as long as the span, and such pauses cut a key's history into stretches that are decided
alone. They are found from hourly extremes of each key, which combine before the shuffle. A stretch
passes through its task as a stream that holds at most n times, however long it is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admit(log: deque, at: int, span: int, most: int) -> bool:
    """Whether a request at ``at`` is accepted, given the accepted times; the log is brought up to date."""
    while log and at - log[0] >= span:
        log.popleft()
    if len(log) >= most:
        return False
    log.append(at)
    return True


def stretches(requests: DataFrame, key: str, micros: Column, span: int) -> DataFrame:
    """``requests`` with ``__stretch``: the start of the run of requests without a pause of ``span``.

    Requests are cut into slots of the span's length. A pause of that length can only lie between two slots,
    the last request of the one and the first of the next, so the extremes of slots tell all.
    """
    slotted = requests.withColumn("__at", micros).withColumn("__slot", F.floor(F.col("__at") / span))
    ends = slotted.groupBy(key, "__slot").agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    w = Window.partitionBy(key).orderBy("__slot")
    fresh = F.col("__first") - F.lag("__last").over(w) >= span
    marked = ends.withColumn("__new", F.when(F.lag("__slot").over(w).isNull() | fresh, F.col("__slot")))
    marked = marked.withColumn("__stretch", F.last("__new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.select(F.col(key).alias("__key"), F.col("__slot").alias("__s"), "__stretch")
    return slotted.join(marked, slotted[key].eqNullSafe(F.col("__key")) & (slotted["__slot"] == F.col("__s"))).drop("__key", "__s", "__slot")


def sliding_log(requests: DataFrame, key: str, time: str, tie: list[str], span_seconds: int = 3600, most: int = 12) -> DataFrame:
    """``requests`` with ``accepted``; ``tie`` orders requests of one time. A null key is a key of its own."""
    span = span_seconds * 1_000_000
    rows = stretches(requests, key, F.unix_micros(time), span)
    order = [c for c in ("__key_text", "__stretch", "__at", *tie)]
    columns = requests.columns
    placed = rows.withColumn("__key_text", F.coalesce(F.col(key).cast("string"), F.lit("\x00"))).repartition("__key_text", "__stretch").sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", accepted boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, log = None, deque()
        for batch in batches:
            out = []
            names = batch.schema.names
            keys, starts, times = (batch.column(names.index(c)).to_pylist() for c in ("__key_text", "__stretch", "__at"))
            for k, s, t in zip(keys, starts, times):
                if (k, s) != current:
                    current, log = (k, s), deque()
                out.append(admit(log, t, span, most))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(out)], names=[*columns, "accepted"])

    return placed.select(*columns, "__key_text", "__stretch", "__at").mapInArrow(fold, schema)
