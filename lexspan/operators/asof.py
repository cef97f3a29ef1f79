"""The latest row before each row, of the same key and within a span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(left: DataFrame, right: DataFrame, key: str, micros: str, value: str, span_micros: int) -> DataFrame:
    """``left`` with ``value`` of the latest ``right`` row strictly before it and at most ``span_micros`` earlier.

    Time is cut into slots of the span's length; a row's latest predecessor lies in its own slot or the one
    before, so right rows are put into two slots and each (key, slot) is a small window: a hot key is
    spread over its slots. Null keys match nothing.
    """
    slot = F.floor(F.col(micros) / span_micros)
    a = left.withColumns({"__slot": slot, "__v": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(True)})
    b = right.where(F.col(key).isNotNull()).select(key, micros, F.explode(F.array(slot, slot + 1)).alias("__slot"), F.col(value).alias("__v"), F.lit(False).alias("__left"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key, "__slot").orderBy(micros).rangeBetween(-span_micros, -1)
    best = F.max(F.when(~F.col("__left"), F.struct(F.col(micros).alias("at"), F.col("__v").alias("v")))).over(w)
    return both.withColumn(value, best["v"]).where("__left").drop("__slot", "__v", "__left")
