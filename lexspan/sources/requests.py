"""JSON request bodies: a size cap, an object, known fields; anything else becomes an error code in its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = 2_500_000


def parse_bodies(requests: DataFrame, body_col: str, schema: T.StructType | str, largest: int = LARGEST) -> DataFrame:
    """The input columns, ``parsed`` and ``error`` (too_large, not_json, not_object or null)."""
    body = F.col(body_col)
    error = (
        F.when(F.octet_length(body) > largest, F.lit("too_large"))
        .when(body.isNull() | F.try_parse_json(body).isNull(), F.lit("not_json"))
        .when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT") == F.lit(False), F.lit("not_object"))
    )
    return requests.withColumn("error", error).withColumn("parsed", F.when(F.col("error").isNull(), F.from_json(body, schema)))


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds, in order; null if none does."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(checks):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out
