"""Writing results: JSON records, Markdown reports, and counts seen on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, json_col: str = "record", per_file: int = 10_000) -> None:
    """JSON lines of one column, files of a bounded number of records."""
    records.select(F.col(json_col).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def write_report(lines: DataFrame, path: str, position: str = "position", line: str = "line") -> None:
    """Lines in the order of their position. A report is small; long tables belong into :func:`write_records`."""
    lines.orderBy(position).coalesce(1).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def counted(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows and measures, taken when it is next run: an audit without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in measures.items()]), seen
