"""Summaries of documents, batches and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, omitted


def length_diagnostics(items: DataFrame, key: str, size: Column, at_max: int) -> DataFrame:
    """Count, sum and order statistics of sizes by key; the rank of a fraction f is floor((n - 1) f).

    Sizes are first counted by value, so that a hot key is combined before the shuffle and no task
    gathers more than the distinct sizes of one key. Ranks come from running sums of these counts.
    """
    counted = items.groupBy(key, size.cast("int").alias("size")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("size")
    ranked = counted.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))

    def at(fraction: float) -> Column:
        rank = F.floor((F.col("total") - 1) * F.lit(fraction)) + 1
        return F.min(F.when(F.col("upto") >= rank, F.col("size")))

    return ranked.groupBy(key).agg(
        F.sum("n").alias("n_passages"), F.sum(F.col("n") * F.col("size")).alias("passage_chars"), F.min("size").alias("minimum"), at(0.5).alias("median"), at(0.9).alias("p90"), at(0.95).alias("p95"),
        at(0.99).alias("p99"), F.max("size").alias("maximum"), F.sum(F.when(F.col("size") >= at_max, F.col("n")).otherwise(0)).alias("n_at_max"),
    )


def batch_summary(rows: DataFrame, ok: Column, measures: dict[str, Column], strict: Column) -> DataFrame:
    """One row: attempted, succeeded, failed, strict; means of the measures over successes, each row's value rounded before."""
    mean = lambda c: F.floor(F.avg(F.when(ok, F.floor(c + F.lit(0.5)))) + F.lit(0.5)).cast("bigint")
    return rows.agg(F.count("*").alias("attempted"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & strict).alias("strict"), *[mean(c).alias(f"mean_{n}") for n, c in measures.items()])


def markdown_table(rows: DataFrame, order: str, columns: Sequence[str], longest: int = 60) -> DataFrame:
    """(position, line): a Markdown table of a bounded report, one line a row; bars become slashes, cells are cut.

    Lines are numbered in order instead of being joined, so that a table of any length stays distributed.
    """
    cell = lambda c: F.replace(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, longest), F.lit("|"), F.lit("/"))
    body = rows.select(F.col(order).cast("bigint").alias("position"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "position bigint, line string")
    return head.unionByName(body)


def html_table(rows: DataFrame, order: str, columns: Sequence[str], failed: Column, reason: Column) -> DataFrame:
    """(position, line): an HTML table, cells escaped; a failed row has its first column and the reason over the others."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    good = F.concat(*[cell(F.col(c)) for c in columns])
    bad = F.concat(cell(F.col(columns[0])), F.lit(f'<td colspan="{len(columns) - 1}" class="failed">'), escape_html(F.coalesce(reason, F.lit(""))), F.lit("</td>"))
    body = rows.select(F.col(order).cast("bigint").alias("position"), F.concat(F.lit("<tr>"), F.when(failed, bad).otherwise(good), F.lit("</tr>")).alias("line"))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    last = rows.agg((F.coalesce(F.max(F.col(order).cast("bigint")), F.lit(0)) + 1).alias("position"), F.lit("</table>").alias("line"))
    return rows.sparkSession.createDataFrame([(0, head)], "position bigint, line string").unionByName(body).unionByName(last)


def compacted(records: DataFrame, omit: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Records without what is too long to carry along: some columns say how long they were, others go."""
    return records.withColumns({c: omitted(c) for c in omit}).drop(*drop)


def numbered_lines(rows: DataFrame, order: Sequence[str], prefix: int = 40) -> DataFrame:
    """``rows`` with ``position`` by several columns, nulls last, the first of them a string: rows are numbered within ranges of its beginning."""
    cut = rows.withColumn("__range", F.coalesce(F.substring(order[0], 1, prefix), F.lit("\U0010ffff")))
    w = Window.orderBy("__range")
    before = cut.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return cut.join(before, "__range").withColumn("position", F.col("__before") + inside).drop("__range", "__before")


def severity_counts(issues: DataFrame, key: str, severities: Sequence[str]) -> DataFrame:
    return issues.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in severities], F.bool_or(F.col("severity") == severities[0]).alias(f"any_{severities[0]}"))
