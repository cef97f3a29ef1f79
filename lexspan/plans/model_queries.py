"""The model hook with a deterministic client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model
from .registry import query, table
from .span_queries import _ASSIGNED, _CANDIDATES, _VOTES, assigned


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passages").select("source_id", "ordinal", "text").distinct().where("text is not null")


_COUNTED = r"CAST(len(list_filter(string_split_regex(t, '[\s\x0B\x{001C}-\x{001F}\x{0085}\p{Z}]+'), lambda x: x <> '')) AS INT) AS words, CAST(NULL AS VARCHAR) AS error"


@query(f"""
SELECT source_id, {_COUNTED}
FROM (SELECT source_id, string_agg(text, chr(10) ORDER BY ordinal) AS t FROM (SELECT DISTINCT source_id, ordinal, text FROM passages WHERE text IS NOT NULL) GROUP BY source_id)
""")
def model_whole_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of each document, put to the client that counts words."""
    rows = model.payloads(texts(spark, sf_dir), "source_id", "ordinal", "text")
    return model.structured(model.ask(rows, "source_id", "payload", model.RuleClient()), "words int, longest string").select("source_id", F.col("parsed.words").alias("words"), "error")


@query(f"""
WITH {_CANDIDATES}, {_VOTES}, {_ASSIGNED}
SELECT source_id, {_COUNTED}
FROM (SELECT source_id, string_agg(text, chr(10) ORDER BY ordinal) AS t FROM (SELECT DISTINCT source_id, ordinal, text FROM passages WHERE text IS NOT NULL) p
  WHERE ordinal <= 60 OR EXISTS (SELECT 1 FROM assigned a WHERE a.source_id = p.source_id AND a.ordinal = p.ordinal AND a.kind IN ('heading', 'quotation')) GROUP BY source_id)
""")
def model_stage_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage's payload: the passages labelled as headings or quotations, wherever they stand, and the first 60."""
    kinds = assigned(spark, sf_dir).where("kind in ('heading', 'quotation')").select("source_id", "ordinal")
    rows = model.payloads(texts(spark, sf_dir), "source_id", "ordinal", "text", kinds=kinds, head=60)
    return model.structured(model.ask(rows, "source_id", "payload", model.RuleClient()), "words int, longest string").select("source_id", F.col("parsed.words").alias("words"), "error")


@query("SELECT DISTINCT source_id, CAST(NULL AS VARCHAR) AS error FROM passages WHERE text IS NOT NULL")
def model_whole_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers to the payloads of all passages."""
    rows = model.payloads(texts(spark, sf_dir), "source_id", "ordinal", "text")
    return model.recorded(rows, "source_id", model.ask(rows, "source_id", "payload", model.RuleClient())).select("source_id", "error")
