"""The hook for a model: structured answers for rows of text, from any client, in Arrow batches.

The engine depends on no service. A client is a picklable object with ``answer``; the recorded one looks
answers up in a table of earlier results, so that runs can be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


class ModelClient(Protocol):
    def answer(self, payload: str) -> str:
        """A JSON answer to a JSON payload; raising an exception fails this row only."""


class RuleClient:
    """A deterministic stand-in: names the longest word and the number of words."""

    def answer(self, payload: str) -> str:
        words = json.loads(payload).get("text", "").split()
        return json.dumps({"words": len(words), "longest": max(words, key=lambda w: (len(w), w), default="")}, ensure_ascii=False)


def ask(rows: DataFrame, key: str, payload_col: str, client: ModelClient, attempts: int = 2) -> DataFrame:
    """(key, answer, error): the client's answer to each payload, tried again after an error; errors become values."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for payload in batch.column(1).to_pylist():
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = (client.answer(payload), None) if payload is not None else (None, "no_payload")
                        break
                    except Exception as e:  # a row's failure is that row's result
                        error = type(e).__name__
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[key, "answer", "error"])

    return rows.select(key, payload_col).mapInArrow(run, f"{key} {kind}, answer string, error string")


def recorded(rows: DataFrame, key: str, answers: DataFrame) -> DataFrame:
    """(key, answer, error) from a table of recorded answers: a join, no Python."""
    return rows.select(key).join(answers.select(key, "answer"), key, "left").select(key, "answer", F.when(F.col("answer").isNull(), F.lit("not_recorded")).alias("error"))


def structured(answers: DataFrame, schema: str) -> DataFrame:
    """Answers read tolerantly: what doesn't fit the schema is null."""
    return answers.withColumn("parsed", F.from_json("answer", schema, {"mode": "PERMISSIVE"}))


def review_context(passages: DataFrame, anchors: DataFrame, head: int = 45, tail: int = 90, key: str = "source_id", order: str = "ordinal", id_col: str = "id") -> DataFrame:
    """(key, order, in_head, in_tail, named): the passages a reviewer sees: the first, the last, and those that evidence names."""
    placed = numbered(passages.select(key, order, id_col).distinct(), key, order)
    named = anchors.select(key, F.explode("passage_ids").alias(id_col)).distinct().withColumn("__named", F.lit(True))
    joined = placed.join(named, [key, id_col], "left")
    seen = joined.select(key, order, (F.col("rn") <= head).alias("in_head"), (F.col("n") - F.col("rn") < tail).alias("in_tail"), F.coalesce("__named", F.lit(False)).alias("named"))
    return seen.where("in_head or in_tail or named")


def payloads(passages: DataFrame, key: str, order: str, text: str, kinds: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """(key, payload): the passages of a document that a stage asks about, as one JSON, in order.

    Passages are chosen by a semi-join with ``kinds`` (key and order), those of the head added. A payload is for
    one call, whose size the caller bounds by the choice.
    """
    chosen = passages.join(kinds, [key, order], "left_semi") if kinds is not None else passages
    if head is not None:
        first = passages.where(F.col(order) <= head)
        chosen = chosen.unionByName(first.join(chosen.select(key, order), [key, order], "left_anti"))
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return chosen.groupBy(key).agg(F.to_json(F.struct(F.array_join(F.transform(listed, lambda x: x[text]), "\n").alias("text"))).alias("payload"))
