"""Unicode normalization, which Spark has no expression for: Arrow batches through Python."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType


@arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@arrow_udf(StringType())
def ascii_fold(texts: pa.Array) -> pa.Array:
    """Decomposed and without marks, for names of files."""
    return pa.array([None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts.to_pylist()], pa.string())
