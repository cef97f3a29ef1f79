"""Arrow-batched row mapping shared by the operators of this package.

An operator hands over a *factory*; it is called once a partition, so that models and
vocabularies are set up once, and returns a function over small chunks of Python lists.
Only the named columns reach Python, whatever else the input carries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to an operator at once; bounds what a Python worker holds besides the Arrow batch.
CHUNK_ROWS = 256

ChunkFn = Callable[[list[list]], Sequence[Sequence]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Fewer input splits than cores (small files): deal the rows out before the heavy step.

    Spark cuts files down to 4 MB to occupy all cores, so this concerns inputs below 2 MB a core, or single row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def bounded_sample(df: DataFrame, columns: Sequence[str], rows: int) -> list[tuple]:
    """About ``rows`` distinct rows of ``columns``, never more than twice as many, in order of a hash of their content.

    Rows whose first column is null are left out. Rows are taken by a threshold of the hash, which follows from their number alone: only the sample leaves
    the executors, and it is the same however the input is partitioned. Copies of a row count once.
    """
    total = df.count()  # from the files' footers
    sampled = df.select(*columns).where(F.col(columns[0]).isNotNull()).withColumn("__h", F.xxhash64(*columns))
    if total > rows:
        sampled = sampled.where(F.col("__h") <= F.lit(-(2**63) + int(2**64 * rows / total)))
    found = sampled.distinct().limit(2 * rows).collect()
    return [tuple(r)[:-1] for r in sorted(found, key=lambda r: r["__h"])]


def arrow_map(df: DataFrame, columns: Sequence[str], schema: str, factory: Callable[[], ChunkFn], chunk: int = CHUNK_ROWS) -> DataFrame:
    """Map ``columns`` of ``df`` through ``factory()``; the result has exactly ``schema``.

    The chunk function gets one list per column and returns one sequence per output column;
    it may return more or fewer rows than it got.
    """
    struct = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = fn([part.column(i).to_pylist() for i in range(part.num_columns)])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow_schema)]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    return df.select(*columns).mapInArrow(run, struct)


#: Rows counted at once, and the counts kept until they are added up.
TALLY_ROWS, TALLY_KEPT = 2048, 1_000_000

Tally = tuple[np.ndarray, np.ndarray]


def added(parts: Sequence[Tally]) -> Tally:
    """Each item once, with the sum of its counts."""
    items, at = np.unique(np.concatenate([np.empty(0, np.int64), *(i for i, _ in parts)]), return_inverse=True)
    sums = np.zeros(len(items), np.int64)
    np.add.at(sums, at, np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)]))
    return items, sums


def arrow_tally(df: DataFrame, columns: Sequence[str], factory: Callable[[], Callable[[list[list]], Tally]]) -> Tally:
    """The items that ``factory()`` finds in all rows, each with the sum of its counts.

    The chunk function returns an array of numbers and one of their counts. They are added up in each partition, then among
    them; what reaches the driver is as large as the set of items, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, kept, size = factory(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TALLY_ROWS):
                part = batch.slice(at, TALLY_ROWS)
                kept.append(fn([part.column(i).to_pylist() for i in range(part.num_columns)]))
                size += len(kept[-1][0])
                if size > TALLY_KEPT:
                    kept = [added(kept)]
                    size = 0
        items, sums = added(kept)
        for at in range(0, len(items), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(items[at : at + 100_000]), pa.array(sums[at : at + 100_000])], ["item", "n"])

    found = df.select(*columns).mapInArrow(run, "item bigint, n bigint").groupBy("item").agg(F.sum("n").alias("n")).toArrow()
    return found["item"].to_numpy(), found["n"].to_numpy()
