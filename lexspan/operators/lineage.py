"""Cutting a plan where its result is used several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once into the session's shared ``spark.checkpoint.dir`` and read from there.

    Where none is set, a local session gets a folder of its own, removed at exit; on a cluster the plan stays as it is, since
    no folder of one machine could hold its rows.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            return df
        folder = tempfile.mkdtemp(prefix="lexspan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
