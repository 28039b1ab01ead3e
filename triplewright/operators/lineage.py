"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that it is planned and computed once.

    The folder is that of the session (``spark.checkpoint.dir``); only a local session may run without one and then
    gets a temporary folder of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="triplewright-"))
    return df.checkpoint()
