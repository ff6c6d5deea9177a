"""Cutting the lineage of tables that are used several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, which executors share; on one machine, where that
    is unset, in a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="storyloom-")
        context.setCheckpointDir(base)
    return df.checkpoint()
