"""Cutting of lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed and kept in the folder that ``spark.checkpoint.dir`` names; lost executors don't lose them. Only
    where that is unset and master and workers are one machine, a temporary folder is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        key = "spark.checkpoint.dir"
        folder = df.sparkSession.conf.get(key, None) or context.getConf().get(key)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError(f"{key} must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tidewell-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
