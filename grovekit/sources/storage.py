"""Where loops cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once to the folder that the session names in spark.checkpoint.dir.

    Only a session on one machine without it (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
