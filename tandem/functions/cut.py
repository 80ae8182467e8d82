"""Cutting the lineage of tables that many later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from .windows import CHECKPOINTS, lookahead


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, from a checkpoint in the folder that driver and executors share (``spark.checkpoint.dir``);
    a temporary folder only on one machine (master local) where none is set, as in tests. What its plan reads ahead is kept for
    checks of plans that stand on it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tandem-"))
    fault, made = lookahead(df), df.checkpoint()
    CHECKPOINTS[made._jdf.queryExecution().analyzed().rdd().id()] = fault
    return made
