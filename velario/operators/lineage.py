"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="velario-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def sorted_side(rows: DataFrame) -> DataFrame:
    """``rows`` as the right side of a join that sorts both sides.

    The planner broadcasts by the size of compressed files, and rows made from them may be many times
    as large: the driver would hold them. The hint goes last, right before the join.
    """
    return rows.hint("merge")


def cut(rows: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the shared folder: what follows plans from there on."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
