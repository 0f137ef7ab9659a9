"""Cutting lineage in storage that outlives executors."""

import re
import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder all executors share; in local runs without one, a new temporary folder."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None and not re.match(r"local(\[|$)", context.master):  # local-cluster is a cluster
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="run-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize a table in the shared checkpoint folder and continue from there.

    Used where one result feeds several branches, or where range boundaries that
    were sampled must not be sampled again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
