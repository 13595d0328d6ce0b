"""Where jobs that go in rounds leave their intermediate rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is absent, a session in one process (a local test) gets a temporary folder; a
    cluster has no folder of its own that all can read, so there it is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and go on from reliable checkpoint files, so that a round's plan doesn't hold those before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
