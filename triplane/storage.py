"""Results that are kept while a job goes on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it.

    In local mode (tests), where driver and executors are one process, a temporary folder is made if that is unset; on a
    cluster there must be one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="triplane-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder: its lineage ends there and a lost executor loses none."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
