"""Folder for intermediate tables that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Raises where that is unset: a folder of one machine would leave parts of a table where
    others cannot read them.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if base is None:
        base = spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if not base:
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
