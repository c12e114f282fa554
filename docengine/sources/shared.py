"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Used by sessions on one machine that name no folder.
ONE_MACHINE = "/tmp/checkpoints"

#: Paths of the tables that a session has built, by application, kind and source.
_BUILT: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a cluster without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return (folder or ONE_MACHINE).rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/docengine-{kind}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, kind: str) -> DataFrame:
    """The table written to the shared folder and read from there, which cuts its lineage."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def built_once(spark: SparkSession, kind: str, source: str, build: Callable[[str], None]) -> str:
    """The path of a structure over ``source`` that ``build`` writes the first time that a session asks for it."""
    key = (spark.sparkContext.applicationId, kind, source)
    if key not in _BUILT:
        path = new_path(spark, kind)
        build(path)
        _BUILT[key] = path
    return _BUILT[key]
