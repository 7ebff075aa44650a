"""Sessions for tests and benchmarks, and tables that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_folders: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "lexigrid", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only a local session
    without one gets a temporary folder, because executors on other machines
    could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="lexigrid-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, under the id of the application,
    so that what a finished application left can be told apart."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str = "table", schema: StructType | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet and return the table read back, as ``schema`` if given.

    ``by``, the last column, deals rows out to folders; who asks for one of its values reads that folder only.

    Used where a result is read more than once, or where row order numbers
    must stay fixed.  A lost executor costs one file read, not the lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
