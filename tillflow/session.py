"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The JVM does not compile methods of more bytecode; past this size Spark splits the code instead.
METHOD_LIMIT = "8000"


def get_session(app: str = "tillflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": METHOD_LIMIT,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_compiled(spark: SparkSession) -> None:
    """Have Spark split generated code that the JVM would not compile, also in a session made elsewhere.

    The expressions over report text are long: as one method they run interpreted, at half the speed or less. Only
    how a plan runs depends on the setting, never its rows; a lower limit of the session stays.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > int(METHOD_LIMIT):
        spark.conf.set(limit, METHOD_LIMIT)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write: ``spark.checkpoint.dir``.

    Where a local session leaves it unset, a temporary folder is made and remembered;
    on a cluster an unset folder is an error, since a machine-local path would be lost
    with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillflow-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage: later steps read files, so losing an executor costs a
    re-read, and row ids assigned upstream can no longer change between evaluations.
    """
    keep_compiled(df.sparkSession)
    path = new_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
