"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_JOB_FOLDER: ContextVar[str | None] = ContextVar("job_folder", default=None)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **settings) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("doctriage")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a single-process session without the setting, as in tests, gets a scratch folder of its
    own; ``local-cluster`` and every real cluster must name one.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="doctriage-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder of few entries, as a folder of open runs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(target)] if files.exists(target) else []


def path_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """No rows.  The optimizer sees that and leaves out what would be joined with them; an empty list would
    be read by Python workers in every join."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in fields]
    return spark.range(1).select(*nothing).filter(F.lit(False))


def stages_folder(spark: SparkSession) -> str:
    return _JOB_FOLDER.get() or f"{shared_folder(spark)}/stages"


@contextmanager
def job_stages(spark: SparkSession) -> Iterator[None]:
    """Give a job a folder of its own for its stages and delete it when the job ends.

    What the job returns must not be read from its stages.
    """
    folder = f"{stages_folder(spark)}/job-{uuid.uuid4().hex}"
    token = _JOB_FOLDER.set(folder)
    try:
        yield
    finally:
        _JOB_FOLDER.reset(token)
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Used where one narrow result feeds several branches: the wide scan behind it runs once, the
    lineage ends at durable files, and a lost executor re-reads them instead of the raw content.
    """
    spark = df.sparkSession
    path = f"{stages_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    staged = spark.read.schema(schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete the files behind staged tables that nothing reads any more."""
    for df in staged:
        path = df.__dict__.get("_staged_at")
        if path:
            delete_path(df.sparkSession, path)
