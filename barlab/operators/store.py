"""Cutting lineage with a table in the shared folder of the cluster."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_job: ContextVar[str] = ContextVar("job", default="")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A local-mode session without the setting (tests, checks) gets one
    of its own, which goes when Python ends. A cluster session without it is an error, because a machine-local folder
    would not survive the loss of an executor."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local:
        _local["dir"] = tempfile.mkdtemp(prefix="barlab-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return _local["dir"]


@contextmanager
def job(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside the block lie in a folder of their own and go at its end: write the result before."""
    folder = f"{shared_folder(spark)}/barlab/job-{uuid.uuid4().hex}"
    token = _job.set(folder)
    try:
        yield folder
    finally:
        _job.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a result is read more than once downstream (each reader would otherwise re-run the whole
    lineage). Unlike a cached or checkpointed RDD the table keeps column pruning and filter pushdown.
    """
    path = f"{_job.get() or shared_folder(df.sparkSession) + '/barlab'}/{uuid.uuid4().hex}"
    w = df.write.mode("error")
    (w.partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
