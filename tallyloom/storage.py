"""Tables that cut lineage: written once to the cluster's shared folder and read back.

``spark.checkpoint.dir`` names the folder every executor sees.  A table written there survives the
loss of any executor, and a later job reads it with a fixed schema.  Where the setting is absent
and the session is local (tests, notebooks) a folder below the system's temporary directory is used; on a
cluster it must be set.  Tables belong to the run in which they were written, see ``run``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[tuple[str | None, str]]] = {}
_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def run(name: str) -> Iterator[None]:
    """Tables written inside belong to this run, so that ``release`` of it spares all others."""
    token = _run.set(name)
    try:
        yield
    finally:
        _run.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = f"file://{tempfile.gettempdir()}/tallyloom-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a frame that reads it.

    ``release`` spares a table written with ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _written.setdefault(spark.sparkContext.applicationId, []).append((_run.get(), path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes like a table's."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((_run.get(), path))
    return path


def release(spark: SparkSession, run: str | None = None) -> None:
    """Delete the tables of a run, or every table written so far.  Frames that read them become unusable."""
    written = _written.pop(spark.sparkContext.applicationId, [])
    spared = [x for x in written if run is not None and x[0] != run]
    if spared:
        _written[spark.sparkContext.applicationId] = spared
    for own, path in written:
        if run is None or own == run:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
