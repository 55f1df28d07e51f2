"""Tables held between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HELD: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the one set by code.

    Where neither is set, a local master gets a folder of its own; elsewhere a folder of
    one machine would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    by_code = context._jsc.sc().getCheckpointDir()
    if by_code.isDefined():
        return by_code.get()
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leafmark-"))
    return context._jsc.sc().getCheckpointDir().get()


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage like a reliable checkpoint, but computes the rows once,
    column-wise and compressed; a lost executor costs nothing already written.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted like a held table."""
    path = f"{shared_dir(spark).rstrip('/')}/leafmark-{name}-{uuid.uuid4().hex}"
    _HELD.append((spark, path))
    return path


def held_now() -> int:
    """A mark for :func:`release`."""
    return len(_HELD)


def release(since: int = 0, but: int = 0) -> None:
    """Delete the tables held after the mark (all at exit) except the newest ``but``: call
    it when what was made of them is written, and no plan reads them any more."""
    gone = _HELD[since : len(_HELD) - but]
    del _HELD[since : len(_HELD) - but]
    for spark, path in reversed(gone):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            return


atexit.register(release)
