"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written by :func:`stored` in each :func:`scratch` that is open, the innermost last.
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nodeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, result: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back: a lost executor costs a reread, not a recomputation.

    The reread has sizes that the planner can check before it broadcasts. The table stays until
    :func:`forget` or the end of the :func:`scratch` that it was written in; a ``result`` belongs
    to the scratch around that one, if there is one.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if len(_open) > result:
        _open[-1 - result].append(out)
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete tables of :func:`stored` that nothing reads any more; other frames are passed over.

    Files of shuffles go when the driver's garbage is collected, which it seldom is on its own.
    """
    found = [(df, df._stored_at) for df in frames if getattr(df, "_stored_at", None)]
    for i, (df, path) in enumerate(found):
        if i == 0:
            df.sparkSession.sparkContext._jvm.System.gc()
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at its end all tables that :func:`stored` writes within it: write what is to stay elsewhere, or outside."""
    _open.append([])
    try:
        yield
    finally:
        forget(*_open.pop())
