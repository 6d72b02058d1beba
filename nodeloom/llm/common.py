"""What the training-data operators share: tables, lineage cuts, hot keys."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import forget as drop_cut
from ..lineage import scratch
from ..lineage import stored as cut

__all__ = ["HOT_KEYS", "attach", "cut", "drop_cut", "give_back", "hot_keys", "packed", "scratch", "small_batches", "table"]

#: A key is hot when it has more than 1/HOT_KEYS of all rows, so there are at
#: most HOT_KEYS - 1 hot keys whatever the input: a proven bound for broadcasts.
HOT_KEYS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by its name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let this session hand rows to Python in batches of at most ``rows``.

    Whole texts may be long; with Spark's 10,000 rows a batch alone can outgrow an executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Return what this worker has freed to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The named columns (all, if none) as one struct, so no name of theirs can clash."""
    names = df.columns if columns is None else columns
    return F.struct(*[df[n] for n in names]) if names else F.struct(F.lit(None).cast("int").alias("none"))


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Keys with more than ``total / HOT_KEYS`` rows: fewer than HOT_KEYS rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT_KEYS > total).select(*keys)


def attach(rows: DataFrame, values: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Join of ``rows`` with ``values`` (one row for a key) that no hot key can skew: left, inner or left_semi.

    Rows of hot keys meet a broadcast of fewer than HOT_KEYS rows and are not moved; all
    others are joined by key, where a key has at most ``1/HOT_KEYS`` of the rows.
    """
    hot = hot.select(*keys)
    warm = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(values.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    cold = rows.join(F.broadcast(hot), keys, "left_anti").join(values, keys, how)
    return warm.unionByName(cold)
