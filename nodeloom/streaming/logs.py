"""Event logs as Structured Streams: windows over them, routing, rollups, consumer lag."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TUMBLING_AGGREGATES = ("count", "sum", "min", "max", "avg")


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A log kept as Parquet files, as a stream; files are taken in the order of their names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str, start: str = "earliest") -> DataFrame:
    """A Kafka topic: key, value, topic, partition, offset, timestamp (needs Spark's Kafka package on the class path)."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Append key and value to a Kafka topic."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def windowed(log: DataFrame, at: str, width: str, every: str | None = None, keys: tuple[str, ...] = (), value: str | None = None, retention: str | None = None, align: str | None = None) -> DataFrame:
    """Tumbling (or hopping) windows by key with count, and sum, min, max, avg of a value.

    Rows that come later than the retention are dropped; a batch engine would refuse them.
    """
    log = log.withWatermark(at, retention) if retention else log
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg")] if value else [])
    window = F.window(at, width, every or width, align) if align or every else F.window(at, width)
    return log.groupBy(window.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[c for c in ("count", "sum", "min", "max", "avg") if c == "count" or value])


def rollup_stream(log: DataFrame, at: str, entity: str, value: str, width: str, retention: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a rollup of a temporal property as Parquet: a window is written once it can no longer change."""
    out = windowed(log, at, width, None, (entity,), value, retention)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def key_pattern(binding: str) -> str:
    """The regular expression of a topic binding: ``*`` is one word, ``#`` any number of words."""
    if binding == "#":
        return "^.*$"
    out = ""
    words = binding.split(".")
    for i, w in enumerate(words):
        dot = r"\." if i else ""
        if w == "#":
            out += rf"(?:{dot}[^.]+)*" if i else r"(?:[^.]+(?:\.[^.]+)*)?"
        else:
            out += (r"\.?" if i and words[i - 1] == "#" and i == 1 else dot) + (r"[^.]+" if w == "*" else re.escape(w))
    return f"^{out}$"


def routes(kind: str, key: Column, binding: str) -> Column:
    """Whether an exchange of a kind gives a message with this routing key to a binding."""
    if kind == "fanout":
        return F.lit(True)
    return key == binding if kind == "direct" else key.rlike(key_pattern(binding))


def routed(messages: DataFrame, kind: str, bindings: list[tuple[str, str]], key: str = "routing_key") -> DataFrame:
    """Each message once for each queue of (queue, binding) that it goes to, in a column ``queue``."""
    queues = F.array_distinct(F.filter(F.array(*[F.when(routes(kind, F.col(key), b), F.lit(q)) for q, b in bindings]), lambda q: q.isNotNull()))
    return messages.withColumn("queue", F.explode(queues))


def lag(log: DataFrame, committed: DataFrame) -> DataFrame:
    """topic, group, partition, end_offset, committed, lag of a log (topic, partition, offset) and offsets committed by group."""
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    return committed.join(ends, ["topic", "partition"]).select("topic", "group", "partition", "end_offset", "committed", (F.col("end_offset") - F.col("committed")).alias("lag"))


def retained(log: DataFrame, at: str, days: int) -> DataFrame:
    """What a topic still holds: messages of the last ``days`` days before the newest."""
    newest = log.agg(F.max(at).alias("_newest"))
    return log.join(F.broadcast(newest)).where(F.col(at) >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")  # one row
