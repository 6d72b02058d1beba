"""Durable graphs: a folder of Parquet tables, partitioned by layer where there is one."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Graph, NodeTable, RelTable


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save(graph: Graph, path: str) -> None:
    """Write a new snapshot; the catalog goes last, so a snapshot without one is no snapshot."""
    path = path.rstrip("/")
    catalog = {"name": graph.name, "nodes": [], "rels": [], "samples": [], "constraints": graph.constraints, "indexes": {k: v for k, v in graph.indexes.items() if isinstance(v, dict)}}

    def write(df, at: str) -> str:
        out = df.write
        (out.partitionBy("layer") if "layer" in df.columns else out).parquet(f"{path}/{at}")
        return at

    for i, t in enumerate(graph.nodes):
        catalog["nodes"].append({"labels": sorted(t.labels), "at": write(t.df, f"nodes-{i}")})
    for i, t in enumerate(graph.rels):
        catalog["rels"].append({"type": t.type, "ends": t.ends, "at": write(t.df, f"rels-{i}")})
    for i, (key, df) in enumerate(graph.samples.items()):
        catalog["samples"].append({"key": key, "at": write(df, f"samples-{i}")})
    graph.spark.createDataFrame([(json.dumps(catalog),)], "value string").coalesce(1).write.text(f"{path}/catalog")


def load(spark: SparkSession, path: str) -> Graph:
    """The graph of a snapshot. A layer is a folder, so a query of one layer reads that one only."""
    path = path.rstrip("/")
    catalog = json.loads(spark.read.text(f"{path}/catalog").first()["value"])

    def read(at: str):
        df = spark.read.parquet(f"{path}/{at}")
        return df.withColumn("layer", F.col("layer").cast("tinyint")) if "layer" in df.columns else df

    return Graph(
        spark,
        tuple(NodeTable(frozenset(n["labels"]), read(n["at"])) for n in catalog["nodes"]),
        tuple(RelTable(r["type"], read(r["at"]), tuple(r["ends"])) for r in catalog["rels"]),
        samples={tuple(s["key"]): read(s["at"]) for s in catalog["samples"]},
        constraints={k: tuple(v) for k, v in catalog["constraints"].items()},
        indexes=catalog["indexes"],
        name=catalog["name"],
    )


def drop(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, True)
