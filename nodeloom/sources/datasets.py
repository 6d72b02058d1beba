"""Graphs from delimited files, plain or gzipped, by a mapping; distances for their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import stored
from ..model import Graph, NodeTable, RelTable, widened

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two places on a sphere."""
    a, b = F.radians(lat1.cast("double")), F.radians(lat2.cast("double"))
    half = F.sin((b - a) / 2) * F.sin((b - a) / 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2.cast("double") - lon1.cast("double")) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False, comment: str = "#", null: str = "\\N", malformed: str = "FAILFAST") -> DataFrame:
    """A delimited file of known columns; ``.gz`` is read as such. A line that does not fit is an error, unless another mode is given."""
    return widened(spark.read.schema(schema).csv(path, sep=sep, header=header, comment=comment, nullValue=null, mode=malformed))


def edge_graph(edges: DataFrame, label: str, key: str, type_: str, nodes: DataFrame | None = None) -> Graph:
    """A graph of one label and type from edges (src, dst, further columns) between keys.

    Keys are integers and become ids; nodes that no file describes have their key only. Each
    line is a relationship of its own, parallel ones too: lines are numbered and stored.
    """
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id is not null").distinct()
    described = ends if nodes is None else ends.join(nodes, ends["id"] == nodes[key], "full").withColumn("id", F.coalesce("id", key)).drop(key)
    more = [c for c in edges.columns if c not in ("src", "dst")]
    rels = stored(edges.where("src is not null and dst is not null").withColumn("id", F.monotonically_increasing_id()))
    return Graph(edges.sparkSession, (NodeTable(frozenset([label]), described.withColumn(key, F.col("id"))),), (RelTable(type_, rels.select("id", "src", "dst", *more), (label, label)),))


def social(spark: SparkSession, path: str) -> Graph:
    """Friendships: lines of two person numbers."""
    return edge_graph(delimited(spark, path, "src long, dst long", sep=" "), "Person", "person_id", "FRIEND")


def epinions(spark: SparkSession, path: str) -> Graph:
    """Trust between users: lines of two user numbers."""
    return edge_graph(delimited(spark, path, "src long, dst long", sep="\t"), "User", "user_id", "TRUSTS")


def trust(spark: SparkSession, path: str) -> Graph:
    """Ratings: source, target, rating, epoch seconds. An account's reputation is the mean of ratings so far, as samples."""
    edges = delimited(spark, path, "src long, dst long, rating long, at_epoch double").withColumn("at", F.timestamp_seconds("at_epoch").cast("timestamp_ntz"))
    graph = edge_graph(edges, "Account", "account_id", "RATED")
    node = graph.nodes[0]
    so_far = F.expr("avg(rating) over (partition by dst order by at_epoch, src)")
    samples = edges.select(F.col("dst").alias("entity"), (F.col("at_epoch").cast("long") * 1_000_000_000).alias("time"), F.col("src").alias("seq"), F.round(so_far, 4).alias("value"))
    return graph.with_(nodes=(NodeTable(node.labels, node.df.withColumn("reputation", F.lit(None).cast("double"))),), samples={("node", "Account", "reputation"): samples})


def flights(spark: SparkSession, airports: str, routes: str) -> Graph:
    """Airports and routes with their length in kilometres."""
    a = delimited(spark, airports, "airport_id long, name string, city string, country string, iata string, icao string, latitude double, longitude double, altitude_ft long, tz_offset string, dst_rule string, timezone string").drop("tz_offset", "dst_rule")
    r = delimited(spark, routes, "airline string, airline_id long, src_code string, src long, dst_code string, dst long, codeshare string, stops long, equipment string")
    place = lambda side: a.select(F.col("airport_id").alias(side), F.col("latitude").alias(f"{side}_lat"), F.col("longitude").alias(f"{side}_lon"))
    r = r.join(place("src"), "src").join(place("dst"), "dst").withColumn("km", F.round(haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")), 1))
    return edge_graph(r.select("src", "dst", "airline", "stops", "equipment", "km"), "Airport", "airport_id", "ROUTE", a)
