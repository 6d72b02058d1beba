"""A graph over the star-schema tables: nodes and relationships as projections of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import epoch_nanos
from ..model import Graph, NodeTable, RelTable, widened
from ..plans.values import LDT, Value

#: Node ids carry their label's number in the upper bits, so they are unique in the graph.
SPACES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Document": 8, "Item": 9, "Turn": 10}


def node_id(label: str, key: Column) -> Column:
    return key.cast("long") + F.lit(SPACES[label] << 44).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widened(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def row_id() -> Column:
    """A number for each row of a file source: 35 bits for the file, by its path, and 28 for the row in the file."""
    return F.shiftleft(F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << 35) - 1)), 28).bitwiseOR(F.col("_metadata.row_index"))


def _nodes(label: str, df: DataFrame, at: str, /, **props: str) -> NodeTable:
    return NodeTable(frozenset([label]), df.select(node_id(label, F.col(at)).alias("id"), *[F.col(c).alias(n) for n, c in props.items()]))


def _rels(type_: str, ends: tuple[str, str], df: DataFrame, src: Column, dst: Column, id_: Column, /, **props: str) -> RelTable:
    return RelTable(type_, df.select(id_.alias("id"), node_id(ends[0], src).alias("src"), node_id(ends[1], dst).alias("dst"), *[F.col(c).alias(n) for n, c in props.items()]), ends)


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, and how they hang together."""
    region, nation, customer, supplier, part, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders"))
    lineitem = widened(spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("_row", row_id()))  # no columns of a line are a key
    c = F.col
    line = c("_row")
    nodes = (
        _nodes("Region", region, "r_regionkey", key="r_regionkey", name="r_name"),
        _nodes("Nation", nation, "n_nationkey", key="n_nationkey", name="n_name"),
        _nodes("Customer", customer, "c_custkey", key="c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        _nodes("Supplier", supplier, "s_suppkey", key="s_suppkey", name="s_name", acctbal="s_acctbal"),
        _nodes("Part", part, "p_partkey", key="p_partkey", name="p_name", brand="p_brand", kind="p_type", size="p_size", retailprice="p_retailprice"),
        _nodes("Order", orders, "o_orderkey", key="o_orderkey", status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
    )
    rels = (
        _rels("IN_REGION", ("Nation", "Region"), nation, c("n_nationkey"), c("n_regionkey"), c("n_nationkey")),
        _rels("IN_NATION", ("Customer", "Nation"), customer, c("c_custkey"), c("c_nationkey"), c("c_custkey")),
        _rels("BASED_IN", ("Supplier", "Nation"), supplier, c("s_suppkey"), c("s_nationkey"), c("s_suppkey")),
        _rels("PLACED", ("Customer", "Order"), orders, c("o_custkey"), c("o_orderkey"), c("o_orderkey")),
        _rels("CONTAINS", ("Order", "Part"), lineitem, c("l_orderkey"), c("l_partkey"), line, quantity="l_quantity", extendedprice="l_extendedprice", discount="l_discount", tax="l_tax", returnflag="l_returnflag", linestatus="l_linestatus", shipdate="l_shipdate", line="l_linenumber"),
        _rels("LINE_SUPPLIER", ("Order", "Supplier"), lineitem, c("l_orderkey"), c("l_suppkey"), line, quantity="l_quantity"),
        _rels("SUPPLIED", ("Supplier", "Part"), lineitem.select("l_suppkey", "l_partkey").distinct(), c("l_suppkey"), c("l_partkey"), c("l_suppkey") * 10_000_000 + c("l_partkey")),
    )
    return Graph(spark, nodes, rels, name="tpch")


def trade_graph(spark: SparkSession, sf_dir: str, top: int = 3) -> Graph:
    """Nations that supply nations: of each nation's ``top`` buyers by number of lines, ties by key."""
    t = tpch_graph(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = lines.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("lines"))
    ranked = counted.withColumn("rank", F.expr("row_number() over (partition by a order by lines desc, b)")).where(F.col("rank") <= top)
    rel = _rels("SELLS_TO", ("Nation", "Nation"), ranked, F.col("a"), F.col("b"), F.col("a") * 1000 + F.col("b"), lines="lines", rank="rank")
    return Graph(spark, tuple(n for n in t.nodes if n.labels == {"Nation"}), (rel,), name="trade")


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users with a temporal property ``value``: the events are its samples."""
    events = read(spark, sf_dir, "events")
    users = events.select("user_id").distinct().withColumn("value", F.lit(None).cast("double"))
    nanos = epoch_nanos(Value(F.col("ts").cast("timestamp_ntz"), LDT))
    samples = events.select(node_id("User", F.col("user_id")).alias("entity"), nanos.alias("time"), F.col("event_id").alias("seq"), "value")
    graph = Graph(spark, (_nodes("User", users, "user_id", key="user_id", value="value"),), (), name="events")
    return graph.with_(samples={("node", "User", "value"): samples})


def library_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents, embedded items and conversation turns."""
    docs, items, turns = (read(spark, sf_dir, t) for t in ("documents", "embeddings", "conversations"))
    turns = turns.withColumn("k", F.col("conv_id") * 100_000 + F.col("turn"))
    follow = turns.where("turn > 0").join(turns.select(F.col("k").alias("before")), F.col("k") - 1 == F.col("before"))
    nodes = (
        _nodes("Document", docs, "doc_id", key="doc_id", text="text", lang="lang", source="source", n_chars="n_chars"),
        _nodes("Item", items, "vec_id", key="vec_id", embedding="embedding", label="label"),
        _nodes("Turn", turns, "k", key="k", conv="conv_id", turn="turn", role="role", text="text"),
    )
    return Graph(spark, nodes, (_rels("NEXT", ("Turn", "Turn"), follow, F.col("before"), F.col("k"), F.col("k")),), name="library")
