"""The queries against DuckDB on the smallest tables, the session's statements, search, and streams."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from nodeloom import queries
from nodeloom.admin import Session
from nodeloom.operators.search import bm25, fused, text_search, vector_search
from nodeloom.operators.temporal import bucketed
from nodeloom.plans.tree import QueryError
from nodeloom.streaming.logs import lag, read_log, routed, windowed

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.oracle_sql() if n.startswith(("match", "opt", "ex", "not", "agg", "with", "list", "string", "temporal", "varlen_1", "path_sh", "trig", "trim", "entity", "type_alt", "collect", "local", "history", "at_t", "window", "layer", "vector", "text", "algo_deg"))]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in got.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_pushdown(spark):
    """Filters and columns reach the scan; nodes that nobody asks for are not read."""
    df = queries.queries()["match_filter_project"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,40)" in plan and "p_name" not in plan.split("ReadSchema")[-1]
    two = queries.tpch_graph(spark, SF).cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(o) AS n")
    assert "customer.parquet" not in two._jdf.queryExecution().executedPlan().toString()


def test_session(spark):
    s = Session(spark)
    s.execute("CREATE PROJECT p")
    with pytest.raises(QueryError):
        s.execute("CREATE PROJECT p")
    s.execute("CREATE PROJECT IF NOT EXISTS p")
    s.execute("USE p CREATE (:Book {isbn: '1'}), (:Book {isbn: '2'})")
    s.execute("USE p CREATE CONSTRAINT u FOR (b:Book) REQUIRE b.isbn IS UNIQUE")
    with pytest.raises(QueryError):
        s.execute("USE p CREATE (:Book {isbn: '1'})")
    assert s.execute("USE p MATCH (b:Book) RETURN count(b) AS n").rows.first()[0] == 2
    s.execute("USE p CREATE INDEX i FOR (b:Book) ON (b.isbn)")
    assert [tuple(r) for r in s.execute("USE p SHOW INDEXES").rows.collect()] == [("i", "equality", "Book", "isbn")]
    with pytest.raises(QueryError):
        s.execute("USE p CREATE INDEX j FOR (b:Book) ON (b.never)")
    s.execute("USE p CREATE (:Sensor {id: 1, c: 0.0})")
    s.execute("USE p ALTER NODE PROPERTY Sensor.c SET TEMPORAL FLOAT RETENTION duration('P3650D')")
    s.execute("USE p MATCH (x:Sensor) SET x.c = 20.5 AT TIME datetime('2025-04-01T09:00:00Z')")
    s.execute("USE p MATCH (x:Sensor) SET x.c = 18.5 AT TIME datetime('2025-03-01T09:00:00Z')")
    at = lambda t: s.execute(f"USE p AT TIME datetime('{t}') MATCH (x:Sensor) RETURN x.c AS c").rows.first()[0]
    assert (at("2025-03-05T00:00:00Z"), at("2025-01-01T00:00:00Z"), s.execute("USE p MATCH (x:Sensor) RETURN x.c AS c").rows.first()[0]) == (18.5, None, 20.5)
    with pytest.raises(QueryError):
        s.execute("CHECK READ ONLY MATCH (n) DELETE n")
    with pytest.raises(QueryError):
        s.execute("USE p MATCH (b:Book) HISTORY b.isbn FROM datetime('2025-01-01T00:00:00Z') TO datetime('2025-02-01T00:00:00Z') AS h RETURN h")
    for q in ("CREATE TOPIC t PARTITIONS 3 RETENTION 7 DAYS", "CREATE QUEUE q STREAM", "CREATE EXCHANGE e TYPE topic", "BIND QUEUE q TO EXCHANGE e KEY 'a.*'", "UNBIND QUEUE q FROM EXCHANGE e KEY 'a.*'", "DROP QUEUE q", "DROP EXCHANGE e", "CLEAR TOPIC t"):
        s.execute(q)
    assert tuple(s.execute("SHOW TOPICS").rows.first())[:3] == ("t", 3, 7)
    with pytest.raises(QueryError):
        s.execute("DROP PROJECT p")
    s.execute("DROP PROJECT p CASCADE")
    assert s.execute("SHOW PROJECTS").rows.count() == 0


def test_search(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "id long, vector array<float>")
    for method in ("exact", "prefix", "quantized", "adaptive"):
        assert [r["id"] for r in vector_search(items, [1.0, 0.1], 2, "cosine", method).collect()] == [1, 3]
    assert [r["id"] for r in vector_search(items, [0.0, 1.0], 1, "euclidean").collect()] == [2]
    texts = spark.createDataFrame([(1, "GPU-native graph memory"), (2, "Graph storage"), (3, None)], "id long, text string")
    assert [r["id"] for r in text_search(texts, "GRAPH MEMORY").collect()] == [1]
    assert {r["id"] for r in bm25(texts, "graph memory").collect()} == {1, 2}
    one, two = (spark.createDataFrame(x, "id long, score double") for x in ([(1, 0.9)], [(2, 5.0)]))
    assert {r["id"]: r["score"] for r in fused([one, two], 5).collect()} == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 61)}


def test_search_recall(spark):
    """What prefix and quantised search find of the exact ten, on vectors in clusters; texts in compatibility form."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.15 * rng.normal(size=32)).tolist()) for i in range(800)]
    items = spark.createDataFrame(rows, "id long, vector array<double>").cache()
    for method, least in (("prefix", 0.7), ("quantized", 0.7), ("adaptive", 0.7)):
        hits = 0
        for i in range(5):
            exact, got = ({r["id"] for r in vector_search(items, rows[i][1], 10, "cosine", m).collect()} for m in ("exact", method))
            hits += len(exact & got)
        assert hits >= least * 50, method
    wide = spark.createDataFrame([(1, "Ｇｒａｐｈ ﬁle"), (2, "graph")], "id long, text string")
    assert [r["id"] for r in text_search(wide, "graph file").collect()] == [1]


def test_windows(spark):
    day = 86_400 * 10**9
    at = spark.createDataFrame([(-1,), (0,), (5 * day + 1,)], "t long")
    starts = lambda width, every=None, zone=None: sorted(r["w"]["start"] // day for r in bucketed(at, F.col("t"), width, every, None, zone, "w").collect())
    assert starts((0, day)) == [-1, 0, 5]
    assert starts((0, 2 * day), (0, day)) == [-2, -1, -1, 0, 4, 5]
    assert starts((1, 0)) == [-31, 0, 0]


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/log")
    out = windowed(read_log(spark, f"{tmp_path}/log", events.schema), "ts", "1 day", None, ("event_type",), "value")
    q = out.writeStream.outputMode("complete").format("memory").queryName("streamed").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = windowed(events, "ts", "1 day", None, ("event_type",), "value")
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["count"]) for r in df.collect())
    assert key(spark.table("streamed")) == key(batch)
    m = spark.createDataFrame([("a.b",), ("a",), ("a.b.c",), ("x.b",)], "routing_key string")
    go = lambda kind, b: sorted(r[0] for r in routed(m, kind, [("q", b)]).select("routing_key").collect())
    assert go("topic", "a.*") == ["a.b"] and go("topic", "a.#") == ["a", "a.b", "a.b.c"] and go("topic", "#.b") == ["a.b", "x.b"] and len(go("fanout", "")) == 4 and go("direct", "a") == ["a"]
    log = spark.createDataFrame([("t", 0, i) for i in range(5)], "topic string, partition int, offset long")
    committed = spark.createDataFrame([("t", "g", 0, 3)], "topic string, `group` string, partition int, committed long")
    assert lag(log, committed).first()["lag"] == 2
