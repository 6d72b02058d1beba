"""Snapshots, delimited files, results as JSON lines, registered procedures."""

import gzip
import json

import pytest

from nodeloom.model import Graph
from nodeloom.plans.tree import QueryError
from nodeloom.sources import datasets, results, snapshots
from nodeloom.sources.tables import events_graph, tpch_graph


def test_snapshot(spark, tmp_path):
    g = Graph(spark).execute("CREATE (a:P {name: 'x', id: 1})-[:R {w: 2}]->(b:P {name: 'y'})").graph
    g = g.execute("WRITE LAYER WORKSPACE USE LAYERS OBSERVED, WORKSPACE CREATE (:P {name: 'z'})").graph.with_(layers=(0, 1))
    g = g.with_(samples=events_graph(spark, "/root/testdata/sf0.001").samples)
    snapshots.save(g, f"{tmp_path}/g")
    back = snapshots.load(spark, f"{tmp_path}/g")
    q = "MATCH (a:P)-[r:R]->(b) RETURN a.name AS a, a.id AS i, r.w AS w, b.name AS b"
    assert [tuple(r) for r in back.cypher(q).collect()] == [tuple(r) for r in g.cypher(q).collect()] == [("x", 1, 2, "y")]
    count = "{}MATCH (p:P) RETURN count(p) AS n"
    assert (back.cypher(count.format("")).first()[0], back.cypher(count.format("USE LAYERS ALL ")).first()[0]) == (2, 3)
    assert next(iter(back.samples.values())).count() == next(iter(g.samples.values())).count() and snapshots.drop(spark, f"{tmp_path}/g")


def test_delimited(spark, tmp_path):
    with gzip.open(tmp_path / "trust.csv.gz", "wt") as f:
        f.write("1,2,4,1000.0\n3,2,-2,2000.0\n2,1,10,1500.0\n")
    g = datasets.trust(spark, f"{tmp_path}/trust.csv.gz")
    assert [tuple(r) for r in g.cypher("MATCH (a:Account)-[r:RATED]->(b {account_id: 2}) RETURN a.account_id AS a, r.rating AS r ORDER BY a").collect()] == [(1, 4), (3, -2)]
    at = lambda t: g.cypher(f"AT TIME datetime('1970-01-01T00:{t}:00Z') MATCH (a:Account {{account_id: 2}}) RETURN a.reputation AS r").first()[0]
    assert (at("10"), at("17"), at("40")) == (None, 4.0, 1.0)
    (tmp_path / "airports").write_text('1,"A, field","C","L","AAA","AAAA",0.0,0.0,10,"1","N","Z"\n2,"B","C","L","BBB","BBBB",0.0,90.0,10,"1","N","Z"\n')
    (tmp_path / "routes").write_text("XX,7,AAA,1,BBB,2,,0,737\n")
    f = datasets.flights(spark, f"{tmp_path}/airports", f"{tmp_path}/routes")
    assert tuple(f.cypher("MATCH (a:Airport)-[r:ROUTE]->(b) RETURN a.name AS a, b.iata AS b, r.km AS km").first()) == ("A, field", "BBB", pytest.approx(10007.5, abs=0.1))
    (tmp_path / "friends").write_text("1 2\n2 3\n")
    assert datasets.social(spark, f"{tmp_path}/friends").cypher("MATCH (a:Person)-[:FRIEND*2]->(b) RETURN b.person_id AS b").first()[0] == 3


def test_parallel_edges(spark, tmp_path):
    """Equal lines are relationships of their own; a line that does not fit is an error."""
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long")
    graph = datasets.edge_graph(edges, "P", "key", "E")
    assert graph.cypher("MATCH (a)-[r]->(b)<-[q]-(c) RETURN count(*) AS n").first()["n"] == 2
    assert graph.cypher("MATCH (a)-[r]->(b) RETURN count(DISTINCT id(r)) AS n").first()["n"] == 3
    (tmp_path / "bad.txt").write_text("1 2\n3 x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        datasets.social(spark, str(tmp_path / "bad.txt")).cypher("MATCH (a)-[r]->(b) RETURN id(a) AS a").collect()


def test_row_ids(spark):
    lines = tpch_graph(spark, "/root/testdata/sf0.001").cypher("MATCH (:Order)-[l:CONTAINS]->(:Part) RETURN count(*) AS n, count(DISTINCT id(l)) AS ids").first()
    assert lines["n"] == lines["ids"] > 5000


def test_ndjson(spark):
    df = Graph(spark).cypher("UNWIND range(1, 5) AS x RETURN x, 'é' AS s")
    lines = [json.loads(x) for x in results.ndjson(df, batch=2)]
    assert [x["event"] for x in lines] == ["schema", "batch", "batch", "batch", "summary"] and lines[-1]["rows"] == 5
    assert sorted(r["x"] for x in lines[1:-1] for r in x["rows"]) == [1, 2, 3, 4, 5]


def test_registered_procedures(spark):
    table = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, n long, v double")
    g = Graph(spark, procedures={"host.rates": (("k",), ("n", "v"), table)})
    assert sorted(map(tuple, g.cypher("UNWIND ['a', 'c'] AS k CALL host.rates(k) YIELD n, v AS rate RETURN k, n, rate").collect())) == [("a", 1, 10.0), ("a", 2, 20.0)]
    assert g.cypher("CALL host.rates YIELD *", k="b").count() == 1
    with pytest.raises(QueryError):
        g.cypher("UNWIND [1] AS x CALL host.rates('a') RETURN x")
