"""A small conformance table: set-up, query, rows; and errors."""

import datetime
import math

import pytest

from nodeloom.model import Graph, NodeTable, RelTable
from nodeloom.plans.tree import QueryError


def tables(spark, nodes, rels):
    """nodes: label -> (schema, rows); rels: type -> (schema, rows)."""
    ns = tuple(NodeTable(frozenset(k.split(":")), spark.createDataFrame(r, s)) for k, (s, r) in nodes.items())
    return Graph(spark, ns, tuple(RelTable(k, spark.createDataFrame(r, s)) for k, (s, r) in rels.items()))


@pytest.fixture(scope="module")
def empty(spark):
    return Graph(spark)


@pytest.fixture(scope="module")
def people(spark):
    return tables(spark, {"Person": ("id long, name string, age long, layer tinyint", [(1, "Ada", 37, 0), (2, "Grace", 41, 0), (3, "Linus", 29, 0)])},
                  {"KNOWS": ("id long, src long, dst long, layer tinyint", [(10, 1, 2, 0), (11, 2, 3, 1)])})


@pytest.fixture(scope="module")
def tree(spark):
    return tables(spark, {"A": ("id long, name string", [(1, "root")]), "B": ("id long, name string", [(2, "middle"), (3, "other"), (4, "leaf")])},
                  {"LIKES": ("id long, src long, dst long", [(10, 1, 2), (11, 1, 3), (12, 2, 4)])})


@pytest.fixture(scope="module")
def star(spark):
    return tables(spark, {"A": ("id long, prop long", [(1, 1)]), "B": ("id long, prop long", [(2, 1)]), "C": ("id long, prop long", [(3, 2)]), "D": ("id long, prop long", [(4, 3)])},
                  {"R": ("id long, src long, dst long", [(10, 1, 2), (11, 1, 3), (12, 1, 4)])})


def rows(graph, query, **params):
    def plain(v):
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    return [tuple(plain(x) for x in r) for r in graph.cypher(query, **params).collect()]


VALUES = [
    ("7/3", 2), ("-7/3", -2), ("7/-3", -2), ("-7/-3", 2), ("4/5", 0), ("7/2.0", 3.5), ("1.0/0", math.inf), ("1/0.0", math.inf), ("-1/0.0", -math.inf), ("7 % 3", 1), ("-7 % 3", -1),
    ("2 ^ 3", 8.0), ("2 + 3 * 4", 14), ("'a' + 1", "a1"), ("[1,2] + 3", (1, 2, 3)), ("1 = 1.0", True), ("1 = 'a'", False), ("1 < 'a'", None), ("null = null", None),
    ("[1,null] = [1,null]", None), ("[1,2] = [1,3]", False), ("[1] = [1,2]", False), ("5 IN [1,null]", None), ("1 IN [1,null]", True), ("null IN []", False), ("1 < 2 < 3", True), ("3 > 2 < 1", False),
    ("true XOR null", None), ("NOT null", None), ("false AND null", False), ("true OR null", True), ("1 STARTS WITH '1'", None), ("'abc' =~ 'a.c'", True), ("'abc' =~ 'b'", False),
    ("abs(-3)", 3), ("round(degrees(pi()))", 180.0), ("round(-2.5)", -3.0), ("range(1,5,2)", (1, 3, 5)), ("range(5,1)", ()), ("range(5,1,-2)", (5, 3, 1)), ("reverse('abc')", "cba"),
    ("vector.dot([1,2],[3,4])", 11.0), ("vector.distance([0,0],[3,4])", 5.0), ("split('a.b.', '.')", ("a", "b", "")), ("substring('hello', 1, 3)", "ell"), ("left('abc', 9)", "abc"), ("right('abc', 2)", "bc"),
    ("trim('\t x \n')", "x"), ("toInteger('2.9')", 2), ("toInteger(2.9)", 2), ("toInteger('x')", None), ("toBoolean('yes')", None), ("toBoolean('TRUE')", True), ("toFloat('1e3')", 1000.0), ("size('añb')", 3),
    ("isEmpty([])", True), ("isEmpty(null)", None), ("head([])", None), ("last([1,2])", 2), ("tail([1])", ()), ("[1,2,3][-1]", 3), ("[1,2,3][5]", None), ("[1,2,3][1..]", (2, 3)), ("[1,2,3][-2..-1]", (2,)),
    ("coalesce(null, 2)", 2), ("log(0)", -math.inf), ("sign(-2.5)", -1), ("ceil(1.2)", 2.0), ("{a: 1}.a", 1), ("{a: 1}.b", None), ("keys({a: 1, b: 2})", ("a", "b")), ("0x1F", 31), ("toString(1.5)", "1.5"),
    ("all(x IN [1,null] WHERE x > 0)", None), ("any(x IN [] WHERE x > 0)", False), ("none(x IN [1] WHERE x > 1)", True), ("single(x IN [1,2,1] WHERE x = 1)", False),
    ("reduce(s = 0, x IN [1,2,3] | s + x)", 6), ("[x IN [1,2,3] WHERE x > 1 | x * 2]", (4, 6)), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("CASE WHEN false THEN 1 END", None),
    ("date('2024-02-29') + duration('P1Y')", datetime.date(2025, 2, 28)), ("toString(date('2024-W10-3'))", "2024-03-06"), ("date('2024-060')", datetime.date(2024, 2, 29)),
    ("toString(datetime('2024-01-01T10:00:00+02:00'))", "2024-01-01T10:00+02:00"), ("toString(duration('P1Y2M3DT4H5M6.5S'))", "P1Y2M3DT4H5M6.5S"), ("toString(time('10:11:12.5+01:00'))", "10:11:12.5+01:00"),
    ("toString(duration.between(date('2024-01-31'), date('2024-03-01')))", "P1M1D"), ("duration.inDays(date('2024-01-01'), date('2024-03-01')).days", 60), ("toString(date.truncate('century', date('1987-05-06')))", "1900-01-01"),
    ("toString(date.truncate('weekYear', date('2024-12-31')))", "2024-12-30"), ("toString(localdatetime.truncate('hour', localdatetime('2024-05-06T07:08:09')))", "2024-05-06T07:00"), ("date('2024-05-17').dayOfQuarter", 47),
    ("toString(datetime.fromepoch(0, 0))", "1970-01-01T00:00Z"), ("datetime('1970-01-01T00:00:01Z').epochMillis", 1000), ("duration('PT90M').hours", 1), ("toString(localtime({hour: 3, minute: 4}))", "03:04"),
]


def test_values(empty):
    """All at once: one row of all expressions."""
    query = "RETURN " + ", ".join(f"{e} AS v{i}" for i, (e, _) in enumerate(VALUES))
    got = rows(empty, query)[0]
    wrong = [(e, g, w) for (e, w), g in zip(VALUES, got, strict=True) if g != w or type(g) is not type(w) and g is not None]
    assert not wrong


def test_nan(empty):
    a, b, c, d = rows(empty, "WITH 0.0/0.0 AS x RETURN x = x AS a, x < 1 AS b, x <> x AS c, x AS d")[0]
    assert (a, b, c) == (False, False, True) and math.isnan(d)


def test_aggregates(empty):
    assert rows(empty, "UNWIND [1,2,3,4] AS x RETURN sum(x) AS s, variance(x) AS v, variancep(x) AS vp, percentileCont(x, 0.5) AS c, percentileDisc(x, 0.5) AS d") == [(10, 5 / 3, 1.25, 2.5, 2)]
    assert rows(empty, "UNWIND [] AS x RETURN count(x) AS c, sum(x) AS s, avg(x) AS a, min(x) AS m, collect(x) AS l") == [(0, 0, None, None, ())]
    assert rows(empty, "UNWIND [1,1,null,2] AS x RETURN count(*) AS a, count(x) AS b, count(DISTINCT x) AS c, sum(DISTINCT x) AS d") == [(4, 3, 2, 3)]
    assert rows(empty, "UNWIND [3,1,2] AS x WITH x % 2 AS k, sum(x) + x % 2 AS s RETURN k, s ORDER BY k") == [(0, 2), (1, 5)]
    assert rows(empty, "UNWIND [1] AS x RETURN stdev(x) AS a, stdevp(x) AS b") == [(None, 0.0)]


def test_null_order_and_slices(empty):
    assert rows(empty, "UNWIND [2,null,1] AS x RETURN x ORDER BY x") == [(1,), (2,), (None,)]
    assert rows(empty, "UNWIND [2,null,1] AS x RETURN x ORDER BY x DESC SKIP 1 LIMIT 1") == [(2,)]
    assert rows(empty, "UNWIND [1,2] AS x RETURN x UNION UNWIND [2,3] AS x RETURN x") and len(rows(empty, "UNWIND [1,2] AS x RETURN x UNION ALL UNWIND [2,3] AS x RETURN x")) == 4


def test_parameters(empty):
    assert rows(empty, "UNWIND $rows AS r RETURN r.a AS a, r.b + $n AS b", rows=[{"a": "x", "b": 1}, {"a": "y", "b": 2}], n=10) == [("x", 11), ("y", 12)]


def test_relationship_uniqueness(spark):
    chain = tables(spark, {"N": ("id long, name string", [(1, "A"), (2, "B"), (3, "C")])}, {"R": ("id long, src long, dst long", [(10, 1, 2), (20, 2, 3), (11, 1, 2)])})
    assert rows(chain, "MATCH (a {name: 'A'})-[r1:R]->(b), (c)-[r2:R]->(b) WHERE b.name = 'B' RETURN count(*) AS n") == [(2,)]
    assert rows(chain, "MATCH (a {name: 'A'})-[r1:R]->(b) MATCH (c)-[r2:R]->(b) WHERE b.name = 'B' RETURN count(*) AS n") == [(4,)]
    assert rows(chain, "MATCH (a {name: 'A'})-[:R]-(b)-[:R]-(c) RETURN count(*) AS n") == [(4,)]


def test_variable_length(tree):
    names = lambda q: sorted(x[0] for x in rows(tree, q))
    assert names("MATCH (a:A)-[:LIKES*0..2]->(x) RETURN x.name AS n") == ["leaf", "middle", "other", "root"]
    assert names("MATCH (a:A)-[:LIKES*2..1]->(x) RETURN x.name AS n") == []
    assert names("MATCH (a:A)-[:LIKES*]->(x) RETURN x.name AS n") == ["leaf", "middle", "other"]
    assert names("MATCH (a:A)-[:LIKES]->{2}(x) RETURN x.name AS n") == ["leaf"]
    assert names("MATCH (a:A)-[:LIKES]->+(x:B) RETURN DISTINCT x.name AS n") == ["leaf", "middle", "other"]
    assert rows(tree, "MATCH p = (a:A)-[:LIKES*2]->(x) RETURN [n IN nodes(p) | n.name] AS n, length(p) AS l, size(relationships(p)) AS r") == [(("root", "middle", "leaf"), 2, 2)]
    assert rows(tree, "MATCH p = (x:B {name: 'leaf'})<-[:LIKES*1..3]-(a:A) RETURN [n IN nodes(p) | n.name] AS n") == [(("leaf", "middle", "root"),)]
    with pytest.raises(QueryError):
        rows(tree, "MATCH (a:A)-[:LIKES]->{3,1}(x) RETURN x")


def test_shortest(spark):
    g = tables(spark, {"N": ("id long", [(i,) for i in range(1, 6)])}, {"E": ("id long, src long, dst long", [(1, 1, 2), (2, 1, 3), (3, 2, 4), (4, 3, 4), (5, 4, 5), (6, 1, 4)])})
    q = "MATCH p = {} (a:N)-[:E*1..4]->(b:N) WHERE id(a) = 1 AND id(b) = 5 RETURN length(p) AS l"
    assert rows(g, q.format("ALL SHORTEST")) == [(2,)]
    assert rows(g, q.format("ANY SHORTEST")) == [(2,)]
    assert sorted(rows(g, q.format("SHORTEST 2"))) == [(2,), (3,)]
    assert sorted(rows(g, q.format("SHORTEST 2 GROUPS"))) == [(2,), (3,), (3,)]
    assert sorted(rows(g, q.format("ACYCLIC"))) == [(2,), (3,), (3,)]
    assert rows(g, "MATCH p = ANY SHORTEST (a:N)-[:E*]->(b:N) WHERE id(a) = 1 AND id(b) = 5 RETURN length(p) AS l") == [(2,)]


def test_exists(star):
    assert rows(star, "MATCH (n) WHERE EXISTS { (n)-->() } RETURN id(n) AS i") == [(1,)]
    assert rows(star, "MATCH (n) WHERE EXISTS { MATCH (n)-->(m) WHERE n.prop = m.prop } RETURN id(n) AS i") == [(1,)]
    assert rows(star, "MATCH (n) WHERE NOT (n)<--() RETURN id(n) AS i") == [(1,)]
    assert sorted(rows(star, "MATCH (n) RETURN id(n) AS i, EXISTS { (n)<--(:A) } AS e")) == [(1, False), (2, True), (3, True), (4, True)]
    assert rows(star, "MATCH (n:A) RETURN [(n)-->(m) WHERE m.prop > 1 | m.prop] AS l")[0][0] in ((2, 3), (3, 2))
    assert rows(star, "MATCH (n:B) RETURN [(n)-->(m) | m.prop] AS l") == [((),)]


def test_optional(people):
    assert sorted(rows(people, "MATCH (a:Person) OPTIONAL MATCH (a)-[r:KNOWS]->(b) WHERE b.age > 40 RETURN a.name AS a, b.name AS b")) == [("Ada", "Grace"), ("Grace", None), ("Linus", None)]
    assert rows(people, "OPTIONAL MATCH (n:Nobody) RETURN n") == [(None,)]
    assert rows(people, "MATCH (a:Person {name: 'Ada'})-[r:KNOWS]->(b) RETURN type(r) AS t, startNode(r).name AS s, endNode(r).name AS e, labels(b) AS l, properties(b).age AS p") == [("KNOWS", "Ada", "Grace", ("Person",), 41)]


def test_layers(people):
    assert rows(people, "MATCH (a)-[:KNOWS]->(b) RETURN count(*) AS n") == [(2,)]
    assert rows(people, "USE LAYER OBSERVED MATCH (a)-[:KNOWS]->(b) RETURN count(*) AS n") == [(1,)]
    with pytest.raises(QueryError):
        people.execute("USE LAYER OBSERVED WRITE LAYER WORKSPACE CREATE (:Person)")


@pytest.mark.parametrize(
    "query",
    [
        "MATCH (n RETURN n", "RETURN", "RETURN x", "MATCH (n) WHERE count(n) > 1 RETURN n", "RETURN sum(count(1))", "WITH 1 + 1 RETURN 1", "RETURN 1 AS a, 2 AS a", "RETURN nope(1)", "RETURN left('a')",
        "UNWIND [1] AS x RETURN percentileCont(x, 1.5)", "RETURN toBoolean([])", "RETURN toFloat(true)", "RETURN 1 AS a UNION RETURN 2 AS b", "RETURN 1 AS a UNION RETURN 2 AS a UNION ALL RETURN 3 AS a",
        "CALL graph.bfs()", "CALL graph.leiden()", "CALL graph.wcc() YIELD nope RETURN nope", "RETURN $missing", "RETURN 1 AND true", "MATCH (a) RETURN a LIMIT -1", "RETURN 'a' =~", "RETURN \"\\q\"",
    ],
)
def test_errors(people, query):
    with pytest.raises(QueryError):
        people.cypher(query)


def test_runtime_errors(empty):
    for q in ("RETURN 1/0 AS x", "RETURN 9223372036854775807 + 1 AS x", "RETURN range(1, 2, 0) AS x", "RETURN left('a', -1) AS x", "RETURN duration('nonsense') AS x"):
        with pytest.raises(Exception):  # noqa: B017
            empty.cypher(q).collect()


def test_writes(spark):
    g = Graph(spark)
    r = g.execute("CREATE (a:Person {name: 'Ada', id: 7})-[r:KNOWS {since: 2000}]->(b:Person {name: 'Grace'}) RETURN a.name AS a, r.since AS s")
    assert [tuple(x) for x in r.rows.collect()] == [("Ada", 2000)] and r.stats["nodes_created"] == 2 and r.stats["relationships_created"] == 1
    g = r.graph.execute("UNWIND ['Linus', 'Ada', 'Linus'] AS n MERGE (p:Person {name: n}) ON CREATE SET p.fresh = true ON MATCH SET p.fresh = false").graph
    assert sorted(rows(g, "MATCH (p:Person) RETURN p.name AS n, p.fresh AS f, p.id AS i"), key=str) == [("Ada", False, 7), ("Grace", None, None), ("Linus", True, None)]
    g = g.execute("MATCH (p:Person) WHERE p.name <> 'Ada' SET p.age = 3, p:Human").graph
    g = g.execute("MATCH (p:Human {name: 'Linus'}) SET p += {age: 4, city: 'H'}").graph
    assert sorted(rows(g, "MATCH (p:Human) RETURN p.name AS n, p.age AS a, p.city AS c, revision(p) > 1 AS r")) == [("Grace", 3, None, True), ("Linus", 4, "H", True)]
    g = g.execute("MATCH (p:Human {name: 'Linus'}) REMOVE p.age, p:Human").graph
    assert rows(g, "MATCH (p:Human) RETURN p.name AS n") == [("Grace",)]
    with pytest.raises(QueryError):
        g.execute("MATCH (p:Person {name: 'Ada'}) DELETE p")
    r = g.execute("MATCH (p:Person {name: 'Ada'}) DETACH DELETE p")
    assert r.stats == {"nodes_deleted": 1, "relationships_deleted": 1}
    assert rows(r.graph, "MATCH (p:Person) RETURN count(p) AS n") == [(2,)] and rows(r.graph, "MATCH ()-[r]->() RETURN count(r) AS n") == [(0,)]
