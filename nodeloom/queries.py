"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .sources.tables import events_graph, library_graph, node_id, tpch_graph, trade_graph

#: name -> (graph, Cypher, DuckDB SQL). Columns have the same names on both sides.
CYPHER: dict[str, tuple[Callable[[SparkSession, str], Graph], str, str | None]] = {}


def _add(name: str, graph, cypher: str, sql: str | None) -> None:
    CYPHER[name] = (graph, cypher, sql)


_add("match_filter_aggregate", tpch_graph,
     "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 RETURN c.mktsegment AS segment, count(*) AS orders, round(avg(o.totalprice)) AS mean ORDER BY segment",
     "SELECT c_mktsegment AS segment, count(*) AS orders, round(avg(o_totalprice)) AS mean FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 GROUP BY 1")
_add("match_filter_project", tpch_graph,
     "MATCH (p:Part) WHERE p.size >= 40 AND p.retailprice < 1500 RETURN p.key AS key, p.brand AS brand, p.size * 2 AS twice",
     "SELECT p_partkey AS key, p_brand AS brand, CAST(p_size AS BIGINT) * 2 AS twice FROM part WHERE p_size >= 40 AND p_retailprice < 1500")
_add("match_point_lookup", tpch_graph, "MATCH (c:Customer {key: 42}) RETURN c.name AS name, c.acctbal AS acctbal", "SELECT c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 42")
_add("match_two_hop", tpch_graph,
     "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, n.name AS nation, count(c) AS customers",
     "SELECT r_name AS region, n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
_add("match_incoming", tpch_graph,
     "MATCH (p:Part)<-[l:CONTAINS]-(o:Order) WHERE l.quantity > 45 RETURN p.brand AS brand, count(*) AS lines, sum(l.quantity) AS quantity",
     "SELECT p_brand AS brand, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY 1")
_add("match_undirected", trade_graph,
     "MATCH (a:Nation)-[r:SELLS_TO]-(b:Nation) RETURN a.key AS a, b.key AS b, r.lines AS lines",
     "WITH t AS (%TRADE%) SELECT a, b, lines FROM t UNION ALL SELECT b, a, lines FROM t WHERE a <> b")
_add("match_edge_uniqueness", tpch_graph,
     "MATCH (a:Customer)-[:IN_NATION]->(n:Nation {key: 3})<-[:IN_NATION]-(b:Customer) RETURN count(*) AS pairs",
     "SELECT count(*) AS pairs FROM customer a JOIN customer b ON a.c_nationkey = 3 AND b.c_nationkey = 3 AND a.c_custkey <> b.c_custkey")
_add("match_shared_variable", tpch_graph,
     "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.key AS nation, count(*) AS pairs",
     "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
_add("match_disconnected_range", tpch_graph,
     "MATCH (a:Nation), (b:Region) WHERE a.key < b.key RETURN a.key AS a, b.key AS b",
     "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(r_regionkey AS BIGINT) AS b FROM nation, region WHERE n_nationkey < r_regionkey")
_add("match_cycle", trade_graph,
     "MATCH (a:Nation)-[:SELLS_TO]->(b:Nation)-[:SELLS_TO]->(c:Nation)-[:SELLS_TO]->(a) RETURN a.key AS a, b.key AS b, c.key AS c",
     "WITH t AS (%TRADE%) SELECT x.a, x.b, y.b AS c FROM t x JOIN t y ON x.b = y.a JOIN t z ON y.b = z.a AND z.b = x.a WHERE NOT (x.a = y.a AND x.b = y.b) AND NOT (y.a = z.a AND y.b = z.b) AND NOT (x.a = z.a AND x.b = z.b)")
_add("optional_match", tpch_graph,
     "MATCH (s:Supplier) OPTIONAL MATCH (s)-[:SUPPLIED]->(p:Part {size: 1}) RETURN s.key AS key, count(p) AS parts",
     "SELECT s_suppkey AS key, count(p_partkey) AS parts FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1) ON l_suppkey = s_suppkey GROUP BY 1")
_add("optional_match_where", tpch_graph,
     "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.key AS key, o.key AS order, o.totalprice AS price",
     'SELECT c_custkey AS key, o_orderkey AS "order", o_totalprice AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000')
_add("exists_subquery", tpch_graph,
     "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.priority = '1-URGENT' AND o.totalprice > 300000 } RETURN c.key AS key",
     "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
_add("not_exists_pattern", tpch_graph,
     "MATCH (p:Part) WHERE NOT (p)<-[:SUPPLIED]-(:Supplier {key: 3}) RETURN count(p) AS parts",
     "SELECT count(*) AS parts FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 3)")
_add("exists_value", tpch_graph,
     "MATCH (c:Customer) RETURN EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 450000 } AS big, count(*) AS n",
     "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS big, count(*) AS n FROM customer GROUP BY 1")
_add("pattern_comprehension_size", tpch_graph,
     "MATCH (n:Nation) RETURN n.key AS key, size([(n)<-[:IN_NATION]-(c:Customer) WHERE c.acctbal > 5000 | c.key]) AS rich",
     "SELECT CAST(n_nationkey AS BIGINT) AS key, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS rich FROM nation")
_add("agg_group_count", tpch_graph, "MATCH (o:Order) RETURN o.status AS status, o.priority AS priority, count(*) AS n", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
_add("agg_all_functions", tpch_graph,
     "MATCH (c:Customer) RETURN c.mktsegment AS segment, count(c.acctbal) AS n, round(sum(c.acctbal) * 100) / 100.0 AS total, round(avg(c.acctbal) * 1000) / 1000.0 AS mean, min(c.acctbal) AS low, max(c.acctbal) AS high",
     "SELECT c_mktsegment AS segment, count(c_acctbal) AS n, round(sum(c_acctbal) * 100) / 100.0 AS total, round(avg(c_acctbal) * 1000) / 1000.0 AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
_add("agg_distinct", tpch_graph,
     "MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN l.returnflag AS flag, count(DISTINCT p.key) AS parts, count(DISTINCT l.quantity) AS quantities, sum(DISTINCT p.size) AS sizes",
     "SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_quantity) AS quantities, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
_add("agg_percentiles", tpch_graph,
     "MATCH (p:Part) RETURN p.brand AS brand, round(percentileCont(p.retailprice, 0.4) * 1000) / 1000.0 AS cont, percentileDisc(p.size, 0.5) AS disc",
     "SELECT p_brand AS brand, round(quantile_cont(p_retailprice, 0.4) * 1000) / 1000.0 AS cont, CAST(quantile_disc(p_size, 0.5) AS BIGINT) AS disc FROM part GROUP BY 1")
_add("agg_dispersion", tpch_graph,
     "MATCH (s:Supplier) RETURN round(stdev(s.acctbal) * 1000) / 1000.0 AS sd, round(stdevp(s.acctbal) * 1000) / 1000.0 AS sdp, round(variance(s.acctbal)) AS var, round(variancep(s.acctbal)) AS varp",
     "SELECT round(stddev_samp(s_acctbal) * 1000) / 1000.0 AS sd, round(stddev_pop(s_acctbal) * 1000) / 1000.0 AS sdp, round(var_samp(s_acctbal)) AS var, round(var_pop(s_acctbal)) AS varp FROM supplier")
_add("agg_mixed_expression", tpch_graph,
     "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n.key AS nation, count(c) + n.key AS mixed RETURN nation, mixed",
     "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) + c_nationkey AS mixed FROM customer GROUP BY c_nationkey")
_add("sum_empty_is_zero", tpch_graph, "MATCH (c:Customer) WHERE c.key < 0 RETURN count(*) AS n, sum(c.key) AS total, avg(c.acctbal) AS mean, max(c.name) AS last", "SELECT count(*) AS n, coalesce(CAST(sum(c_custkey) AS BIGINT), 0) AS total, avg(c_acctbal) AS mean, max(c_name) AS last FROM customer WHERE c_custkey < 0")
_add("collect_sorted", tpch_graph, "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.key RETURN r.name AS region, size(collect(n.name)) AS n, head(collect(n.key)) IS NOT NULL AS some", "SELECT r_name AS region, count(*) AS n, true AS some FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("unwind_range", tpch_graph, "UNWIND range(1, 20, 3) AS x UNWIND [x, null, x * x] AS y RETURN x, y", "SELECT x, unnest([x, NULL, x * x]) AS y FROM (SELECT unnest(generate_series(1, 20, 3)) AS x)")
_add("with_distinct", tpch_graph, "MATCH (o:Order) WITH DISTINCT o.status AS status, o.priority AS priority WHERE status <> 'P' RETURN status, priority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'P'")
_add("with_where_alias", tpch_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.key AS key, count(o) AS n WHERE n > 14 RETURN key, n", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
_add("with_order_limit", tpch_graph, "MATCH (o:Order) WITH o ORDER BY o.totalprice DESC, o.key LIMIT 25 MATCH (c:Customer)-[:PLACED]->(o) RETURN c.key AS customer, o.key AS order", 'SELECT o_custkey AS customer, o_orderkey AS "order" FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)')
_add("order_nulls_last", tpch_graph,
     "MATCH (c:Customer) WITH CASE WHEN c.key % 7 = 0 THEN null ELSE c.key END AS k ORDER BY k DESC LIMIT 300 RETURN count(*) AS n, count(k) AS present, min(k) AS low",
     "SELECT count(*) AS n, count(k) AS present, min(k) AS low FROM (SELECT nullif(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey END, -1) AS k FROM customer ORDER BY k DESC NULLS FIRST LIMIT 300)")
_add("skip_limit", tpch_graph, "MATCH (n:Nation) RETURN n.name AS name ORDER BY n.key SKIP 5 LIMIT 7", "SELECT n_name AS name FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 5")
_add("union_distinct", tpch_graph, "MATCH (c:Customer) RETURN c.acctbal > 0 AS v UNION MATCH (s:Supplier) RETURN s.acctbal > 0 AS v", "SELECT c_acctbal > 0 AS v FROM customer UNION SELECT s_acctbal > 0 FROM supplier")
_add("union_all", tpch_graph, "MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
_add("let_filter", tpch_graph, "MATCH (p:Part) LET unit = p.retailprice / p.size FILTER unit > 900 RETURN p.key AS key, round(unit * 100) / 100.0 AS unit", "SELECT p_partkey AS key, round(p_retailprice / p_size * 100) / 100.0 AS unit FROM part WHERE p_retailprice / p_size > 900")
_add("for_list", tpch_graph, "FOR x IN [3, 1, 2] RETURN x, x * 10 AS y", "SELECT x, x * 10 AS y FROM (SELECT unnest([CAST(3 AS BIGINT), 1, 2]) AS x)")
_add("list_comprehension", tpch_graph, "MATCH (n:Nation) RETURN n.key AS key, [x IN range(0, n.key) WHERE x % 3 = 0 | x * x] AS squares", "SELECT CAST(n_nationkey AS BIGINT) AS key, list_transform(list_filter(range(0, n_nationkey + 1), lambda x: x % 3 = 0), lambda x: x * x) AS squares FROM nation")
_add("list_reduce", tpch_graph, "MATCH (n:Nation) RETURN n.key AS key, reduce(s = 0, x IN range(1, n.key) | s + x) AS total", "SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(n_nationkey * (n_nationkey + 1) / 2 AS BIGINT) AS total FROM nation")
_add("list_predicates", tpch_graph,
     "MATCH (p:Part) RETURN all(x IN [p.size, 10] WHERE x > 5) AS a, any(x IN [p.size, 10] WHERE x > 40) AS b, none(x IN [p.size] WHERE x = 1) AS c, single(x IN [p.size, 10] WHERE x = 10) AS d, count(*) AS n",
     "SELECT p_size > 5 AS a, p_size > 40 AS b, p_size <> 1 AS c, p_size <> 10 AS d, count(*) AS n FROM part GROUP BY ALL")
_add("list_slices", tpch_graph, "MATCH (n:Nation) WITH n.key AS key, range(1, 6) AS l RETURN key, l[0] AS first, l[-1] AS last, l[1..3] AS middle, l[-2..] AS rest, l[9] AS none, tail(l) AS t, 3 IN l AS three", "SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(1 AS BIGINT) AS first, CAST(6 AS BIGINT) AS last, [CAST(2 AS BIGINT), 3] AS middle, [CAST(5 AS BIGINT), 6] AS rest, CAST(NULL AS BIGINT) AS none, [CAST(2 AS BIGINT), 3, 4, 5, 6] AS t, true AS three FROM nation")
_add("case_simple", tpch_graph, "MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS state, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS state, count(*) AS n FROM orders GROUP BY 1")
_add("case_searched", tpch_graph, "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'medium' END AS class, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS class, count(*) AS n FROM part GROUP BY 1")
_add("map_projection", tpch_graph, "MATCH (n:Nation) WITH n{.key, label: 'N' + n.name} AS m RETURN m.key AS key, m.label AS label, size(keys(m)) AS n", "SELECT CAST(n_nationkey AS BIGINT) AS key, 'N' || n_name AS label, CAST(2 AS BIGINT) AS n FROM nation")
_add("string_functions", tpch_graph,
     "MATCH (p:Part) RETURN p.key AS key, upper(left(p.name, 3)) AS a, right(p.name, 2) AS b, substring(p.name, 1, 3) AS c, replace(p.name, 'a', '-') AS d, reverse(p.brand) AS e, size(split(p.kind, ' ')) AS f, trim('  x ') AS g, toLower(p.brand) AS h, p.name CONTAINS '1' AS i, p.name STARTS WITH 'P' AS j, p.brand ENDS WITH '3' AS k",
     "SELECT p_partkey AS key, upper(left(p_name, 3)) AS a, right(p_name, 2) AS b, substr(p_name, 2, 3) AS c, replace(p_name, 'a', '-') AS d, reverse(p_brand) AS e, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS f, 'x' AS g, lower(p_brand) AS h, contains(p_name, '1') AS i, starts_with(p_name, 'P') AS j, ends_with(p_brand, '3') AS k FROM part")
_add("numeric_functions", tpch_graph,
     "MATCH (c:Customer) RETURN c.key AS key, abs(c.acctbal) AS a, sign(c.acctbal) AS b, ceil(c.acctbal) AS c, floor(c.acctbal) AS d, round(sqrt(abs(c.acctbal)) * 1000) AS e, round(log(c.key + 1) * 1000) AS f, round(sin(c.key) * 1000) AS g, round(power(c.key, 2)) AS h, round(degrees(pi())) AS i",
     "SELECT c_custkey AS key, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS BIGINT) AS b, ceil(c_acctbal) AS c, floor(c_acctbal) AS d, round(sqrt(abs(c_acctbal)) * 1000) AS e, round(ln(c_custkey + 1) * 1000) AS f, round(sin(c_custkey) * 1000) AS g, round(pow(c_custkey, 2)) AS h, CAST(180 AS DOUBLE) AS i FROM customer")
_add("trigonometry", tpch_graph,
     "MATCH (c:Customer) LET x = c.acctbal / 10000.0 RETURN c.key AS key, round(acos(x / 2) * 1000000) AS a, round(asin(x / 2) * 1000000) AS b, round(atan(x) * 1000000) AS c, round(atan2(x, 2.0) * 1000000) AS d, round(cos(x) * 1000000) AS e, round(tan(x) * 1000000) AS f, round(cot(x + 2) * 1000000) AS g, round(exp(x) * 1000000) AS h, round(log10(x * x + 1) * 1000000) AS i, round(radians(x) * 1000000) AS j, round(e() * 1000000) AS k",
     "SELECT c_custkey AS key, round(acos(x / 2) * 1000000) AS a, round(asin(x / 2) * 1000000) AS b, round(atan(x) * 1000000) AS c, round(atan2(x, 2.0) * 1000000) AS d, round(cos(x) * 1000000) AS e, round(tan(x) * 1000000) AS f, round(cot(x + 2) * 1000000) AS g, round(exp(x) * 1000000) AS h, round(log10(x * x + 1) * 1000000) AS i, round(radians(x) * 1000000) AS j, round(exp(1) * 1000000) AS k FROM (SELECT *, c_acctbal / 10000.0 AS x FROM customer)")
_add("trimming_and_lists", tpch_graph,
     "MATCH (p:Part) LET words = split(p.kind, ' ') RETURN p.key AS key, lower(p.brand) AS a, ltrim('  ' + p.name + ' ') AS b, rtrim(' ' + p.name + '  ') AS c, last(words) AS d, isEmpty(p.name) AS e, isEmpty(tail(words)) AS f, size(toList(words)) AS g, reverse(words) AS h, rand() < 1.0 AS i",
     "SELECT p_partkey AS key, lower(p_brand) AS a, ltrim('  ' || p_name || ' ') AS b, rtrim(' ' || p_name || '  ') AS c, list_last(w) AS d, p_name = '' AS e, len(w) < 2 AS f, CAST(len(w) AS BIGINT) AS g, list_reverse(w) AS h, true AS i FROM (SELECT *, string_split(p_type, ' ') AS w FROM part)")
_add("entity_functions", tpch_graph,
     "MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN c.key AS key, labels(c) AS labels, type(r) AS type, id(startNode(r)) = id(c) AS a, id(endNode(r)) = id(n) AS b, size(keys(n)) AS k, properties(n).name AS name",
     "SELECT c_custkey AS key, ['Customer'] AS labels, 'IN_NATION' AS type, true AS a, true AS b, CAST(2 AS BIGINT) AS k, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("type_alternation", tpch_graph,
     "MATCH (x)-[r:IN_NATION|BASED_IN]->(n:Nation) RETURN n.key AS key, type(r) AS type, count(*) AS n",
     "SELECT CAST(k AS BIGINT) AS key, type, count(*) AS n FROM (SELECT c_nationkey AS k, 'IN_NATION' AS type FROM customer UNION ALL SELECT s_nationkey, 'BASED_IN' FROM supplier) GROUP BY ALL")
_add("collect_in_order", tpch_graph,
     "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.name DESC RETURN r.name AS region, collect(n.key) AS keys",
     "SELECT r_name AS region, list(CAST(n_nationkey AS BIGINT) ORDER BY n_name DESC) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("collect_of_list", tpch_graph, "UNWIND [1, 2, 2, null, 5, 4] AS x RETURN collect(x) AS every, collect(DISTINCT x) AS once, count(DISTINCT x) AS n", "SELECT [CAST(1 AS BIGINT), 2, 2, 5, 4] AS every, [CAST(1 AS BIGINT), 2, 5, 4] AS once, CAST(4 AS BIGINT) AS n")
_add("temporal_truncate_times", events_graph,
     "MATCH (u:User) HISTORY u.value FROM datetime('2024-01-01T00:00:00Z') TO datetime('2024-02-01T00:00:00Z') AS s LET t = datetime.fromEpochMillis(s.time / 1000000) RETURN u.key AS key, s.time AS time, toString(datetime.truncate('hour', t)) AS hour, toString(datetime.truncate('day', t)) AS day, t.minute AS minute, t.second AS second",
     "SELECT user_id AS key, epoch_us(ts) * 1000 AS time, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00Z') AS hour, strftime(date_trunc('day', ts), '%Y-%m-%dT00:00Z') AS day, minute(ts) AS minute, second(ts) AS second FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01'")
_add("temporal_durations", tpch_graph,
     "MATCH (o:Order) LET a = date(o.orderdate), b = date('1999-03-15') RETURN o.key AS key, duration.inMonths(a, b).months AS months, duration.inSeconds(a, b).seconds AS seconds, duration.between(a, b).months AS m",
     "SELECT o_orderkey AS key, date_sub('month', CAST(o_orderdate AS DATE), DATE '1999-03-15') AS months, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-03-15') * 86400 AS seconds, date_sub('month', CAST(o_orderdate AS DATE), DATE '1999-03-15') AS m FROM orders")
_add("temporal_now", tpch_graph,
     "RETURN date.transaction() = date.statement() AS a, datetime.transaction() <= datetime.realtime() AS b, localdatetime.statement() <= localdatetime.realtime() AS c, time.statement() = time.statement() AS d, localtime.transaction() = localtime.transaction() AS e, date.realtime() >= date('2020-01-01') AS f",
     "SELECT true AS a, true AS b, true AS c, true AS d, true AS e, true AS f")
_add("local_times", tpch_graph,
     "UNWIND ['10:15:30', '23:59:01'] AS s LET t = localtime(s) RETURN s, t.hour AS h, t.minute AS m, t.second AS x, toString(localtime.truncate('minute', t)) AS c, toString(localdatetime('2024-02-29T' + s)) AS l, toString(localdatetime.truncate('hour', localdatetime('2024-02-29T' + s))) AS lh",
     "SELECT * FROM (VALUES ('10:15:30', CAST(10 AS BIGINT), CAST(15 AS BIGINT), CAST(30 AS BIGINT), '10:15', '2024-02-29T10:15:30', '2024-02-29T10:00'), ('23:59:01', 23, 59, 1, '23:59', '2024-02-29T23:59:01', '2024-02-29T23:00')) v(s, h, m, x, c, l, lh)")
_add("conversion_functions", tpch_graph,
     "UNWIND ['1', '2.9', 'x', 'true', ' 7 '] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(toInteger(s)) AS t, coalesce(toInteger(s), -1) AS c",
     "SELECT * FROM (VALUES ('1', CAST(1 AS BIGINT), CAST(1 AS DOUBLE), NULL, '1', CAST(1 AS BIGINT)), ('2.9', 2, 2.9, NULL, '2', 2), ('x', NULL, NULL, NULL, NULL, -1), ('true', NULL, NULL, true, NULL, -1), (' 7 ', 7, 7, NULL, '7', 7)) t(s, i, f, b, t, c)")
_add("regex_match", tpch_graph, "MATCH (s:Supplier) WHERE s.name =~ '.*[05]' RETURN s.key AS key", "SELECT s_suppkey AS key FROM supplier WHERE regexp_full_match(s_name, '.*[05]')")
_add("three_valued_logic", tpch_graph,
     "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS n, a = b AS e",
     "SELECT a, b, a AND b AS x, a OR b AS y, a <> b AS z, NOT a AS n, a = b AS e FROM (SELECT unnest([true, false, NULL]) AS a), (SELECT unnest([true, false, NULL]) AS b)")
_add("integer_division_modulo", tpch_graph, "UNWIND [7, -7] AS a UNWIND [3, -3] AS b RETURN a, b, a / b AS q, a % b AS r, a / 2.0 AS f, a ^ 2 AS p", "SELECT a, b, CAST(trunc(a / b) AS BIGINT) AS q, a % b AS r, a / 2.0 AS f, CAST(a * a AS DOUBLE) AS p FROM (SELECT unnest([CAST(7 AS BIGINT), -7]) AS a), (SELECT unnest([CAST(3 AS BIGINT), -3]) AS b)")
_add("temporal_construct_truncate", tpch_graph,
     "MATCH (o:Order) RETURN o.key AS key, date(o.orderdate) AS d, toString(date.truncate('month', date(o.orderdate))) AS m, toString(date.truncate('quarter', date(o.orderdate))) AS q, toString(date.truncate('week', date(o.orderdate))) AS w, toString(date(o.orderdate) + duration('P1M')) AS n",
     "SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS w, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS n FROM orders")
_add("temporal_accessors", tpch_graph,
     "MATCH (o:Order) RETURN o.key AS key, o.orderdate.year AS y, o.orderdate.quarter AS q, o.orderdate.month AS m, o.orderdate.week AS w, o.orderdate.ordinalDay AS od, o.orderdate.dayOfWeek AS dw, o.orderdate.hour AS h",
     "SELECT o_orderkey AS key, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, week(o_orderdate) AS w, dayofyear(o_orderdate) AS od, isodow(o_orderdate) AS dw, hour(o_orderdate) AS h FROM orders")
_add("duration_between", tpch_graph,
     "MATCH (o:Order)-[l:CONTAINS]->() RETURN o.key AS key, l.line AS line, duration.inDays(date(o.orderdate), date(l.shipdate)).days AS days",
     "SELECT o_orderkey AS key, CAST(l_linenumber AS BIGINT) AS line, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
_add("varlen_1_3", trade_graph,
     "MATCH (a:Nation {key: 0})-[r:SELLS_TO*1..3]->(b:Nation) RETURN b.key AS b, size(r) AS hops, count(*) AS n",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT b, 1 AS hops, [a * 1000 + b] AS ids FROM t WHERE a = 0 UNION ALL SELECT t.b, hops + 1, list_append(ids, t.a * 1000 + t.b) FROM p JOIN t ON p.b = t.a WHERE hops < 3 AND NOT list_contains(ids, t.a * 1000 + t.b)) SELECT b, CAST(hops AS BIGINT) AS hops, count(*) AS n FROM p GROUP BY ALL")
_add("varlen_zero", trade_graph,
     "MATCH (a:Nation)-[:SELLS_TO*0..1]->(b:Nation) RETURN a.key AS a, b.key AS b",
     "WITH t AS (%TRADE%) SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM nation UNION ALL SELECT a, b FROM t")
_add("varlen_distinct_endpoint", trade_graph,
     "MATCH (a:Nation)-[:SELLS_TO*1..4]->(b:Nation) RETURN DISTINCT a.key AS a, b.key AS b",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT a, b, 1 AS h FROM t UNION SELECT p.a, t.b, h + 1 FROM p JOIN t ON p.b = t.a WHERE h < 4) SELECT DISTINCT a, b FROM p")
_add("varlen_unbounded_reach", trade_graph,
     "MATCH (a:Nation)-[:SELLS_TO*]->(b:Nation) RETURN a.key AS a, count(DISTINCT b.key) AS n",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT a, b FROM t UNION SELECT p.a, t.b FROM p JOIN t ON p.b = t.a) SELECT a, count(*) AS n FROM p GROUP BY 1")
_add("path_acyclic", trade_graph,
     "MATCH ACYCLIC (a:Nation {key: 1})-[r:SELLS_TO*1..4]->(b:Nation) RETURN size(r) AS hops, count(*) AS n",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT b, 1 AS hops, [a, b] AS ns FROM t WHERE a = 1 AND b <> 1 UNION ALL SELECT t.b, hops + 1, list_append(ns, t.b) FROM p JOIN t ON p.b = t.a WHERE hops < 4 AND NOT list_contains(ns, t.b)) SELECT CAST(hops AS BIGINT) AS hops, count(*) AS n FROM p GROUP BY 1")
_add("path_walk", trade_graph,
     "MATCH REPEATABLE ELEMENTS (a:Nation {key: 2})-[r:SELLS_TO*3..3]->(b:Nation) RETURN b.key AS b, count(*) AS n",
     "WITH t AS (%TRADE%) SELECT z.b, count(*) AS n FROM t x JOIN t y ON x.b = y.a JOIN t z ON y.b = z.a WHERE x.a = 2 GROUP BY 1")
_SHORT = "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT a, b, 1 AS h FROM t UNION SELECT p.a, t.b, h + 1 FROM p JOIN t ON p.b = t.a WHERE h < 5), d AS (SELECT a, b, min(h) AS h FROM p GROUP BY 1, 2)"
_add("path_shortest_any", trade_graph, "MATCH p = ANY SHORTEST (a:Nation)-[:SELLS_TO*1..5]->(b:Nation) RETURN a.key AS a, b.key AS b, length(p) AS hops", _SHORT + " SELECT a, b, CAST(h AS BIGINT) AS hops FROM d")
_add("path_shortest_all", trade_graph,
     "MATCH p = ALL SHORTEST (a:Nation)-[:SELLS_TO*1..5]->(b:Nation) RETURN a.key AS a, b.key AS b, length(p) AS hops, count(*) AS n",
     _SHORT + ", w AS (SELECT a, b, 1 AS h FROM t UNION ALL SELECT w.a, t.b, w.h + 1 FROM w JOIN t ON w.b = t.a WHERE w.h < 5) SELECT d.a, d.b, CAST(d.h AS BIGINT) AS hops, count(*) AS n FROM d JOIN w ON d.a = w.a AND d.b = w.b AND d.h = w.h GROUP BY ALL")
_add("path_shortest_k_groups", trade_graph,
     "MATCH p = SHORTEST 2 GROUPS (a:Nation {key: 0})-[:SELLS_TO*1..4]->(b:Nation) RETURN b.key AS b, length(p) AS hops, count(*) AS n",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT b, 1 AS h, [a * 1000 + b] AS ids FROM t WHERE a = 0 UNION ALL SELECT t.b, h + 1, list_append(ids, t.a * 1000 + t.b) FROM p JOIN t ON p.b = t.a WHERE h < 4 AND NOT list_contains(ids, t.a * 1000 + t.b)), r AS (SELECT *, dense_rank() OVER (PARTITION BY b ORDER BY h) AS k FROM p) SELECT b, CAST(h AS BIGINT) AS hops, count(*) AS n FROM r WHERE k <= 2 GROUP BY ALL")
_add("path_nodes_relationships", trade_graph,
     "MATCH p = (a:Nation {key: 0})-[:SELLS_TO*2..2]->(b:Nation) RETURN [n IN nodes(p) | n.key] AS keys, [r IN relationships(p) | r.lines] AS lines",
     "WITH t AS (%TRADE%) SELECT [x.a, x.b, y.b] AS keys, [x.lines, y.lines] AS lines FROM t x JOIN t y ON x.b = y.a AND NOT (x.a = y.a AND x.b = y.b) WHERE x.a = 0")
_add("algo_degree", trade_graph, "CALL graph.degree() YIELD node, outDegree, inDegree, degree RETURN node.key AS key, outDegree, inDegree, degree",
     "WITH t AS (%TRADE%) SELECT key, o AS outDegree, i AS inDegree, o + i AS degree FROM (SELECT CAST(n_nationkey AS BIGINT) AS key, (SELECT count(*) FROM t WHERE a = n_nationkey) AS o, (SELECT count(*) FROM t WHERE b = n_nationkey) AS i FROM nation)")
_add("algo_bfs", trade_graph, "MATCH (s:Nation {key: 0}) CALL graph.bfs(s) YIELD node, distance RETURN node.key AS key, distance",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT CAST(0 AS BIGINT) AS v, 0 AS h UNION SELECT t.b, h + 1 FROM p JOIN t ON p.v = t.a WHERE h < 26) SELECT v AS key, CAST(min(h) AS BIGINT) AS distance FROM p GROUP BY 1")
_add("algo_shortestpath_cost", trade_graph, "MATCH (s:Nation {key: 0})-[:SELLS_TO*1..3]->(e:Nation) WHERE e.key <> 0 WITH DISTINCT s, e ORDER BY e.key DESC LIMIT 3 CALL graph.shortestpath(s, e) YIELD path, cost RETURN e.key AS key, cost, length(path) AS hops",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT CAST(0 AS BIGINT) AS v, 0 AS h UNION SELECT t.b, h + 1 FROM p JOIN t ON p.v = t.a WHERE h < 3) SELECT v AS key, CAST(min(h) AS BIGINT) AS cost, CAST(min(h) AS BIGINT) AS hops FROM p WHERE v <> 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
_add("algo_dijkstra_cost", trade_graph, "MATCH (s:Nation {key: 0}) CALL graph.dijkstra(s, 'rank') YIELD node, cost RETURN node.key AS key, cost",
     'WITH RECURSIVE t AS (%TRADE%), p AS (SELECT CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS c UNION SELECT t.b, c + t.rank FROM p JOIN t ON p.v = t.a WHERE c + t.rank < 30) SELECT v AS key, CAST(min(c) AS DOUBLE) AS cost FROM p GROUP BY 1')
_add("algo_wcc", trade_graph, "CALL graph.wcc() YIELD node, component RETURN component, count(*) AS n",
     "WITH RECURSIVE t AS (%TRADE%), e AS (SELECT a, b FROM t UNION SELECT b, a FROM t UNION SELECT n_nationkey, n_nationkey FROM nation), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a), m AS (SELECT a, min(b) AS c FROM p GROUP BY 1) SELECT dense_rank() OVER (ORDER BY c) - 1 AS component, n FROM (SELECT c, count(*) AS n FROM m GROUP BY 1)")
_add("algo_scc", trade_graph, "CALL graph.scc() YIELD node, component RETURN component, count(*) AS n",
     "WITH RECURSIVE t AS (%TRADE%), p AS (SELECT a, b FROM t UNION SELECT n_nationkey, n_nationkey FROM nation UNION SELECT p.a, t.b FROM p JOIN t ON p.b = t.a), m AS (SELECT x.a, min(x.b) AS c FROM p x JOIN p y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT dense_rank() OVER (ORDER BY c) - 1 AS component, n FROM (SELECT c, count(*) AS n FROM m GROUP BY 1)")
_PR = "r{k} AS (SELECT v, (0.15 + 0.85 * (SELECT coalesce(sum(s), 0) FROM r{j} WHERE v NOT IN (SELECT a FROM t))) / 25 + 0.85 * coalesce((SELECT sum(s / o) FROM t JOIN r{j} q ON q.v = t.a JOIN deg ON deg.a = t.a WHERE t.b = r{j}.v), 0) AS s FROM r{j})"
_add("algo_pagerank_fixed_iter", trade_graph, "CALL graph.pagerank(0.85, 0.0, 5) YIELD node, score RETURN node.key AS key, round(score * 1000000) / 1000000.0 AS score",
     "WITH t AS (%TRADE%), deg AS (SELECT a, count(*) AS o FROM t GROUP BY 1), r0 AS (SELECT CAST(n_nationkey AS BIGINT) AS v, 0.04::DOUBLE AS s FROM nation), " + ", ".join(_PR.format(k=k, j=k - 1) for k in range(1, 6)) + " SELECT v AS key, round(s * 1000000) / 1000000.0 AS score FROM r5")
_UND = "WITH t AS (%TRADE%), e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM t WHERE a <> b)"
_add("algo_triangles", trade_graph, "CALL graph.trianglecount() YIELD triangleCount RETURN triangleCount AS triangles", _UND + " SELECT count(*) AS triangles FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b")
_add("algo_clustering", trade_graph, "CALL graph.clusteringcoefficient() YIELD node, coefficient RETURN node.key AS key, round(coefficient * 1000000) / 1000000.0 AS coefficient",
     _UND + ", u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a, count(*) AS d FROM u GROUP BY 1), l AS (SELECT x.a, count(*) AS n FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1) SELECT CAST(n_nationkey AS BIGINT) AS key, coalesce(CASE WHEN d.d >= 2 THEN round(2.0 * coalesce(n, 0) / (d.d * (d.d - 1)) * 1000000) / 1000000.0 END, 0.0) AS coefficient FROM nation LEFT JOIN d ON d.a = n_nationkey LEFT JOIN l ON l.a = n_nationkey")
_HINDEX = "c{k} AS (SELECT v, max(least(c, n)) AS c FROM (SELECT u.a AS v, p.c, count(*) OVER (PARTITION BY u.a ORDER BY p.c DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM u JOIN c{j} p ON p.v = u.b) GROUP BY v)"
_add("algo_kcore", trade_graph, "CALL graph.kcore() YIELD node, core RETURN node.key AS key, core",
     _UND + ", u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c0 AS (SELECT a AS v, count(*) AS c FROM u GROUP BY 1), " + ", ".join(_HINDEX.format(k=k, j=k - 1) for k in range(1, 13)) + " SELECT CAST(n_nationkey AS BIGINT) AS key, coalesce(c, 0) AS core FROM nation LEFT JOIN c12 ON v = n_nationkey")
_add("algo_louvain_rows", trade_graph, "CALL graph.louvain() YIELD node, community RETURN node.key AS key, community", None)
_add("algo_dfs_rows", trade_graph, "MATCH (s:Nation {key: 0}) CALL graph.dfs(s) YIELD node, order RETURN node.key AS key, order", None)
_NANOS = "epoch_us(ts) * 1000"
_add("history_range", events_graph, "MATCH (u:User) HISTORY u.value FROM datetime('2024-01-05T00:00:00Z') TO datetime('2024-01-09T12:00:00Z') AS s RETURN u.key AS key, s.time AS time, s.value AS value",
     f"SELECT user_id AS key, {_NANOS} AS time, value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-09 12:00:00'")
_add("at_time", events_graph, "AT TIME datetime('2024-01-12T00:00:00Z') MATCH (u:User) RETURN u.key AS key, u.value AS value",
     "SELECT u.user_id AS key, e.value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events WHERE ts <= '2024-01-12' GROUP BY 1) e ON u.user_id = e.user_id")
_add("current_value", events_graph, "MATCH (u:User) RETURN u.key AS key, u.value AS value", "SELECT user_id AS key, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1")
_HIST = "MATCH (u:User) HISTORY u.value FROM datetime('2024-01-01T00:00:00Z') TO datetime('2024-02-01T00:00:00Z') AS s "
_add("window_tumbling", events_graph, _HIST + "WINDOW TUMBLING duration('PT6H') ON s.time AS w WITH w.start AS start, w.end AS end, s RETURN start, end, count(*) AS n, round(sum(s.value) * 100) / 100.0 AS total",
     f'SELECT w AS start, w + 21600000000000 AS "end", count(*) AS n, round(sum(value) * 100) / 100.0 AS total FROM (SELECT *, ({_NANOS}) // 21600000000000 * 21600000000000 AS w FROM events WHERE ts >= \'2024-01-01\' AND ts < \'2024-02-01\') GROUP BY 1')
_add("window_hopping", events_graph, _HIST + "WINDOW HOPPING duration('P3D') EVERY duration('P1D') ON s.time ALIGN TO datetime('2024-01-01T00:00:00Z') AS w WITH w.start AS start, s RETURN start, count(*) AS n",
     f"SELECT w AS start, count(*) AS n FROM (SELECT ({_NANOS}) // 86400000000000 * 86400000000000 - k * 86400000000000 AS w FROM events, (SELECT unnest([0, 1, 2]) AS k) WHERE ts >= '2024-01-01' AND ts < '2024-02-01') GROUP BY 1")
_add("window_emit_empty", events_graph, "MATCH (u:User {key: 3}) HISTORY u.value FROM datetime('2024-01-01T00:00:00Z') TO datetime('2024-02-01T00:00:00Z') AS s WINDOW TUMBLING duration('PT6H') ON s.time EMIT EMPTY AS w WITH w.start AS start, s RETURN start, count(s) AS n",
     f"WITH h AS (SELECT ({_NANOS}) // 21600000000000 * 21600000000000 AS w FROM events WHERE user_id = 3 AND ts >= '2024-01-01' AND ts < '2024-02-01'), g AS (SELECT unnest(generate_series((SELECT min(w) FROM h), (SELECT max(w) FROM h), 21600000000000)) AS w) SELECT g.w AS start, count(h.w) AS n FROM g LEFT JOIN h ON g.w = h.w GROUP BY 1")
_add("window_calendar_month", tpch_graph, "MATCH (o:Order) WINDOW TUMBLING duration('P1M') ON o.orderdate AS w WITH w.start AS start, o RETURN start, count(*) AS n", "SELECT epoch_us(date_trunc('month', o_orderdate)) * 1000 AS start, count(*) AS n FROM orders GROUP BY 1")
_add("layer_filter", lambda s, d: _layered(s, d), "USE LAYERS OBSERVED MATCH (c:Customer) RETURN c.mktsegment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1")
_add("layer_default", lambda s, d: _layered(s, d), "MATCH (c:Customer) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_custkey % 3 < 2")
_add("traverse_turns", library_graph, "MATCH (a:Turn)-[:NEXT]->(b:Turn) RETURN a.role AS a, b.role AS b, count(*) AS n", "SELECT x.role AS a, y.role AS b, count(*) AS n FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 GROUP BY ALL")
_add("vector_functions", library_graph,
     "MATCH (a:Item {key: 0}), (b:Item) RETURN b.key AS key, round(vector.dot(a.embedding, b.embedding) * 10000) AS dot, round(vector.cosine(a.embedding, b.embedding) * 10000) AS cosine, round(vector.distance(a.embedding, b.embedding) * 10000) AS distance, size(vector.normalize(b.embedding)) AS dims",
     "SELECT b.vec_id AS key, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000) AS distance, CAST(len(b.embedding) AS BIGINT) AS dims FROM embeddings a, embeddings b WHERE a.vec_id = 0")
_TEXT_SQL = "SELECT doc_id AS key FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'licensed') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'apache')"


def _layered(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers dealt over the three layers by key."""
    g = tpch_graph(spark, sf_dir)
    tables = tuple(t if "Customer" not in t.labels else type(t)(t.labels, t.df.withColumn("layer", (F.col("key") % 3).cast("tinyint"))) for t in g.nodes)
    return g.with_(nodes=tables)


#: Each nation's three best buyers, for the SQL side.
TRADE_SQL = """SELECT a, b, lines, rank FROM (SELECT CAST(s_nationkey AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b, count(*) AS lines, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) AS rank
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, c_nationkey) WHERE rank <= 3"""

_SEARCH = {"cosine": "list_cosine_similarity", "dot": "list_inner_product", "euclidean": "list_distance"}


def _vector(measure: str, where: str = ""):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = library_graph(spark, sf_dir)
        probe = [float(x) for x in g.cypher("MATCH (i:Item {key: 7}) RETURN i.embedding AS e").first()["e"]]
        g = g.with_(indexes={"items": {"kind": "vector", "label": "Item", "prop": "embedding", "similarity": measure}})
        return g.cypher(f"MATCH (i:Item) {where} SEARCH i IN (VECTOR INDEX items FOR VECTOR $v USING EXACT LIMIT 10) SCORE AS s RETURN i.key AS key, round(s * 10000) / 10000.0 AS score", v=probe)

    return q


def _vector_sql(measure: str, where: str = "") -> str:
    order = "" if measure == "euclidean" else "DESC"
    f = f"{_SEARCH[measure]}(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"
    return f"SELECT vec_id AS key, round(s * 10000) / 10000.0 AS score FROM (SELECT vec_id, {f} AS s FROM embeddings {where} ORDER BY s {order}, vec_id LIMIT 10)"


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = library_graph(spark, sf_dir).with_(indexes={"texts": {"kind": "text", "label": "Document", "prop": "text"}})
    return g.cypher("MATCH (d:Document) SEARCH d IN (TEXT INDEX texts FOR TEXT 'licensed Apache' LIMIT 100000000) SCORE AS s RETURN d.key AS key")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have an embedding, by the reciprocal ranks of both branches."""
    g = library_graph(spark, sf_dir)
    docs = next(t for t in g.nodes if "Document" in t.labels)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding")
    g = g.with_(nodes=(type(docs)(frozenset(["Paper"]), docs.df.join(vectors, "key")),), rels=())
    g = g.with_(indexes={"papers": {"kind": "vector", "label": "Paper", "prop": "embedding", "text": "text", "similarity": "cosine"}})
    probe = [float(x) for x in g.cypher("MATCH (p:Paper {key: 7}) RETURN p.embedding AS e").first()["e"]]
    return g.cypher("MATCH (p:Paper) SEARCH p IN (VECTOR INDEX papers FOR HYBRID TEXT 'apache license' VECTOR $v LIMIT 20) SCORE AS s RETURN p.key AS key, s AS score", v=probe)


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tpch_graph(spark, sf_dir).with_(rels=())
    g = g.execute("UNWIND ['ASIA', 'ATLANTIS', 'ATLANTIS'] AS n MERGE (r:Region {name: n}) ON CREATE SET r.fresh = true ON MATCH SET r.fresh = false").graph
    return g.cypher("MATCH (r:Region) RETURN r.name AS name, r.fresh AS fresh")


def _set_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tpch_graph(spark, sf_dir)
    g = g.execute("MATCH (n:Nation) WHERE n.key < 10 SET n.code = n.key * 2, n:Early").graph
    g = g.execute("MATCH (n:Early) WHERE n.key > 6 REMOVE n.code").graph
    return g.cypher("MATCH (n:Nation) RETURN n.key AS key, n.code AS code, n:Early AS early")


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tpch_graph(spark, sf_dir).execute("MATCH (n:Nation) WHERE n.key >= 20 DETACH DELETE n").graph
    return g.cypher("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.key AS key, count(*) AS n")


def _create(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tpch_graph(spark, sf_dir)
    g = g.execute("MATCH (r:Region) CREATE (r)-[:HAS {since: 1990}]->(:Office {name: 'Office of ' + r.name})").graph
    return g.cypher("MATCH (r:Region)-[h:HAS]->(o:Office) RETURN r.key AS key, o.name AS name, h.since AS since")


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.temporal import rollup

    samples = events_graph(spark, sf_dir).samples[("node", "User", "value")]
    day = 86_400_000_000_000
    got = rollup(samples, (0, day))
    return got.select((F.col("entity") - node_id("User", F.lit(0))).alias("key"), "start", "count", F.round("sum", 2).alias("total"), "min", "max")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the events as a stream, run to its end into the shared folder."""
    from .lineage import shared_dir
    from .streaming.logs import read_log, windowed

    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = read_log(spark, f"{sf_dir}/events*.parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")  # each batch holds all windows so far

    stream = windowed(log, "ts", "1 day", None, ("event_type",), "value").writeStream.outputMode("complete").foreachBatch(keep)
    stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{path}/out")
    return got.select((F.unix_micros("start") * 1000).alias("start"), "event_type", "count", F.round("sum", 2).alias("total"))


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{f"vector_exact_{m}": (_vector(m), _vector_sql(m)) for m in _SEARCH},
    "vector_filtered": (_vector("cosine", "WHERE i.label < 3"), _vector_sql("cosine", "WHERE label < 3")),
    "text_and_search": (_text, _TEXT_SQL),
    "hybrid_rrf_rows": (_hybrid, None),
    "write_create": (_create, "SELECT CAST(r_regionkey AS BIGINT) AS key, 'Office of ' || r_name AS name, CAST(1990 AS BIGINT) AS since FROM region"),
    "write_merge_snapshot": (_merge, "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN false END AS fresh FROM region UNION ALL SELECT 'ATLANTIS', true"),
    "write_set_remove": (_set_remove, "SELECT CAST(n_nationkey AS BIGINT) AS key, CASE WHEN n_nationkey <= 6 THEN CAST(n_nationkey AS BIGINT) * 2 END AS code, n_nationkey < 10 AS early FROM nation"),
    "write_delete_detach": (_delete, "SELECT CAST(c_nationkey AS BIGINT) AS key, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1"),
    "stream_tumbling": (_stream, f"SELECT ({_NANOS}) // 86400000000000 * 86400000000000 AS start, event_type, count(*) AS count, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "rollup_daily": (_rollup, f"SELECT user_id AS key, ({_NANOS}) // 86400000000000 * 86400000000000 AS start, count(value) AS count, round(sum(value), 2) AS total, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: (lambda s, d, g=g, c=c: g(s, d).cypher(c)) for n, (g, c, _) in CYPHER.items()}
    return out | {n: f for n, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: sql.replace("%TRADE%", TRADE_SQL) for n, (_, _, sql) in CYPHER.items() if sql}
    return out | {n: sql for n, (_, sql) in FRAMES.items() if sql}
