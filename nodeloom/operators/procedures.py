"""CALL: the algorithms by name, and tables that the host has registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import stored
from ..plans.tree import Clause, Expr, QueryError
from ..plans.values import LONG, NodeT, PathT, RelT, Value, equal, kind
from . import algorithms as A

#: Most distinct argument tuples that one CALL may run an algorithm for.
MOST_CALLS = 100


def _ranks(n, e, *args):
    return A.pagerank(n, e, *args)


#: name -> (argument counts, columns of the result, whether the first argument is a source node).
SIGNATURES = {
    "graph.degree": ((0,), ("node", "outDegree", "inDegree", "degree")), "graph.bfs": ((1,), ("node", "distance")), "graph.dfs": ((1,), ("node", "order")),
    "graph.shortestpath": ((2,), ("path", "cost")), "graph.dijkstra": ((1, 2), ("node", "cost", "predecessor")), "graph.wcc": ((0,), ("node", "component")),
    "graph.scc": ((0,), ("node", "component")), "graph.pagerank": ((0, 3), ("node", "score")), "graph.louvain": ((0,), ("node", "community")),
    "graph.trianglecount": ((0,), ("triangleCount",)), "graph.clusteringcoefficient": ((0,), ("node", "coefficient")), "graph.kcore": ((0,), ("node", "core")),
}


def _edges(ctx) -> DataFrame:
    """The relationships between nodes of the graph."""
    scan = ctx.graph.node_scan([]).select("id")
    return ctx.graph.rel_scan([]).join(scan.select(F.col("id").alias("src")), "src", "left_semi").join(scan.select(F.col("id").alias("dst")), "dst", "left_semi")


def run(ctx, name: str, args: tuple, inside: DataFrame | None = None) -> DataFrame:
    """The procedure's rows; nodes as ids."""
    scan = ctx.graph.node_scan([]).select("id")
    inside = _edges(ctx) if inside is None else inside
    e = inside.select("src", "dst")
    if name == "graph.degree":
        return A.degree(scan, e)
    if name == "graph.bfs":
        return A.bfs(scan, e, args[0])
    if name == "graph.dfs":
        return A.dfs(scan, e, args[0])
    if name == "graph.dijkstra":
        if len(args) == 1 or args[1] is None:
            return A.dijkstra(scan, e.withColumn("weight", F.lit(1.0)), args[0])
        if args[1] not in inside.columns:
            raise QueryError(f"InvalidArgumentValue: no relationship has {args[1]}")
        return A.dijkstra(scan, inside.select("src", "dst", F.col(f"`{args[1]}`").cast("double").alias("weight")), args[0])
    if name == "graph.pagerank":
        return A.pagerank(scan, e, *args)
    if name == "graph.trianglecount":
        return A.triangle_count(e)
    return {"graph.wcc": A.wcc, "graph.scc": A.scc, "graph.louvain": A.louvain, "graph.clusteringcoefficient": A.clustering, "graph.kcore": A.kcore}[name](scan, e)


def shortest(ctx, ids: list[int] | None) -> DataFrame:
    """path, cost of the nodes on a path: one row, or none without a path."""
    nodes, rels = ctx.node_structs(), ctx.graph.rel_scan([])
    spark = ctx.graph.spark
    steps = spark.createDataFrame([(i, x) for i, x in enumerate(ids or [])], "i long, id long")
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(ids or [], (ids or [])[1:]))], "i long, src long, dst long")
    ns = steps.join(nodes, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "id", "node"))), lambda x: x["node"]).alias("nodes"))
    one = pairs.join(rels.select("src", "dst", "id", F.struct(*[F.col(f"`{c}`") for c in rels.columns]).alias("rel")), ["src", "dst"])
    one = one.groupBy("i").agg(F.min_by("rel", "id").alias("rel"))
    rs = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rel")), lambda a, b: (a["i"] - b["i"]).cast("int")), lambda x: x["rel"]).alias("rels"))
    out = ns.join(rs).select(F.struct("nodes", "rels").alias("path"), F.size("rels").cast("long").alias("cost"))
    return out if ids else out.limit(0)


def call(ctx, rows, c: Clause, standalone: bool):
    """Rows of a CALL clause, and whether it ends the query."""
    from ..plans.compiler import Bound, Rows, col

    name, d = c.data["name"].lower(), c.data
    if name not in SIGNATURES and name not in ctx.graph.procedures:
        raise QueryError(f"unknown procedure {d['name']}")
    columns = SIGNATURES[name][1] if name in SIGNATURES else ctx.graph.procedures[name][1]
    if d["star"] and not standalone:
        raise QueryError("YIELD * stands alone only")
    if d["yields"] is None and not standalone:
        raise QueryError("CALL within a query needs YIELD")
    yields = [(x, x) for x in columns] if d["yields"] is None else d["yields"]
    for x, _ in yields:
        if x not in columns:
            raise QueryError(f"{d['name']} yields no {x}")
    if name in ctx.graph.procedures:
        return _registered(ctx, rows, c, name, yields, standalone)
    args: list[Expr] = d["args"] or []
    if len(args) not in SIGNATURES[name][0]:
        raise QueryError(f"{d['name']} takes {' or '.join(map(str, SIGNATURES[name][0]))} arguments")
    rows, comp = ctx.prepared(rows, *args)
    values = [comp(a) for a in args]
    plain = [v.col["id"] if kind(v.type) == "node" else v.col for v in values]
    if rows.df is None:
        tuples = [tuple(ctx.one().select(*[p.alias(f"a{i}") for i, p in enumerate(plain)]).first() or ())]
        keyed = Rows(ctx.one(), {})
    else:
        if plain:
            named = rows.df.withColumns({f"_arg{i}": p for i, p in enumerate(plain)})
            tuples = [tuple(r) for r in named.select(*[f"_arg{i}" for i in range(len(plain))]).distinct().limit(MOST_CALLS + 1).collect()]
            if len(tuples) > MOST_CALLS:
                raise QueryError(f"{d['name']} is called for more than {MOST_CALLS} different arguments")
            keyed = Rows(named, rows.env)
        else:
            tuples, keyed = [()], rows
    frames = []
    if any(x is None for t in tuples for x in t):
        raise QueryError(f"InvalidArgumentValue: {d['name']} takes no null")
    inside = stored(_edges(ctx)) if len(tuples) > 1 else None  # for all calls
    paths: dict[tuple, list[int]] = {}
    if name == "graph.shortestpath":  # one search for all targets of a source
        for source in {t[0] for t in tuples}:
            found = A.shortest_paths(ctx.graph.node_scan([]).select("id"), _edges(ctx) if inside is None else inside, source, {t[1] for t in tuples if t[0] == source})
            paths |= {(source, target): ids for target, ids in found.items()}
    for t in tuples:
        got = shortest(ctx, paths.get(t)) if name == "graph.shortestpath" else run(ctx, name, t, inside)
        frames.append(got.withColumns({f"_key{i}": F.lit(x) for i, x in enumerate(t)}))
    if not frames:
        frames = [run(ctx, "graph.degree", ()).limit(0)] if name == "graph.degree" else []
        if not frames:
            return Rows(rows.df.limit(0), rows.env), standalone
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    ids = {"node": "id"}
    uid = ctx.uid("call")
    out = out.select(*[F.col(f"`{x}`").alias(f"{uid}.{x}" if not x.startswith("_key") else f"{uid}{x}") for x in out.columns])
    if rows.df is None:
        df = out
    elif plain:
        on = F.lit(True)
        for i in range(len(plain)):
            on = on & (F.col(f"_arg{i}") == col(f"{uid}_key{i}"))
        df = keyed.df.join(out, on).drop(*[f"_arg{i}" for i in range(len(plain))])
    else:
        df = keyed.df.crossJoin(out)
    env = dict(rows.env)
    for x, alias in yields:
        c_name = f"{uid}.{ids.get(x, x)}"
        t = df.schema[c_name].dataType
        if x in ("node", "predecessor"):
            scan = ctx.node_scan([])
            sub = ctx.uid(alias)
            flat, bound = ctx.flat(scan, sub, "node")
            df = df.join(flat, col(c_name) == col(bound.cols["id"][0]), "left" if x == "predecessor" else "inner")
            env[alias] = bound
        elif x == "path":
            pt = PathT([T.StructField("nodes", T.ArrayType(NodeT(t["nodes"].dataType.elementType.fields))), T.StructField("rels", T.ArrayType(RelT(t["rels"].dataType.elementType.fields)))])
            env[alias] = Bound("value", {"": (c_name, pt)})
        else:
            env[alias] = Bound("value", {"": (c_name, t)})
    out_rows = Rows(df, env)
    if d["where"] is not None:
        out_rows = ctx.filter(out_rows, d["where"])
    return out_rows, standalone


def _registered(ctx, rows, c: Clause, name: str, yields, standalone):
    """A registered table (inputs, outputs, DataFrame): rows whose inputs are all equal."""
    from ..plans.compiler import Bound, Rows, col

    inputs, _, table = ctx.graph.procedures[name]
    args = c.data["args"]
    if args is None:
        if not standalone:
            raise QueryError(f"{name} needs its arguments within a query")
        args = [Expr("param", (i,), i) for i in inputs]
    if len(args) != len(inputs):
        raise QueryError(f"{name} takes {len(inputs)} arguments")
    rows, comp = ctx.prepared(rows, *args)
    uid = ctx.uid("proc")
    side = table.select(*[F.col(f"`{x}`").alias(f"{uid}.{x}") for x in table.columns])
    df, on = rows.df if rows.df is not None else ctx.one(), F.lit(True)
    for i, a in zip(inputs, args, strict=True):
        on = on & equal(comp(a), Value(col(f"{uid}.{i}"), side.schema[f"{uid}.{i}"].dataType))
    env = {**rows.env, **{alias: Bound("value", {"": (f"{uid}.{x}", side.schema[f"{uid}.{x}"].dataType)}) for x, alias in yields}}
    out = Rows(df.join(side, on), env)
    return (ctx.filter(out, c.data["where"]) if c.data["where"] is not None else out), standalone


__all__ = ["call", "run", "SIGNATURES", "LONG"]
