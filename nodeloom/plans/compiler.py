"""Clauses to DataFrames.

A name bound to a node or relationship stands for flat columns (``uid.id``, ``uid.name``, ...),
so that Catalyst prunes what nobody asks for; structs are made only where an entity is itself a
value. Patterns become equi-joins, EXISTS semi and anti joins, OPTIONAL MATCH left joins of a
pattern that is compiled on its own. Nothing runs while a query is compiled, except
expansions without an upper bound, procedures that iterate, and writes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import AGGREGATES
from ..model import LAYERS, SYSTEM, Graph, column_of, prop_of
from ..operators.paths import Expansion, expand, select_paths
from .expressions import Compiler, Ref
from .parser import parse
from .tree import Clause, Expr, NodePattern, PathPattern, Projection, Query, QueryError, RelPattern
from .values import BOOL, DOUBLE, LONG, STRING, NodeT, PathT, RelT, Value, common, equal, is_int, kind, null, order_key, to


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Bound:
    """A bound name. kind: value, node, rel, rels (a list of relationships). cols: part -> (column, type)."""

    kind: str
    cols: dict[str, tuple[str, T.DataType]]
    known: frozenset[str] = frozenset()  # labels or types that it certainly has
    full: bool = True  # whether the properties are there

    def ref(self) -> Ref:
        if self.kind == "value":
            c, t = self.cols[""]
            return Ref(lambda: Value(col(c), t))
        system = {" id": "id", " labels": "labels", " revision": "revision", " type": "type"}

        def prop(name: str) -> Value | None:
            key = system.get(name, "." + name)
            return Value(col(self.cols[key][0]), self.cols[key][1]) if key in self.cols else None

        return Ref(self.value, prop, self.kind)

    def value(self) -> Value:
        t, parts, fields = (NodeT if self.kind == "node" else RelT), [], []
        for key, (c, ct) in self.cols.items():
            name = key[1:] if key.startswith(".") and key[1:] not in SYSTEM else key
            parts.append(col(c).alias(name))
            fields.append(T.StructField(name, ct))
        return Value(F.when(col(self.cols["id"][0]).isNotNull(), F.struct(*parts)), t(fields))

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.cols.values()]


@dataclass
class Rows:
    """Rows with what their columns are bound to. df is None for the single row without columns."""

    df: DataFrame | None
    env: dict[str, Bound] = field(default_factory=dict)


@dataclass
class Result:
    rows: DataFrame
    graph: Graph
    stats: dict[str, int] = field(default_factory=dict)


class Context:
    """One query: its graph, parameters and names."""

    def __init__(self, graph: Graph, params: dict, at_time: Expr | None = None, write_layer: int = 0):
        self.graph, self.params, self.counter, self.write_layer = graph, params, 0, write_layer
        self.used: set[str] = set()
        self.stats: dict[str, int] = {}
        self.at = at_time

    def uid(self, hint: str) -> str:
        self.counter += 1
        return f"{hint.strip()}#{self.counter}"

    def one(self) -> DataFrame:
        return self.graph.spark.range(1).select()

    # Scans.

    def node_scan(self, labels) -> DataFrame:
        df = self.graph.node_scan(labels)
        for (what, label, prop), samples in self.graph.samples.items():
            if what == "node" and column_of(prop) in df.columns:
                df = self.as_of(df, samples, column_of(prop), F.array_contains("labels", label))
        return df

    def rel_scan(self, types) -> DataFrame:
        df = self.graph.rel_scan(types)
        for (what, type_, prop), samples in self.graph.samples.items():
            if what == "rel" and column_of(prop) in df.columns:
                df = self.as_of(df, samples, column_of(prop), F.col("type") == type_)
        return df

    def as_of(self, df: DataFrame, samples: DataFrame, prop: str, where: Column) -> DataFrame:
        """The property's latest sample, up to the query's AT TIME if there is one."""
        from ..functions.temporal import epoch_nanos

        if self.at is not None:
            samples = samples.where(F.col("time") <= epoch_nanos(Compiler({}, self.params)(self.at)))
        last = samples.groupBy(F.col("entity").alias("_entity")).agg(F.max_by("value", F.struct("time", "seq")).alias("_value"))
        current = F.col("_value") if self.at is not None else F.coalesce("_value", f"`{prop}`")
        return df.join(last, df["id"] == last["_entity"], "left").withColumn(prop, F.when(where, current).otherwise(col(prop))).drop("_entity", "_value")

    # Expressions over rows.

    def compiler(self, rows: Rows, hook=None) -> Compiler:
        return Compiler({n: b.ref() for n, b in rows.env.items()}, self.params, hook)

    def prepared(self, rows: Rows, *exprs: Expr | None) -> tuple[Rows, Compiler]:
        """Rows with columns for the patterns in these expressions, and a compiler that knows them."""
        made: dict[int, Value] = {}
        for e in exprs:
            for x in self.subqueries(e):
                rows, made[id(x)] = self.subquery(rows, x)
        return rows, self.compiler(rows, lambda e: made.get(id(e)))

    def subqueries(self, e: Expr | None):
        if e is None:
            return
        if e.op in ("exists", "pattern", "pattern_comprehension") or (e.op == "call" and e.args[0] in ("startnode", "endnode")):
            yield e
            return
        for a in e.args:
            for x in a if isinstance(a, (list, tuple)) else (a,):
                for y in x if isinstance(x, (list, tuple)) else (x,):
                    if isinstance(y, Expr):
                        yield from self.subqueries(y)

    def outer_names(self, rows: Rows, clauses: list[Clause]) -> list[str]:
        names = set()
        for c in clauses:
            for e in _expressions(c):
                names |= {x.args[0] for x in e.walk() if x.op == "var"}
            for p in c.data.get("patterns", ()):
                names |= {x.var for x in p.parts}
                for x in p.parts:
                    for _, e in x.props:
                        names |= {y.args[0] for y in e.walk() if y.op == "var"}
        return sorted(names & set(rows.env))

    def correlated(self, rows: Rows, clauses: list[Clause]) -> tuple[Rows, list[tuple[str, str]]]:
        """The clauses' rows, run once for all outer rows, and the pairs (outer column, inner column) to join them on.

        If only nodes are shared, the pattern is compiled on its own; else it starts from the
        distinct values that the outer rows have for it.
        """
        names = self.outer_names(rows, clauses)
        first = clauses[0]
        nodes = {p.var for pattern in first.data.get("patterns", ()) for p in pattern.nodes}
        free = len(clauses) == 1 and first.kind == "match" and all(rows.env[n].kind == "node" and n in nodes for n in names)
        if free and (names or rows.df is None):
            inner = self.match(Rows(None), first.data["patterns"], first.data["where"])
            return inner, [(rows.env[n].cols["id"][0], inner.env[n].cols["id"][0]) for n in names]
        keys = [c for n in names for c in rows.env[n].columns]
        seed = Rows(rows.df.select(*map(col, keys)).distinct() if keys else None, {n: rows.env[n] for n in names})
        inner = seed
        for c in clauses:
            if c.kind == "match":
                inner = self.match(inner, c.data["patterns"], c.data["where"]) if not c.data["optional"] else self.optional(inner, c)
            elif c.kind == "filter":
                inner = self.filter(inner, c.data["where"])
            elif c.kind in ("unwind", "let"):
                inner = getattr(self, c.kind)(inner, c)
            elif c.kind == "with":
                kept = [n for n in names if n not in {i.name for i in c.data["projection"].items}]
                inner = self.project(inner, c.data["projection"], keep=kept)
        return inner, [(k, k) for k in keys]

    def subquery(self, rows: Rows, e: Expr) -> tuple[Rows, Value]:
        if e.op == "call":
            return self.end_node(rows, e)
        if e.op == "pattern_comprehension":
            pattern, cond, body = e.args
            clause = Clause("match", {"patterns": [pattern], "where": cond, "optional": False, "mode": None})
            extra = Clause("filter", {"where": body})  # names of the body count as outer names, too
            names = self.outer_names(rows, [clause, extra])
            only = {p.var for p in pattern.nodes}
            if all(rows.env[n].kind == "node" and n in only for n in names):
                inner, pairs = self.correlated(rows, [clause])
            else:
                keys = [c for n in names for c in rows.env[n].columns]
                inner = self.match(Rows(rows.df.select(*map(col, keys)).distinct(), {n: rows.env[n] for n in names}), [pattern], cond)
                pairs = [(k, k) for k in keys]
            inner, comp = self.prepared(inner, body)
            v, out = comp(body), self.uid("list")
            ks = [self.uid("k") for _ in pairs]
            grouped = inner.df.select(*[col(i).alias(k) for (_, i), k in zip(pairs, ks, strict=True)], v.col.alias(out))
            grouped = grouped.groupBy(*map(col, ks)).agg(F.collect_list(col(out)).alias(out))
            t = T.ArrayType(v.type)
            df = self.left_join(rows.df, grouped, pairs, ks)
            return Rows(df, rows.env), Value(F.coalesce(col(out), F.expr(f"cast(array() as {t.simpleString()})") if kind(v.type) != "null" else F.array()), t)
        clauses = list(e.args[0]) if e.op == "exists" else [Clause("match", {"patterns": [e.args[0]], "where": None, "optional": False, "mode": None})]
        inner, pairs = self.correlated(rows, clauses)
        mark, ks = self.uid("exists"), [self.uid("k") for _ in pairs]
        found = inner.df.select(*[col(i).alias(k) for (_, i), k in zip(pairs, ks, strict=True)], F.lit(True).alias(mark))
        found = found.dropDuplicates(ks) if ks else found.limit(1)
        return Rows(self.left_join(rows.df if rows.df is not None else self.one(), found, pairs, ks), rows.env), Value(col(mark).isNotNull(), BOOL)

    def left_join(self, df: DataFrame, other: DataFrame, pairs, ks: list[str], how: str = "left") -> DataFrame:
        on = F.lit(True)
        for (o, i), k in zip(pairs, ks, strict=True):
            same = col(o) == col(k) if o != i else col(o).eqNullSafe(col(k))
            on = same if on is None else on & same
        return df.join(other, on, how).drop(*ks) if how == "left" else df.join(other, on, how)

    def end_node(self, rows: Rows, e: Expr) -> tuple[Rows, Value]:
        name, args, _ = e.args
        v = self.compiler(rows)(args[0])
        if kind(v.type) != "relationship":
            raise QueryError(f"InvalidArgumentValue: {name} takes a relationship")
        nodes, uid = self.node_structs(), self.uid("end")
        side = "src" if name == "startnode" else "dst"
        df = rows.df.withColumn(f"{uid}.k", v.col[side])
        df = df.join(nodes.select(F.col("id").alias(f"{uid}.id"), F.col("node").alias(uid)), col(f"{uid}.k") == col(f"{uid}.id"), "left")
        return Rows(df, rows.env), Value(col(uid), NodeT(nodes.schema["node"].dataType.fields))

    def node_structs(self) -> DataFrame:
        df = self.node_scan([])
        return df.select("id", F.struct(*[col(c) for c in df.columns]).alias("node"))

    def filter(self, rows: Rows, where: Expr | None) -> Rows:
        """TRUE rows only; EXISTS and patterns that stand alone become semi and anti joins."""
        if where is None:
            return rows
        if where.op == "and":
            return self.filter(self.filter(rows, where.args[0]), where.args[1])
        inner = where.args[0] if where.op == "not" else where
        if inner.op in ("exists", "pattern") and rows.df is not None:
            clauses = list(inner.args[0]) if inner.op == "exists" else [Clause("match", {"patterns": [inner.args[0]], "where": None, "optional": False, "mode": None})]
            found, pairs = self.correlated(rows, clauses)
            ks = [self.uid("k") for _ in pairs]
            keys = found.df.select(*[col(i).alias(k) for (_, i), k in zip(pairs, ks, strict=True)])
            if pairs:
                return Rows(self.left_join(rows.df, keys, pairs, ks, "left_anti" if where.op == "not" else "left_semi"), rows.env)
        rows, comp = self.prepared(rows, where)
        df = rows.df if rows.df is not None else self.one()
        return Rows(df.where(comp.predicate(where)), rows.env)

    # Patterns.

    def flat(self, df: DataFrame, uid: str, what: str, known=frozenset()) -> tuple[DataFrame, Bound]:
        system = ("id", "labels", "revision") if what == "node" else ("id", "src", "dst", "type", "revision")
        cols, out = {}, []
        for f in df.schema.fields:
            name = f"{uid}.{f.name}"
            cols[f.name if f.name in system else "." + prop_of(f.name)] = (name, f.dataType)
            out.append(df[f"`{f.name}`"].alias(name))
        return df.select(*out), Bound(what, cols, frozenset(known))

    def inline(self, rows: Rows, var: str, props) -> Rows:
        for key, e in props:
            rows = self.filter(rows, Expr("=", (Expr("prop", (Expr("var", (var,), var), key), ""), e), ""))
        return rows

    def needs_scan(self, n: NodePattern, certain: str | None) -> bool:
        """Whether a node must be read: somebody asks for its parts, or its labels are not certain."""
        return bool(n.props) or n.var in self.used or any(label != certain for label in n.labels) or bool(self.graph.samples)

    def bind_node(self, rows: Rows, n: NodePattern) -> Rows:
        """rows times the nodes of the pattern."""
        scan, bound = self.flat(self.node_scan(n.labels), self.uid(n.var or "n"), "node", n.labels)
        df = scan if rows.df is None else rows.df.crossJoin(scan)
        return self.inline(Rows(df, {**rows.env, n.var: bound}), n.var, n.props)

    def check_node(self, rows: Rows, n: NodePattern) -> Rows:
        """A bound node again: its labels and properties must fit."""
        b = rows.env[n.var]
        if b.kind != "node":
            b = self.unpacked(rows, n.var)
            rows = Rows(rows.df, {**rows.env, n.var: b})
        missing = [x for x in n.labels if x not in b.known]
        if missing and "labels" in b.cols:
            df = rows.df
            for x in missing:
                df = df.where(F.array_contains(col(b.cols["labels"][0]), x))
            rows = Rows(df, rows.env)
        elif missing:
            ids = self.graph.node_scan(n.labels).select(F.col("id").alias("_label_id"))
            rows = Rows(rows.df.join(ids, col(b.cols["id"][0]) == F.col("_label_id"), "left_semi"), rows.env)
        return self.inline(rows, n.var, n.props)

    def unpacked(self, rows: Rows, var: str) -> Bound:
        """A struct value of a node as a bound node (its parts are paths into the struct)."""
        b = rows.env[var]
        name, t = b.cols[""]
        if not isinstance(t, NodeT):
            raise QueryError(f"{var} is no node")
        for f in t.fields:
            rows.df = rows.df.withColumn(f"{name}.{f.name}", col(name)[f.name])
        return Bound("node", {f.name if f.name in ("id", "labels", "revision") else "." + prop_of(f.name): (f"{name}.{f.name}", f.dataType) for f in t.fields})

    def join_node(self, rows: Rows, n: NodePattern, id_col: str, certain: str | None) -> Rows:
        """Bind the node whose id is in a column of rows."""
        if not self.needs_scan(n, certain):
            return Rows(rows.df, {**rows.env, n.var: Bound("node", {"id": (id_col, LONG)}, frozenset(n.labels), False)})
        scan, bound = self.flat(self.node_scan(n.labels), self.uid(n.var or "n"), "node", n.labels)
        df = rows.df.join(scan, col(id_col) == col(bound.cols["id"][0]))
        return self.inline(Rows(df, {**rows.env, n.var: bound}), n.var, n.props)

    def rel_edges(self, r: RelPattern, uid: str, forward: bool) -> tuple[DataFrame, Bound]:
        """Relationships with columns near and far, as walked in this direction."""
        df, bound = self.flat(self.rel_scan(r.types), uid, "rel", r.types)
        src, dst = col(f"{uid}.src"), col(f"{uid}.dst")
        near, far = f"{uid}.near", f"{uid}.far"
        out = df.withColumns({near: src, far: dst})
        back = df.withColumns({near: dst, far: src})
        if r.direction == "both":
            return out.unionByName(back.where(src != dst)), bound
        return (out if (r.direction == "out") == forward else back), bound

    def certain(self, r: RelPattern, forward: bool, far: bool) -> str | None:
        if r.direction == "both":
            a, b = self.graph.ends(r.types, 0), self.graph.ends(r.types, 1)
            return a if a == b else None
        return self.graph.ends(r.types, int(((r.direction == "out") == forward) == far))

    def hop(self, rows: Rows, a: NodePattern, r: RelPattern, b: NodePattern, forward: bool, path: PathPattern) -> Rows:
        if r.variable:
            return self.variable_hop(rows, a, r, b, forward, path)
        uid = self.uid(r.var or "r")
        edges, bound = self.rel_edges(r, uid, forward)
        near, far = f"{uid}.near", f"{uid}.far"
        if a.var in rows.env:
            on = col(rows.env[a.var].cols["id"][0]) == col(near)
            if b.var in rows.env:
                on = on & (col(rows.env[b.var].cols["id"][0]) == col(far))
            df = rows.df.join(edges, on)
        else:
            df = edges if rows.df is None else rows.df.crossJoin(edges)
            rows = self.join_node(Rows(df, rows.env), a, near, self.certain(r, forward, False))
            df = rows.df
            if b.var in rows.env:
                df = df.where(col(rows.env[b.var].cols["id"][0]) == col(far))
        if r.var in rows.env:
            old = rows.env[r.var]
            df = df.where(col(old.cols["id"][0]) == col(bound.cols["id"][0])) if old.kind == "rel" else df
            rows = Rows(df, rows.env)
        else:
            rows = self.inline(Rows(df, {**rows.env, r.var: bound}), r.var, r.props)
        if b.var in rows.env:
            return self.check_node(rows, b) if b.var != a.var else rows
        return self.join_node(rows, b, far, self.certain(r, forward, True))

    def variable_hop(self, rows: Rows, a: NodePattern, r: RelPattern, b: NodePattern, forward: bool, path: PathPattern) -> Rows:
        if a.var not in rows.env:
            rows = self.bind_node(rows, a)
        if rows.env[a.var].kind != "node":
            rows = self.check_node(rows, a)
        uid = self.uid(r.var or "r")
        scan = self.rel_scan(r.types)
        for key, e in r.props:
            key = column_of(key)
            scan = scan.where(equal(Value(scan[f"`{key}`"], scan.schema[key].dataType), Compiler({}, self.params)(e)))
        struct = F.struct(*[scan[f"`{c}`"] for c in scan.columns])
        out = scan.select(F.col("src").alias("near"), F.col("dst").alias("far"), "id", struct.alias("rel"))
        back = scan.select(F.col("dst").alias("near"), F.col("src").alias("far"), "id", struct.alias("rel"))
        edges = out.unionByName(back.where("near <> far")) if r.direction == "both" else out if (r.direction == "out") == forward else back
        x = Expansion(r.lo, r.hi, path.mode, path.selector, path.count)
        if path.var and path.var in self.used:
            x.nodes = self.node_structs()
        reach = not path.var and r.var not in self.used and path.selector is None and r.lo <= 1 and path.mode != "acyclic" and r.direction != "both" and self.distinct_ends
        x.endpoints_only = reach
        if x.endpoints_only:
            edges = edges.select("near", "far").distinct()
        elif r.hi is None and path.mode == "walk":
            raise QueryError("REPEATABLE ELEMENTS needs an upper bound")
        start = rows.env[a.var].cols["id"][0]
        keys = rows.df.columns
        found = expand(rows.df, start, edges, x)
        env = dict(rows.env)
        if b.var in env and b.var != a.var:
            found = found.where(F.col("_end") == col(env[b.var].cols["id"][0]))
        elif b.var == a.var:
            found = found.where(F.col("_end") == col(start))
        if path.selector and not x.endpoints_only:
            if b.var not in env and (b.labels or b.props):  # only paths that end where the pattern ends compete
                ends = self.bind_node(Rows(None), NodePattern(b.var, b.labels, b.props))
                found = found.join(ends.df.select(col(ends.env[b.var].cols["id"][0]).alias("_fits")), F.col("_end") == F.col("_fits"), "left_semi")
            found = select_paths(found, keys, x)
        names = {"_end": f"{uid}.end", "_len": f"{uid}.len", "_ids": f"{uid}.ids", "_rels": f"{uid}.rels", "_nodes": f"{uid}.nodes"}
        found = found.drop("_nids").select(*[col(c).alias(names.get(c, c)) for c in found.columns if c != "_nids"])
        if not x.endpoints_only:
            if not forward:
                found = found.withColumns({f"{uid}.rels": F.reverse(f"`{uid}.rels`")} | ({f"{uid}.nodes": F.reverse(f"`{uid}.nodes`")} if x.nodes is not None else {}))
            rel_type = T.ArrayType(RelT(edges.schema["rel"].dataType.fields))
            env[r.var] = Bound("value", {"": (f"{uid}.rels", rel_type), "ids": (f"{uid}.ids", T.ArrayType(LONG))})
            if x.nodes is not None:
                env[r.var].cols["nodes"] = (f"{uid}.nodes", T.ArrayType(NodeT(x.nodes.schema["node"].dataType.fields)))
        rows = Rows(found, env)
        if b.var in env:
            return self.check_node(rows, b)
        return self.join_node(rows, b, f"{uid}.end", None)

    distinct_ends = False

    def chain(self, rows: Rows, path: PathPattern) -> Rows:
        nodes, rels = path.nodes, path.rels

        def worth(i: int) -> tuple:
            n = nodes[i]
            return (n.var in rows.env, any(k for k, e in n.props if e.op in ("lit", "param")), bool(n.props), bool(n.labels), -i)

        at = max(range(len(nodes)), key=worth)
        if nodes[at].var in rows.env:
            rows = self.check_node(rows, nodes[at])
        elif not rels or rels[min(at, len(rels) - 1)].variable:
            rows = self.bind_node(rows, nodes[at])
        for i in range(at, len(rels)):
            rows = self.hop(rows, nodes[i], rels[i], nodes[i + 1], True, path)
        for i in range(at - 1, -1, -1):
            rows = self.hop(rows, nodes[i + 1], rels[i], nodes[i], False, path)
        if path.var:
            rows = self.bind_path(rows, path)
        return rows

    def bind_path(self, rows: Rows, path: PathPattern) -> Rows:
        all_nodes, all_rels = self.graph.node_scan([]).schema, self.graph.rel_scan([]).schema
        node_t, rel_t = NodeT(all_nodes.fields), RelT(all_rels.fields)

        def aligned(b: Bound, t) -> Column:
            parts = [(col(b.cols[k][0]).cast(f.dataType) if (k := (f.name if f.name in b.cols else "." + prop_of(f.name))) in b.cols else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.fields]
            return F.struct(*parts)

        def restruct(c: Column, have: T.DataType, t) -> Column:
            names = set(have.names)
            return F.transform(c, lambda x: F.struct(*[(x[f.name].cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in t.fields]))

        nodes: list[Column] = []
        rels: list[Column] = []
        for i, part in enumerate(path.parts):
            b = rows.env.get(part.var)
            if i % 2 == 0:
                if i == 0 or not path.parts[i - 1].variable:
                    nodes.append(F.array(aligned(b, node_t)))
            elif part.variable:
                rels.append(restruct(col(b.cols[""][0]), b.cols[""][1].elementType, rel_t))
                if "nodes" in b.cols:
                    nodes.append(restruct(col(b.cols["nodes"][0]), b.cols["nodes"][1].elementType, node_t))
                else:
                    nodes.append(F.array(aligned(rows.env[path.parts[i + 1].var], node_t)))
            else:
                rels.append(F.array(aligned(b, rel_t)))
        name = self.uid(path.var)
        value = F.struct((F.concat(*nodes) if len(nodes) > 1 else nodes[0]).alias("nodes"), (F.concat(*rels) if len(rels) > 1 else rels[0] if rels else F.expr(f"cast(array() as array<{T.StructType(rel_t.fields).simpleString()}>)")).alias("rels"))
        t = PathT([T.StructField("nodes", T.ArrayType(node_t)), T.StructField("rels", T.ArrayType(rel_t))])
        return Rows(rows.df.withColumn(name, value), {**rows.env, path.var: Bound("value", {"": (name, t)})})

    def match(self, rows: Rows, patterns: list[PathPattern], where: Expr | None) -> Rows:
        for p in _ordered(patterns, set(rows.env)):
            rows = self.chain(rows, p)
        # Relationships are distinct within the clause; types that cannot meet need no test.
        rels = [(r, p) for p in patterns for r in p.rels if p.mode != "walk"]
        df = rows.df
        for (a, _), (b, _) in combinations(rels, 2):
            if a.var == b.var or (a.types and b.types and not set(a.types) & set(b.types)):
                continue
            x, y = rows.env.get(a.var), rows.env.get(b.var)
            if x is None or y is None:
                continue
            xi, yi = ("ids" if "ids" in x.cols else "id"), ("ids" if "ids" in y.cols else "id")
            if xi == yi == "id":
                df = df.where(col(x.cols["id"][0]) != col(y.cols["id"][0]))
            elif xi == yi == "ids":
                df = df.where(~F.arrays_overlap(col(x.cols["ids"][0]), col(y.cols["ids"][0])))
            elif xi in x.cols and yi in y.cols:
                many, single = (x, y) if xi == "ids" else (y, x)
                df = df.where(~F.array_contains(col(many.cols["ids"][0]), col(single.cols["id"][0])))
        return self.filter(Rows(df, rows.env), where)

    def optional(self, rows: Rows, c: Clause) -> Rows:
        if rows.df is None:
            rows = Rows(self.one(), rows.env)
        plain = Clause("match", {**c.data, "optional": False})
        inner, pairs = self.correlated(rows, [plain])
        fresh = {n: b for n, b in inner.env.items() if n not in rows.env}
        ks = [self.uid("k") for _ in pairs]
        kept = {x for b in fresh.values() for x in b.columns}
        side = inner.df.select(*[col(i).alias(k) for (_, i), k in zip(pairs, ks, strict=True)], *[col(x) for x in inner.df.columns if x in kept])
        return Rows(self.left_join(rows.df, side, pairs, ks), {**rows.env, **fresh})

    # Other clauses.

    def unwind(self, rows: Rows, c: Clause) -> Rows:
        rows, comp = self.prepared(rows, c.data["list"])
        v = comp(c.data["list"])
        df = rows.df if rows.df is not None else self.one()
        name = self.uid(c.data["var"])
        if kind(v.type) == "null" or (kind(v.type) == "list" and kind(v.type.elementType) == "null"):
            n = F.size(v.col) if kind(v.type) == "list" else F.lit(0)
            df = df.select("*", F.explode(F.when(n > 0, F.array_repeat(F.lit(None).cast("string"), n))).alias(name))
            return Rows(df, {**rows.env, c.data["var"]: Bound("value", {"": (name, STRING if kind(v.type) != "list" else T.NullType())})})
        if kind(v.type) != "list":
            v = Value(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))
        return Rows(df.select("*", F.explode(v.col).alias(name)), {**rows.env, c.data["var"]: Bound("value", {"": (name, v.type.elementType)})})

    def let(self, rows: Rows, c: Clause) -> Rows:
        for var, e in c.data["items"]:
            if var in rows.env:
                raise QueryError(f"{var} is already bound")
            rows, comp = self.prepared(rows, e)
            rows = self.with_value(rows, var, comp(e))
        return rows

    def with_value(self, rows: Rows, var: str, v: Value) -> Rows:
        name = self.uid(var)
        df = rows.df if rows.df is not None else self.one()
        return Rows(df.withColumn(name, v.col), {**rows.env, var: Bound("value", {"": (name, v.type)})})

    def count_of(self, e: Expr, of: str) -> int:
        v = Compiler({}, self.params)(e)
        n = getattr(v, "literal", None)
        if not isinstance(n, int) or isinstance(n, bool):
            n = self.graph.spark.range(1).select(v.col).first()[0]
        if not isinstance(n, int) or n < 0:
            raise QueryError(f"{of} takes an integer of 0 or more")
        return n

    def project(self, rows: Rows, p: Projection, keep: list[str] = ()) -> Rows:
        items = ([(n, Expr("var", (n,), n)) for n in rows.env if not n.startswith(" ")] if p.star else []) + [(i.name, i.expr) for i in p.items]
        names = [n for n, _ in items]
        if len(set(names)) < len(names):
            raise QueryError("two columns have one name")
        items = [(n, Expr("var", (n,), n)) for n in keep] + items
        if any(has_aggregate(e) for _, e in items):
            rows = self.aggregate(rows, items, p)
            if p.where is not None:
                rows = self.filter(rows, p.where)
        else:
            rows = self.select(rows, items, p)
        df = rows.df
        if p.skip is not None:
            df = df.offset(self.count_of(p.skip, "SKIP"))
        if p.limit is not None:
            df = df.limit(self.count_of(p.limit, "LIMIT"))
        return Rows(df, rows.env)

    def select(self, rows: Rows, items, p: Projection) -> Rows:
        exprs = [e for _, e in items]
        before = rows
        rows, comp = self.prepared(rows, *exprs)
        df = rows.df if rows.df is not None else self.one()
        env: dict[str, Bound] = {}
        for n, e in items:
            if e.op == "var" and e.args[0] in rows.env:
                env[n] = rows.env[e.args[0]]
            else:
                v, name = comp(e), self.uid(n)
                df = df.withColumn(name, v.col)
                env[n] = Bound("value", {"": (name, v.type)})
        merged = Rows(df, {**before.env, **env})
        if p.where is not None:
            merged = self.filter(merged, p.where)
        columns = list(dict.fromkeys(c for b in env.values() for c in b.columns))
        if p.distinct:
            merged = Rows(merged.df.select(*map(col, columns)).distinct(), env)
        if p.order:
            merged = self.sorted(merged, p.order, {e.text: n for n, e in items if e.text})
        return Rows(merged.df.select(*map(col, columns)), env)

    def sorted(self, rows: Rows, order, known: dict[str, str]) -> Rows:
        rows, comp = self.prepared(rows, *[e for e, _ in order])
        keys = []
        for e, down in order:
            v = rows.env[known[e.text]].ref().value() if e.text in known and known[e.text] in rows.env and e.op != "var" else comp(e)
            key = order_key(v)
            keys.append(key.desc_nulls_first() if down else key.asc_nulls_last())
        return Rows(rows.df.orderBy(*keys), rows.env)

    def aggregate(self, rows: Rows, items, p: Projection) -> Rows:
        rows, comp = self.prepared(rows, *[e for _, e in items if not has_aggregate(e)], *[a for _, e in items if has_aggregate(e) for a in _aggregate_args(e)])
        df = rows.df if rows.df is not None else self.one()
        env: dict[str, Bound] = {}
        keys: dict[str, str] = {}
        groups: list[str] = []
        for n, e in items:
            if has_aggregate(e):
                continue
            if e.op == "var" and e.args[0] in rows.env:
                env[n] = rows.env[e.args[0]]
            else:
                v, name = comp(e), self.uid(n)
                df = df.withColumn(name, v.col)
                env[n] = Bound("value", {"": (name, v.type)})
            groups += env[n].columns
            keys[_key(e)] = n
        aggs: dict[str, tuple[str, T.DataType]] = {}
        calls: list[Column] = []
        sort_exprs = [e for e, _ in p.order if has_aggregate(e)]
        for e in [e for _, e in items] + sort_exprs:
            for a in _aggregates(e):
                if _key(a) not in aggs:
                    df, c, t = self.one_aggregate(df, comp, a)
                    name = self.uid("agg")
                    aggs[_key(a)] = (name, t)
                    calls.append(c.alias(name))
        groups = list(dict.fromkeys(groups))
        out = df.groupBy(*map(col, groups)).agg(*calls) if groups else df.agg(*calls)
        done = Rows(out, dict(env))

        def hook(e: Expr) -> Value | None:
            k = _key(e)
            if k in aggs:
                return Value(col(aggs[k][0]), aggs[k][1])
            if k in keys:
                return done.env[keys[k]].ref().value()
            return None

        after = Compiler({n: b.ref() for n, b in env.items()}, self.params, hook)
        final: dict[str, Bound] = {}
        for n, e in items:
            if n in env:
                final[n] = env[n]
                continue
            v, name = after(e), self.uid(n)
            out = out.withColumn(name, v.col)
            final[n] = Bound("value", {"": (name, v.type)})
        columns = list(dict.fromkeys(c for b in final.values() for c in b.columns))
        if p.distinct:
            out = out.select(*map(col, columns)).distinct()
        if p.order:
            ready = Compiler({n: b.ref() for n, b in {**env, **final}.items()}, self.params, hook)
            by = {_key(e): n for n, e in items}
            sort = []
            for e, down in p.order:
                v = final[by[_key(e)]].ref().value() if _key(e) in by else ready(e)
                sort.append(order_key(v).desc_nulls_first() if down else order_key(v).asc_nulls_last())
            out = out.orderBy(*sort)
        return Rows(out.select(*map(col, columns)), final)

    def one_aggregate(self, df: DataFrame, comp: Compiler, e: Expr) -> tuple[DataFrame, Column, T.DataType]:
        name, args, how = e.args
        if how == "star":
            if name != "count":
                raise QueryError(f"{name}(*) is no aggregate")
            return df, F.count(F.lit(1)), LONG
        wanted = 2 if name.startswith("percentile") else 1
        if len(args) != wanted:
            raise QueryError(f"{name} takes {wanted} arguments")
        for a in args:
            if has_aggregate(a):
                raise QueryError("aggregates cannot be nested")
            if any(x.op == "call" and x.args[0] == "rand" for x in a.walk()):
                raise QueryError("rand() is not allowed in an aggregate")
        if name == "count" and args[0].op == "var" and comp.name(args[0].args[0]).kind in ("node", "rel"):
            v = comp.name(args[0].args[0]).prop(" id")
        else:
            v = comp(args[0])
        distinct = how == "distinct"
        k, c = kind(v.type), self.uid("arg")
        df = df.withColumn(c, v.col)
        x, d = col(c), "DISTINCT " if distinct else ""
        if name == "count":
            return df, F.expr(f"count({d}`{c}`)"), LONG
        if name == "collect":
            # In the order that the rows come in: a sort or a list before stays in force.
            at = self.uid("at")
            df = df.withColumn(at, F.monotonically_increasing_id())
            rows = F.collect_list(F.when(x.isNotNull(), F.struct(col(at).alias("at"), x.alias("x"))))
            got = F.transform(F.array_sort(rows, lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1)), lambda r: r["x"])
            return df, F.array_distinct(got) if distinct else got, T.ArrayType(v.type)
        if name in ("min", "max"):
            if k in ("date", "number", "string", "boolean", "localdatetime", "null"):
                return df, F.expr(f"{name}(`{c}`)"), v.type
            return df, (F.min_by if name == "min" else F.max_by)(x, order_key(Value(x, v.type))), v.type
        if k not in ("number", "null"):
            raise QueryError(f"{name} takes numbers, not {k}")
        if name == "sum":
            whole = is_int(v.type) or k == "null"
            got = F.expr(f"sum({d}CAST(`{c}` AS {'BIGINT' if whole else 'DOUBLE'}))")
            return df, F.coalesce(got, F.lit(0).cast("long") if whole else F.lit(0.0)), LONG if whole else DOUBLE
        if name.startswith("percentile"):
            q = comp(args[1])
            at = getattr(q, "literal", None)
            if isinstance(at, bool) or not isinstance(at, (int, float)):
                raise QueryError(f"{name} takes a literal percentile")
            if not 0 <= at <= 1:
                raise QueryError("NumberOutOfRange: a percentile lies between 0 and 1")
            if name == "percentilecont":
                return df, F.expr(f"percentile_cont({float(at)}D) WITHIN GROUP (ORDER BY `{c}`)"), DOUBLE
            return df, F.expr(f"percentile_disc({float(at)}D) WITHIN GROUP (ORDER BY `{c}`)").cast(v.type), v.type
        fn = {"avg": "avg", "stdev": "stddev_samp", "stdevp": "stddev_pop", "variance": "var_samp", "variancep": "var_pop"}[name]
        return df, F.expr(f"{fn}({d}CAST(`{c}` AS DOUBLE))"), DOUBLE

    # Queries.

    def final(self, rows: Rows) -> DataFrame:
        """The columns of RETURN, entities as structs."""
        if rows.df is None:
            return self.one()
        out = []
        for n, b in rows.env.items():
            if not n.startswith(" "):
                v = b.ref().value()
                out.append(v.col.alias(n))
        return rows.df.select(*out)

    def run(self, clauses: list[Clause]) -> tuple[DataFrame, bool]:
        self.used = uses(clauses)
        rows, returned = Rows(None), False
        for i, c in enumerate(clauses):
            if returned:
                raise QueryError("RETURN must be the last clause")
            self.distinct_ends = _distinct_ends(clauses, i)
            k = c.kind
            if k == "match":
                rows = self.optional(rows, c) if c.data["optional"] else self.match(rows, c.data["patterns"], c.data["where"])
            elif k == "filter":
                rows = self.filter(rows, c.data["where"])
            elif k in ("unwind", "let"):
                rows = getattr(self, k)(rows, c)
            elif k in ("with", "return"):
                rows, returned = self.project(rows, c.data["projection"]), k == "return"
            elif k == "finish":
                return self.one().limit(0), True
            elif k == "call":
                from ..operators.procedures import call

                rows, returned = call(self, rows, c, standalone=len(clauses) == 1)
            elif k == "search":
                from ..operators.search import search

                rows = search(self, rows, c)
            elif k in ("history", "window"):
                from ..operators import temporal

                rows = getattr(temporal, k)(self, rows, c)
            else:
                from ..operators import writes

                rows = getattr(writes, k)(self, rows, c)
        return (self.final(rows) if returned else self.one().limit(0)), returned


def uses(clauses: list[Clause]) -> set[str]:
    """Names of which somebody asks for more than the identity."""
    out: set[str] = set()

    def walk(e) -> None:
        if isinstance(e, (list, tuple)):
            for x in e:
                walk(x)
        elif isinstance(e, PathPattern):
            for part in e.parts:
                walk([x for _, x in part.props])
        elif isinstance(e, Clause):
            out.update(uses([e]))
        elif isinstance(e, Expr):
            if e.op == "call" and e.args[0] in ("id", "count") and len(e.args[1]) == 1 and e.args[1][0].op == "var":
                return
            if e.op == "call" and e.args[0] == "length" and len(e.args[1]) == 1 and e.args[1][0].op == "var":
                return
            if e.op == "var":
                out.add(e.args[0])
            for a in e.args:
                walk(a)

    for c in clauses:
        for e in _expressions(c):
            walk(e)
        p = c.data.get("projection")
        if p is not None:
            for i in p.items:
                if not (c.kind == "with" and i.expr.op == "var" and i.expr.args[0] == i.name):
                    walk(i.expr)
            if p.star and c.kind == "return":
                for d in clauses:
                    out |= {x.var for q in d.data.get("patterns", ()) for x in q.parts if x.named} | {q.var for q in d.data.get("patterns", ()) if q.var}
        for q in c.data.get("patterns", ()):
            walk(q)
        if c.kind in ("set", "remove", "delete", "merge", "create", "search", "history", "call"):
            out |= {x[1] for x in c.data.get("items", ())} | set(c.data.get("vars", ())) | ({c.data["var"]} if "var" in c.data else set())
    return out


def _expressions(c: Clause):
    for key in ("where", "list", "from", "to", "on", "width", "every", "align", "zone", "input", "vector", "limit"):
        e = c.data.get(key)
        if isinstance(e, Expr):
            yield e
    for e in c.data.get("args") or ():
        yield e
    if c.kind == "let":
        for _, e in c.data["items"]:
            yield e
    if c.kind in ("set",):
        for item in c.data["items"]:
            for e in item:
                if isinstance(e, Expr):
                    yield e
    if c.kind == "merge":
        for items in c.data["on"].values():
            for item in items:
                for e in item:
                    if isinstance(e, Expr):
                        yield e
    p = c.data.get("projection")
    if p is not None:
        for e, _ in p.order:
            yield e
        if p.where is not None:
            yield p.where


def has_aggregate(e: Expr) -> bool:
    return next(_aggregates(e), None) is not None


def _aggregates(e: Expr):
    if e.op == "call" and e.args[0] in AGGREGATES:
        yield e
        return
    if e.op in ("exists", "pattern", "pattern_comprehension"):
        return
    for a in e.args:
        for x in a if isinstance(a, (list, tuple)) else (a,):
            for y in x if isinstance(x, (list, tuple)) else (x,):
                if isinstance(y, Expr):
                    yield from _aggregates(y)


def _aggregate_args(e: Expr):
    for a in _aggregates(e):
        yield from a.args[1]


def _key(e) -> str:
    """Equal for equal trees, whatever their source text."""
    if isinstance(e, Expr):
        return f"{e.op}({','.join(_key(a) for a in e.args)})"
    if isinstance(e, (list, tuple)):
        return f"[{','.join(_key(x) for x in e)}]"
    return repr(e)


def _ordered(patterns: list[PathPattern], bound: set[str]) -> list[PathPattern]:
    """Patterns so that each shares a name with what is there, if any does."""
    left, out = list(patterns), []
    while left:
        nxt = next((p for p in left if {x.var for x in p.parts} & bound), left[0])
        left.remove(nxt)
        out.append(nxt)
        bound |= {x.var for x in nxt.parts}
    return out


def _distinct_ends(clauses: list[Clause], i: int) -> bool:
    """Whether the clause after next only asks which rows there are, not how many."""
    later = next((c for c in clauses[i + 1 :] if c.kind in ("with", "return")), None)
    if later is None or any(c.kind not in ("filter", "with", "return") for c in clauses[i + 1 : clauses.index(later) + 1]):
        return False
    p = later.data["projection"]
    aggs = [a for item in p.items for a in _aggregates(item.expr)]
    if aggs:
        return all(a.args[2] == "distinct" or a.args[0] in ("min", "max") for a in aggs)
    return p.distinct


def run(graph: Graph, text: str, params: dict) -> Result:
    """Parse and compile a query over a graph."""
    q: Query = parse(text)
    if q.read_layers:
        names = {x for n in q.read_layers for x in (LAYERS if n == "ALL" else [n])}
        if names - set(LAYERS):
            raise QueryError(f"unknown layer {sorted(names - set(LAYERS))[0]}")
        graph = graph.with_(layers=tuple(sorted(LAYERS[n] for n in names)))
    write = LAYERS[q.write_layer] if q.write_layer else 0
    if write not in graph.layers and any(c.kind in ("create", "merge", "set", "remove", "delete") for b in q.branches for c in b):
        raise QueryError("the layer that is written must be read")
    frames, stats = [], {}
    for branch in q.branches:
        ctx = Context(graph, params, q.at_time, write)
        rows, returned = ctx.run(branch)
        if len(q.branches) > 1 and not returned:
            raise QueryError("a branch of UNION needs RETURN")
        frames.append(rows)
        graph, stats = ctx.graph, {k: stats.get(k, 0) + ctx.stats.get(k, 0) for k in {*stats, *ctx.stats}}
    out = frames[0]
    for f in frames[1:]:
        if f.columns != out.columns:
            raise QueryError("the branches of UNION have different columns")
        both = [common([a.dataType, b.dataType]) for a, b in zip(out.schema.fields, f.schema.fields, strict=True)]
        cast = lambda df: df.select(*[to(Value(df[f"`{n}`"], df.schema[n].dataType), t).alias(n) for n, t in zip(df.columns, both, strict=True)])  # noqa: B023, E731
        out = cast(out).unionAll(cast(f))
    if len(frames) > 1 and not q.union_all:
        out = out.distinct()
    return Result(out, graph, stats)
