"""CREATE, MERGE, SET, REMOVE, DELETE: each gives a new snapshot of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import temporal as TF
from ..functions.scalar import properties
from ..lineage import stored
from ..model import KNOWLEDGE, NodeTable, RelTable, column_of
from ..plans.tree import Clause, Expr, NodePattern, PathPattern, QueryError
from ..plans.values import LONG, kind, to


def _next_id(ctx, what: str) -> int:
    tables = ctx.graph.nodes if what == "node" else ctx.graph.rels
    best = 0
    for t in tables:
        best = max(best, t.df.agg(F.max("id")).first()[0] or 0)
    return best + 1


def _kept(rows):
    """rows, computed once: whatever they came from may change with the graph."""
    from ..plans.compiler import Rows

    return Rows(stored(rows.df) if rows.df is not None else None, rows.env)


def _count(ctx, name: str, n: int) -> None:
    ctx.stats[name] = ctx.stats.get(name, 0) + n


def create(ctx, rows, c: Clause):
    from ..plans.compiler import Rows

    rows = Rows(rows.df if rows.df is not None else ctx.one(), rows.env)
    for p in c.data["patterns"]:
        rows = create_path(ctx, rows, p)
    return rows


def create_path(ctx, rows, p: PathPattern):
    from ..plans.compiler import Bound, Rows, col

    for n in p.nodes:
        if n.var in rows.env:
            if n.labels or n.props:
                raise QueryError(f"{n.var} is already bound")
            continue
        rows, comp = ctx.prepared(rows, *[e for _, e in n.props])
        values = [(k, comp(e)) for k, e in n.props]
        if ctx.write_layer == KNOWLEDGE and not any(k == "name" and kind(v.type) == "string" for k, v in values):
            raise QueryError("a node of KNOWLEDGE needs a name")
        uid = ctx.uid(n.var)
        held = [(k, v) for k, v in values if kind(v.type) != "null"]
        df = rows.df.withColumns({f"{uid}.id": F.monotonically_increasing_id() + _next_id(ctx, "node"), f"{uid}.revision": F.lit(1).cast("long")} | {f"{uid}.p.{k}": v.col for k, v in held})
        df = stored(df)
        new = df.select(col(f"{uid}.id").alias("id"), F.lit(ctx.write_layer).cast("tinyint").alias("layer"), *[col(f"{uid}.p.{k}").alias(column_of(k)) for k, _ in held])
        ctx.graph = ctx.graph.with_(nodes=(*ctx.graph.nodes, NodeTable(frozenset(n.labels), new)))
        cols = {"id": (f"{uid}.id", LONG), "labels": (f"{uid}.labels", T.ArrayType(T.StringType())), "revision": (f"{uid}.revision", LONG)} | {f".{k}": (f"{uid}.p.{k}", v.type) for k, v in held}
        df = df.withColumn(f"{uid}.labels", F.array(*[F.lit(x) for x in sorted(n.labels)]).cast("array<string>"))
        rows = Rows(df, {**rows.env, n.var: Bound("node", cols, frozenset(n.labels))})
        made = new.count()
        _count(ctx, "nodes_created", made)
        _count(ctx, "labels_added", made * len(n.labels))
        _count(ctx, "properties_set", made * len(held))
    for i, r in enumerate(p.rels):
        if r.variable or len(r.types) != 1 or r.direction == "both":
            raise QueryError("a new relationship has one type and one direction")
        a, b = (p.nodes[i], p.nodes[i + 1]) if r.direction == "out" else (p.nodes[i + 1], p.nodes[i])
        rows, comp = ctx.prepared(rows, *[e for _, e in r.props])
        held = [(k, v) for k, e in r.props if kind((v := comp(e)).type) != "null"]
        uid = ctx.uid(r.var)
        src, dst = (rows.env[n.var].cols["id"][0] for n in (a, b))
        df = stored(rows.df.withColumns({f"{uid}.id": F.monotonically_increasing_id() + _next_id(ctx, "rel"), f"{uid}.src": col(src), f"{uid}.dst": col(dst)} | {f"{uid}.p.{k}": v.col for k, v in held}))
        new = df.select(*[col(f"{uid}.{k}").alias(k) for k in ("id", "src", "dst")], F.lit(ctx.write_layer).cast("tinyint").alias("layer"), *[col(f"{uid}.p.{k}").alias(column_of(k)) for k, _ in held])
        ctx.graph = ctx.graph.with_(rels=(*ctx.graph.rels, RelTable(r.types[0], new)))
        cols = {k: (f"{uid}.{k}", LONG) for k in ("id", "src", "dst")} | {"type": (f"{uid}.type", T.StringType()), "revision": (f"{uid}.revision", LONG)} | {f".{k}": (f"{uid}.p.{k}", v.type) for k, v in held}
        df = df.withColumns({f"{uid}.type": F.lit(r.types[0]), f"{uid}.revision": F.lit(1).cast("long")})
        rows = Rows(df, {**rows.env, r.var: Bound("rel", cols, frozenset(r.types))})
        made = new.count()
        _count(ctx, "relationships_created", made)
        _count(ctx, "properties_set", made * len(held))
    return ctx.bind_path(rows, p) if p.var else rows


def merge(ctx, rows, c: Clause):
    """Match the whole pattern, or create it, once for each distinct set of values it is asked for."""
    from ..plans.compiler import Rows, col

    p: PathPattern = c.data["pattern"]
    rows = Rows(rows.df if rows.df is not None else ctx.one(), rows.env)
    names: dict[str, Expr] = {}
    parts = []
    for x in p.parts:  # property values become columns, so that both ways see the same
        props = []
        for k, e in x.props:
            rows, comp = ctx.prepared(rows, e)
            v = comp(e)
            if kind(v.type) == "null":
                raise QueryError("MERGE takes no null property")
            name = f" merge {len(names)}"
            names[name] = e
            rows = ctx.with_value(rows, name, v)
            props.append((k, Expr("var", (name,), name)))
        parts.append(type(x)(x.var, x.labels, props, x.named) if isinstance(x, NodePattern) else type(x)(x.var, x.types, props, "out" if x.direction == "both" else x.direction, x.lo, x.hi, x.named))
    rows = _kept(rows)
    pattern = PathPattern(parts, p.var)
    fresh = [x.var for x in pattern.parts if x.var not in rows.env]
    used, ctx.used = ctx.used, ctx.used | {x.var for x in pattern.parts}
    keys = [cname for n in {*names, *(x.var for x in pattern.parts if x.var in rows.env)} for cname in rows.env[n].columns]
    seed = Rows(rows.df.select(*map(col, keys)).distinct() if keys else ctx.one(), {n: b for n, b in rows.env.items() if all(cc in keys for cc in b.columns)})
    found = ctx.match(seed, [pattern], None)
    if keys:
        ks = [ctx.uid("k") for _ in keys]
        have = found.df.select(*[col(k).alias(a) for k, a in zip(keys, ks, strict=True)])
        on = F.lit(True)
        for k, a in zip(keys, ks, strict=True):
            on = on & col(k).eqNullSafe(col(a))
        missing = stored(seed.df.join(have, on, "left_anti"))
    else:
        missing = ctx.one() if found.df.isEmpty() else ctx.one().limit(0)
    before = {x: _next_id(ctx, x) for x in ("node", "rel")}
    if not missing.isEmpty():
        create_path(ctx, Rows(missing, seed.env), PathPattern(parts))
    rows = _kept(ctx.match(rows, [pattern], None))
    mark = next((x for x in fresh), None)
    for which, items in c.data["on"].items():
        if items and mark is not None:
            b = rows.env[mark]
            new = col(b.cols["id"][0]) >= before["node" if b.kind == "node" else "rel"]
            part = Rows(rows.df.where(new if which == "create" else ~new), rows.env)
            set(ctx, part, Clause("set", {"items": items}))
    ctx.used = used
    for n in names:
        rows.env.pop(n, None)
    if any(c.data["on"].values()):  # read what was set
        base = {n: b for n, b in rows.env.items() if n not in fresh}
        for x in pattern.parts:
            if x.var in fresh and x in pattern.nodes:
                again = ctx.join_node(Rows(rows.df, base), NodePattern(x.var, x.labels), rows.env[x.var].cols["id"][0], None)
                rows = Rows(again.df, {**rows.env, x.var: again.env[x.var]})
    return rows


def _update(ctx, what: str, known, change) -> None:
    """Replace each table that may hold the entities by what ``change`` makes of it."""
    if what == "node":
        ctx.graph = ctx.graph.with_(nodes=tuple(change(t) if t.dynamic or not known or known & t.labels or known == frozenset() else t for t in ctx.graph.nodes))
    else:
        ctx.graph = ctx.graph.with_(rels=tuple(change(t) if not known or t.type in known else t for t in ctx.graph.rels))


def _with(t, df: DataFrame, labels=None):
    return NodeTable(t.labels if labels is None else labels, df) if isinstance(t, NodeTable) else RelTable(t.type, df, t.ends)


def _put(t, updates: DataFrame, prop: str, type_: T.DataType):
    """The table with new values (id, new) of a property's column where there are any."""
    df = t.df.join(updates.select(F.col("id").alias("_u"), F.col("new").alias("_new")), F.col("id") == F.col("_u"), "left")
    hit = F.col("_u").isNotNull()
    if prop in t.df.columns:
        old = t.df.schema[prop].dataType
        both = type_ if isinstance(old, T.NullType) else old if isinstance(type_, T.NullType) or old == type_ else T.DoubleType() if {type(old), type(type_)} == {T.LongType, T.DoubleType} else None
        if both is None:
            raise QueryError(f"{prop} holds {old.simpleString()} and gets {type_.simpleString()}")
        df = df.withColumn(prop, F.when(hit, F.col("_new").cast(both)).otherwise(F.col(f"`{prop}`").cast(both)))
    elif not isinstance(type_, T.NullType):
        df = df.withColumn(prop, F.when(hit, F.col("_new")))
    revision = F.coalesce(F.col("revision"), F.lit(1)) if "revision" in t.df.columns else F.lit(1)
    df = df.withColumn("revision", (revision + F.when(hit, 1).otherwise(0)).cast("long"))
    return _with(t, df.drop("_u", "_new"))


def set(ctx, rows, c: Clause):  # noqa: A001
    from ..plans.compiler import Bound, Rows, col

    rows = _kept(rows)
    for item in c.data["items"]:
        what, var = item[0], item[1]
        b = rows.env.get(var)
        if b is None or b.kind not in ("node", "rel"):
            raise QueryError(f"SET takes a bound entity, not {var}")
        key = col(b.cols["id"][0])
        if what == "label":
            ids = stored(rows.df.select(key.alias("_u")).where("_u is not null").distinct())

            def labelled(t, ids=ids, label=item[2]):
                df = t.df.join(ids, F.col("id") == F.col("_u"), "left")
                own = F.coalesce(F.col("labels"), F.array().cast("array<string>")) if t.dynamic else F.array().cast("array<string>")
                return _with(t, df.withColumn("labels", F.when(F.col("_u").isNotNull(), F.array_union(own, F.array(F.lit(label)))).otherwise(own)).drop("_u"))

            _update(ctx, "node", frozenset(), labelled)
            _count(ctx, "labels_added", ids.count())
            continue
        rows, comp = ctx.prepared(rows, item[3] if what == "prop" else item[2])
        if what == "prop":
            changes = [(item[2], comp(item[3]))]
        else:
            given = properties(comp(item[2]))
            changes = [] if kind(given.type) == "null" else [(f.name, type("V", (), {"col": given.col[f.name], "type": f.dataType})) for f in given.type.fields]
            if what == "replace":
                named = {k for k, _ in changes}
                changes += [(k[1:], type("V", (), {"col": F.lit(None), "type": T.NullType()})) for k in b.cols if k.startswith(".") and k[1:] not in named]
        for prop, v in changes:
            updates = rows.df.select(key.alias("id"), v.col.alias("new")).where("id is not null").groupBy("id").agg(F.last("new").alias("new"))
            updates = stored(updates.withColumn("new", F.col("new").cast("string")) if kind(v.type) == "null" else updates)
            if what == "prop" and item[4] is not None:
                _sample(ctx, rows, b, prop, v, comp(item[4]))
                continue
            _update(ctx, b.kind, b.known, lambda t, u=updates, p=column_of(prop), ty=v.type: _put(t, u, p, ty))
            _count(ctx, "properties_set", updates.count())
            name = ctx.uid(f"{var}.{prop}")
            shown = rows.df.withColumn(name, to(v, v.type) if kind(v.type) != "null" else F.lit(None).cast("string"))
            rows = Rows(shown, {**rows.env, var: Bound(b.kind, {**b.cols, f".{prop}": (name, shown.schema[name].dataType)}, b.known, b.full)})
            b = rows.env[var]
    return rows


def _sample(ctx, rows, b, prop: str, v, at) -> None:
    from ..plans.compiler import col
    from .temporal import append

    found = next((k for k in ctx.graph.samples if k[0] == b.kind and k[2] == prop and (not b.known or k[1] in b.known)), None)
    if found is None:
        raise QueryError(f"{prop} is not declared temporal")
    new = stored(rows.df.select(col(b.cols["id"][0]).alias("entity"), TF.epoch_nanos(at).alias("time"), v.col.alias("value")))
    ctx.graph = ctx.graph.with_(samples={**ctx.graph.samples, found: append(ctx.graph.samples[found], new)})
    _count(ctx, "properties_set", new.count())


def remove(ctx, rows, c: Clause):
    from ..plans.compiler import col

    rows = _kept(rows)
    for what, var, name in c.data["items"]:
        if what == "prop":
            rows = set(ctx, rows, Clause("set", {"items": [("prop", var, name, Expr("lit", (None,), "null"), None)]}))
            continue
        b = rows.env[var]
        ids = stored(rows.df.select(col(b.cols["id"][0]).alias("_u")).where("_u is not null").distinct())

        def stripped(t, ids=ids, label=name):
            if label not in t.labels and not t.dynamic:
                return t
            df = t.df.join(ids, F.col("id") == F.col("_u"), "left")
            own = F.coalesce(F.col("labels"), F.array().cast("array<string>")) if t.dynamic else F.array().cast("array<string>")
            if label in t.labels:
                own = F.array_union(own, F.array(F.lit(label)))
            df = df.withColumn("labels", F.when(F.col("_u").isNotNull(), F.array_remove(own, label)).otherwise(own)).drop("_u")
            return NodeTable(t.labels - {label}, df)

        _update(ctx, "node", frozenset(), stripped)
        _count(ctx, "labels_removed", ids.count())
    return rows


def delete(ctx, rows, c: Clause):
    from ..plans.compiler import col

    rows = _kept(rows)
    for var in c.data["vars"]:
        b = rows.env.get(var)
        if b is None or b.kind not in ("node", "rel"):
            raise QueryError(f"DELETE takes a bound entity, not {var}")
        ids = stored(rows.df.select(col(b.cols["id"][0]).alias("_u")).where("_u is not null").distinct())
        gone = lambda df, key: df.join(ids, F.col(key) == F.col("_u"), "left_anti")  # noqa: B023, E731
        if b.kind == "rel":
            before = sum(t.df.count() for t in ctx.graph.rels)
            _update(ctx, "rel", b.known, lambda t: _with(t, gone(t.df, "id")))
            _count(ctx, "relationships_deleted", before - sum(t.df.count() for t in ctx.graph.rels))
            continue
        touching = sum(t.df.join(ids, (F.col("src") == F.col("_u")) | (F.col("dst") == F.col("_u")), "left_semi").count() for t in ctx.graph.rels)
        if touching and not c.data["detach"]:
            deleted = [rows.env[v] for v in c.data["vars"] if rows.env.get(v) is not None and rows.env[v].kind == "rel"]
            if not deleted:
                raise QueryError("ConstraintViolation: a node that is deleted has relationships; use DETACH DELETE")
        if touching:
            ctx.graph = ctx.graph.with_(rels=tuple(_with(t, gone(gone(t.df, "src"), "dst")) for t in ctx.graph.rels))
            _count(ctx, "relationships_deleted", touching)
        _update(ctx, "node", frozenset(), lambda t: _with(t, gone(t.df, "id")))
        _count(ctx, "nodes_deleted", ids.count())
    return rows


__all__ = ["create", "merge", "set", "remove", "delete"]
