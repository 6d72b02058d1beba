"""Typed values: a column with the type that the compiler knows for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tree import QueryError

LONG, DOUBLE, STRING, BOOL, DATE, LDT, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.NullType()
LTIME = T.StructType([T.StructField("day_nanos", T.LongType())])
ZTIME = T.StructType([T.StructField("day_nanos", T.LongType()), T.StructField("offset", T.IntegerType())])
ZDT = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("zone", T.StringType())])
DURATION = T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "seconds", "nanos")])
TEMPORAL = {"date": DATE, "localdatetime": LDT, "localtime": LTIME, "time": ZTIME, "datetime": ZDT}


class NodeT(T.StructType):
    """A node as a struct: id, labels, revision, properties."""


class RelT(T.StructType):
    """A relationship as a struct: id, src, dst, type, revision, properties."""


class PathT(T.StructType):
    """A path: nodes, rels."""


@dataclass
class Value:
    col: Column
    type: T.DataType


def shape(t: T.DataType) -> list[tuple[str, str]] | None:
    return [(f.name, f.dataType.simpleString()) for f in t.fields] if isinstance(t, T.StructType) else None


def is_type(t: T.DataType, other: T.DataType) -> bool:
    if isinstance(other, T.StructType):
        return isinstance(t, T.StructType) and not isinstance(t, (NodeT, RelT, PathT)) and shape(t) == shape(other)
    return type(t) is type(other)


def kind(t: T.DataType) -> str:
    """The family of a type: number, string, boolean, date, ..., list, map, node, relationship, path, null."""
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)):
        return "number"
    for cls, name in ((T.StringType, "string"), (T.BooleanType, "boolean"), (T.DateType, "date"), (T.TimestampNTZType, "localdatetime"), (T.NullType, "null"), (T.ArrayType, "list"), (NodeT, "node"), (RelT, "relationship"), (PathT, "path"), (T.MapType, "map"), (T.BinaryType, "bytes"), (T.TimestampType, "instant")):
        if isinstance(t, cls):
            return name
    for name, other in (("localtime", LTIME), ("time", ZTIME), ("datetime", ZDT), ("duration", DURATION)):
        if is_type(t, other):
            return name
    return "map"


def is_int(t: T.DataType) -> bool:
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def common(types: list[T.DataType]) -> T.DataType:
    """The type that all of these can have, null aside."""
    out: T.DataType = NULL
    for t in types:
        if isinstance(t, T.NullType) or (type(out) is type(t) and out == t):
            continue
        if isinstance(out, T.NullType):
            out = t
        elif kind(out) == kind(t) == "number":
            out = DOUBLE if not (is_int(out) and is_int(t)) else LONG
        elif kind(out) == kind(t) == "list":
            out = T.ArrayType(common([out.elementType, t.elementType]))
        elif kind(out) == kind(t) == "map" and [f.name for f in out.fields] == [f.name for f in t.fields]:
            out = T.StructType([T.StructField(a.name, common([a.dataType, b.dataType])) for a, b in zip(out.fields, t.fields, strict=True)])
        elif kind(out) != kind(t):
            raise QueryError(f"values of {kind(out)} and {kind(t)} cannot be mixed in one column")
    return out


def to(v: Value, t: T.DataType) -> Column:
    """The column as type t (a null may become any type)."""
    if isinstance(t, T.NullType) or v.type == t:
        return v.col
    return v.col.cast(T.StructType(t.fields) if isinstance(t, (NodeT, RelT, PathT)) else t)


def null(t: T.DataType = NULL) -> Value:
    return Value(F.lit(None) if isinstance(t, T.NullType) else F.lit(None).cast(t), t)


# Truth values.


def equal(a: Value, b: Value) -> Column:
    """a = b: unknown if either is null or a part of them is; false for different families; NaN equals nothing."""
    ka, kb = kind(a.type), kind(b.type)
    if "null" in (ka, kb):
        return F.lit(None).cast("boolean")
    known = F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if ka != kb:
        return known
    if ka == "number":
        if is_int(a.type) and is_int(b.type):
            return a.col == b.col
        x, y = a.col.cast("double"), b.col.cast("double")
        if is_int(a.type) != is_int(b.type):  # exact: the integer must be the double's own value
            i, d = (a.col, y) if is_int(a.type) else (b.col, x)
            safe = F.when(F.abs(d) < 9.2e18, d).otherwise(F.lit(None).cast("double"))
            return F.when(F.isnan(d) | (F.abs(d) >= 9.2e18), known).otherwise((i.cast("double") == d) & (i == safe.cast("long")))
        return (x == y) & ~F.isnan(x) & ~F.isnan(y)
    if ka in ("node", "relationship"):
        return a.col["id"] == b.col["id"]
    if ka == "list":
        pairs = F.zip_with(a.col, b.col, lambda x, y: equal(Value(x, a.type.elementType), Value(y, b.type.elementType)))
        return F.when(F.size(a.col) != F.size(b.col), known).otherwise(F.forall(pairs, lambda x: x))
    if ka == "datetime":
        return (a.col["ts"] == b.col["ts"]) & (a.col["zone"] == b.col["zone"])
    if ka == "map" and isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        fa, fb = {f.name: f.dataType for f in a.type.fields}, {f.name: f.dataType for f in b.type.fields}
        if set(fa) != set(fb):
            return known
        out = F.lit(True)
        for n in fa:
            out = out & equal(Value(a.col[n], fa[n]), Value(b.col[n], fb[n]))
        return F.when(a.col.isNotNull() & b.col.isNotNull(), out)
    return a.col == b.col


def order_key(v: Value) -> Column:
    """A column that sorts and compares as the value does."""
    k = kind(v.type)
    if k == "datetime":
        return v.col["ts"]
    if k == "localtime":
        return v.col["day_nanos"]
    if k == "time":
        return F.struct((v.col["day_nanos"] - v.col["offset"].cast("long") * 1_000_000_000).alias("a"), v.col["offset"].alias("b"))
    if k == "duration":
        return (v.col["months"] * 2_629_746 + v.col["days"] * 86_400 + v.col["seconds"]).cast("decimal(38,0)") * 1_000_000_000 + v.col["nanos"]
    if k in ("node", "relationship"):
        return v.col["id"]
    return v.col


def compare(op: str, a: Value, b: Value) -> Column:
    """a < b and the like: unknown across families and for durations; false with NaN."""
    ka, kb = kind(a.type), kind(b.type)
    if ka != kb or ka in ("null", "duration", "map", "node", "relationship", "path"):
        return F.lit(None).cast("boolean")
    x, y = order_key(a), order_key(b)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if ka == "number":
        for v in (a, b):
            if not is_int(v.type):
                out = out & ~F.isnan(v.col)
    return out
