"""Scalar functions: name -> (fewest arguments, most arguments, what makes the value)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tree import QueryError
from ..plans.values import BOOL, DOUBLE, LONG, NULL, STRING, NodeT, PathT, RelT, Value, common, is_int, kind, null, to

WHITE = r"[\s\u0085   -     　]+"


def expect(v: Value, *kinds: str, of: str = "") -> Value:
    if kind(v.type) not in (*kinds, "null"):
        raise QueryError(f"InvalidArgumentValue: {of} takes {' or '.join(kinds)}, not {kind(v.type)}")
    return v


def _string(name, f):
    return name, (1, 1, lambda v: Value(f(expect(v, "string", of=name).col.cast("string")), STRING))


def _number(name, f):
    """A function of one number that gives a float."""
    return name, (1, 1, lambda v: Value(f(expect(v, "number", of=name).col.cast("double")), DOUBLE))


def _nan(ok: Column, c: Column, otherwise: float = math.nan) -> Column:
    return F.when(ok, c).otherwise(F.lit(otherwise))


def _log(f):
    """IEEE logarithms: minus infinity of 0, NaN below."""
    return lambda x: F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (x < 0), F.lit(math.nan)).when(x == 0, F.lit(-math.inf)).otherwise(f(x))


def _count_arg(v: Value, of: str) -> Column:
    expect(v, "number", of=of)
    if not is_int(v.type) and kind(v.type) != "null":
        raise QueryError(f"InvalidArgumentValue: {of} takes an integer")
    c = v.col.cast("long")
    return F.when(c < 0, F.raise_error(F.lit(f"InvalidArgumentValue: {of} takes no negative number")).cast("long")).otherwise(c)


def left(s: Value, n: Value) -> Value:
    return Value(F.substring(expect(s, "string", of="left").col.cast("string"), F.lit(1), _count_arg(n, "left").cast("int")), STRING)


def right(s: Value, n: Value) -> Value:
    c, k = expect(s, "string", of="right").col.cast("string"), _count_arg(n, "right").cast("int")
    return Value(F.when(k == 0, F.when(c.isNotNull(), "")).otherwise(F.right(c, k)), STRING)


def substring(s: Value, start: Value, length: Value | None = None) -> Value:
    c, at = expect(s, "string", of="substring").col.cast("string"), _count_arg(start, "substring").cast("int") + 1
    n = F.char_length(c) if length is None else _count_arg(length, "substring").cast("int")
    return Value(F.substring(c, at, n), STRING)


def split(s: Value, sep: Value) -> Value:
    quoted = F.concat(F.lit("\\Q"), F.replace(expect(sep, "string", of="split").col.cast("string"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Value(F.split(expect(s, "string", of="split").col.cast("string"), quoted, -1), T.ArrayType(STRING))


def replace(s: Value, old: Value, new: Value) -> Value:
    for v in (s, old, new):
        expect(v, "string", of="replace")
    return Value(F.replace(*[v.col.cast("string") for v in (s, old, new)]), STRING)


def size(v: Value, of: str = "size") -> Value:
    k = kind(v.type)
    if k == "path" and of == "length":
        return Value(F.size(v.col["rels"]).cast("long"), LONG)
    if k == "string":
        return Value(F.char_length(v.col).cast("long"), LONG)
    if k == "list" or isinstance(v.type, T.MapType):
        return Value(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), LONG)
    if k == "map":
        return Value(F.when(v.col.isNotNull(), F.lit(len(v.type.fields))).cast("long"), LONG)
    expect(v, "list", "map", "string", of=of)
    return null(LONG)


def is_empty(v: Value) -> Value:
    return Value(size(v, "isEmpty").col == 0, BOOL)


def _list(v: Value, of: str) -> T.DataType:
    expect(v, "list", of=of)
    return v.type.elementType if kind(v.type) == "list" else NULL


def element(v: Value, at: int, of: str) -> Value:
    t = _list(v, of)
    return null() if kind(v.type) == "null" else Value(F.try_element_at(v.col, F.lit(at)), t)


def tail(v: Value) -> Value:
    t = _list(v, "tail")
    return null() if kind(v.type) == "null" else Value(F.slice(v.col, F.lit(2), F.greatest(F.size(v.col) - 1, F.lit(0))), T.ArrayType(t))


def reverse(v: Value) -> Value:
    expect(v, "list", "string", of="reverse")
    return Value(F.reverse(v.col), v.type)


def range_(a: Value, b: Value, step: Value | None = None) -> Value:
    for v in (a, b) + ((step,) if step else ()):
        if not is_int(v.type) and kind(v.type) != "null":
            raise QueryError("InvalidArgumentValue: range takes integers")
    x, y = a.col.cast("long"), b.col.cast("long")
    s = F.lit(1).cast("long") if step is None else step.col.cast("long")
    checked = F.when(s == 0, F.raise_error(F.lit("InvalidArgumentValue: range takes no step of 0")).cast("long")).otherwise(s)
    fits = ((checked > 0) & (x <= y)) | ((checked < 0) & (x >= y))
    none = F.array().cast("array<bigint>")
    return Value(F.when(x.isNotNull() & y.isNotNull() & s.isNotNull(), F.when(fits, F.sequence(x, F.when(fits, y).otherwise(x), F.when(fits, checked).otherwise(F.lit(1).cast("long")))).otherwise(none)), T.ArrayType(LONG))


def coalesce(*vs: Value) -> Value:
    t = common([v.type for v in vs])
    return Value(F.coalesce(*[to(v, t) for v in vs]), t)


def to_boolean(v: Value) -> Value:
    if kind(expect(v, "boolean", "string", of="toBoolean").type) == "boolean":
        return v
    s = F.lower(F.trim(v.col.cast("string")))
    return Value(F.when(s == "true", True).when(s == "false", False), BOOL)


def to_float(v: Value) -> Value:
    c = expect(v, "number", "string", of="toFloat").col
    return Value(c.cast("double") if kind(v.type) == "number" else F.trim(c.cast("string")).try_cast("double"), DOUBLE)


def to_integer(v: Value) -> Value:
    k, c = kind(expect(v, "boolean", "number", "string", of="toInteger").type), v.col
    if k == "string":
        s = F.trim(c)
        c = F.coalesce(s.try_cast("long"), s.try_cast("double").try_cast("long"))
    return Value(c.cast("long"), LONG)


def to_list(v: Value) -> Value:
    k = kind(v.type)
    if k in ("list", "null"):
        return v
    if k == "path":
        return Value(v.col["nodes"], v.type["nodes"].dataType)
    return Value(F.when(v.col.isNotNull(), F.array(v.col)), T.ArrayType(v.type))


def to_string(v: Value) -> Value:
    from .temporal import text_of

    expect(v, "boolean", "number", "string", "date", "localdatetime", "datetime", "localtime", "time", "duration", of="toString")
    return Value(text_of(v), STRING)


def keys(v: Value) -> Value:
    k = kind(expect(v, "map", "node", "relationship", of="keys").type)
    if k == "null":
        return null(T.ArrayType(STRING))
    if isinstance(v.type, T.MapType):
        return Value(F.map_keys(v.col), T.ArrayType(STRING))
    names = property_names(v.type)
    if k == "map":
        return Value(F.when(v.col.isNotNull(), F.array(*[F.lit(n) for n in names]).cast("array<string>")), T.ArrayType(STRING))
    held = F.array_compact(F.array(*[F.when(v.col[n].isNotNull(), F.lit(n.removeprefix("."))) for n in names]).cast("array<string>"))
    return Value(F.when(v.col.isNotNull(), held), T.ArrayType(STRING))


def property_names(t: T.DataType) -> list[str]:
    system = {NodeT: ("id", "labels", "revision"), RelT: ("id", "src", "dst", "type", "revision")}.get(type(t), ())
    return [f.name for f in t.fields if f.name not in system]


def properties(v: Value) -> Value:
    k = kind(expect(v, "map", "node", "relationship", of="properties").type)
    if k in ("map", "null"):
        return v
    names = property_names(v.type)
    t = T.StructType([T.StructField(n.removeprefix("."), v.type[n].dataType) for n in names])
    return Value(F.when(v.col.isNotNull(), F.struct(*[v.col[n].alias(n.removeprefix(".")) for n in names])), t)


def part(name: str, *kinds: str, type_: T.DataType | None = None):
    def get(v: Value) -> Value:
        expect(v, *kinds, of=name)
        return null() if kind(v.type) == "null" else Value(v.col[name], type_ or v.type[name].dataType)

    return get


def _pair(a: Value, b: Value, of: str) -> tuple[Column, Column]:
    for v in (a, b):
        if kind(expect(v, "list", of=of).type) == "list" and kind(v.type.elementType) not in ("number", "null"):
            raise QueryError(f"InvalidArgumentValue: {of} takes lists of numbers")
    x, y = a.col.cast("array<double>"), b.col.cast("array<double>")
    differ = F.raise_error(F.lit(f"InvalidArgumentValue: {of} takes vectors of one dimension")).cast("array<double>")
    return F.when(F.size(x) == F.size(y), x).when(x.isNull() | y.isNull(), F.lit(None)).otherwise(differ), y


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Value, b: Value) -> Value:
    x, y = _pair(a, b, "vector.dot")
    return Value(_total(F.zip_with(x, y, lambda p, q: p * q)), DOUBLE)


def distance(a: Value, b: Value) -> Value:
    x, y = _pair(a, b, "vector.distance")
    return Value(F.sqrt(_total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))), DOUBLE)


def cosine(a: Value, b: Value) -> Value:
    x, y = _pair(a, b, "vector.cosine")
    norm = F.sqrt(_total(F.transform(x, lambda p: p * p))) * F.sqrt(_total(F.transform(y, lambda p: p * p)))
    return Value(F.when(norm == 0, F.lit(math.nan)).otherwise(_total(F.zip_with(x, y, lambda p, q: p * q)) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)), DOUBLE)


def normalize(a: Value) -> Value:
    x, _ = _pair(a, a, "vector.normalize")
    norm = F.sqrt(_total(F.transform(x, lambda p: p * p)))
    return Value(F.transform(x, lambda p: F.when(norm == 0, F.lit(math.nan)).otherwise(p / F.when(norm == 0, F.lit(1.0)).otherwise(norm))), T.ArrayType(DOUBLE))


def _abs(v: Value) -> Value:
    return Value(F.abs(expect(v, "number", of="abs").col), v.type)


def _sign(v: Value) -> Value:
    return Value(F.signum(expect(v, "number", of="sign").col.cast("double")).cast("long"), LONG)


def _two(name, f):
    return name, (2, 2, lambda a, b: Value(f(expect(a, "number", of=name).col.cast("double"), expect(b, "number", of=name).col.cast("double")), DOUBLE))


FUNCTIONS: dict[str, tuple] = dict([
    # String.
    _string("lower", F.lower), _string("tolower", F.lower), _string("upper", F.upper),
    _string("ltrim", lambda c: F.regexp_replace(c, f"^{WHITE}", "")), _string("rtrim", lambda c: F.regexp_replace(c, f"{WHITE}$", "")),
    _string("trim", lambda c: F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")),
    ("left", (2, 2, left)), ("right", (2, 2, right)), ("substring", (2, 3, substring)), ("split", (2, 2, split)), ("replace", (3, 3, replace)),
    # Numeric.
    ("abs", (1, 1, _abs)), ("sign", (1, 1, _sign)),
    _number("acos", F.acos), _number("asin", F.asin), _number("atan", F.atan), _number("cos", F.cos), _number("sin", F.sin), _number("tan", F.tan),
    _number("cot", lambda x: F.when(F.tan(x) == 0, F.lit(math.inf)).otherwise(F.lit(1.0) / F.when(F.tan(x) == 0, F.lit(1.0)).otherwise(F.tan(x)))),
    _number("degrees", F.degrees), _number("radians", F.radians), _number("exp", F.exp), _number("sqrt", F.sqrt),
    _number("ceil", lambda x: F.when(F.abs(x) < 2**53, F.ceil(F.when(F.abs(x) < 2**53, x)).cast("double")).otherwise(x)),
    _number("floor", lambda x: F.when(F.abs(x) < 2**53, F.floor(F.when(F.abs(x) < 2**53, x)).cast("double")).otherwise(x)),
    _number("round", lambda x: F.round(x)), _number("log", _log(F.log)), _number("log10", _log(F.log10)),
    _two("atan2", F.atan2), _two("power", F.pow),
    ("e", (0, 0, lambda: Value(F.lit(math.e), DOUBLE))), ("pi", (0, 0, lambda: Value(F.lit(math.pi), DOUBLE))), ("rand", (0, 0, lambda: Value(F.rand(), DOUBLE))),
    # List.
    ("head", (1, 1, lambda v: element(v, 1, "head"))), ("last", (1, 1, lambda v: element(v, -1, "last"))), ("tail", (1, 1, tail)),
    ("size", (1, 1, size)), ("length", (1, 1, lambda v: size(v, "length"))), ("isempty", (1, 1, is_empty)), ("reverse", (1, 1, reverse)), ("range", (2, 3, range_)),
    # Conversion.
    ("coalesce", (1, 99, coalesce)), ("toboolean", (1, 1, to_boolean)), ("tofloat", (1, 1, to_float)), ("tointeger", (1, 1, to_integer)),
    ("tolist", (1, 1, to_list)), ("tostring", (1, 1, to_string)),
    # Entities and paths.
    ("id", (1, 1, part("id", "node", "relationship", type_=LONG))), ("labels", (1, 1, part("labels", "node", type_=T.ArrayType(STRING)))),
    ("type", (1, 1, part("type", "relationship", type_=STRING))), ("revision", (1, 1, part("revision", "node", "relationship", type_=LONG))),
    ("keys", (1, 1, keys)), ("properties", (1, 1, properties)),
    ("nodes", (1, 1, part("nodes", "path"))), ("relationships", (1, 1, part("rels", "path"))),
    # Vector.
    ("vector.dot", (2, 2, dot)), ("vector.distance", (2, 2, distance)), ("vector.cosine", (2, 2, cosine)), ("vector.normalize", (1, 1, normalize)),
])

#: Functions that the compiler handles itself: they need the rows or the graph.
ENTITY_LOOKUPS = ("startnode", "endnode")
AGGREGATES = ("avg", "collect", "count", "max", "min", "percentilecont", "percentiledisc", "stdev", "stdevp", "sum", "variance", "variancep")
