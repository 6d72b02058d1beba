"""Expressions to columns, with Cypher's three-valued logic and number rules."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar, temporal
from ..model import column_of
from .tree import Expr, QueryError
from .values import BOOL, DOUBLE, DURATION, LONG, NULL, STRING, NodeT, RelT, Value, common, compare, equal, is_int, kind, null, order_key, to

FUNCTIONS = scalar.FUNCTIONS | temporal.FUNCTIONS


class Ref:
    """What a name is bound to: ``value()`` as one column, ``prop(name)`` a part of it."""

    def __init__(self, value: Callable[[], Value], prop: Callable[[str], Value | None] | None = None, kind_: str = "value"):
        self.value, self.own, self.kind = value, prop, kind_

    def prop(self, name: str) -> Value:
        if self.own is not None:
            got = self.own(name)
            return null() if got is None else got
        return property_of(self.value(), name)


def property_of(v: Value, name: str) -> Value:
    k = kind(v.type)
    if k in ("null", "list", "number", "string", "boolean", "path"):
        if k == "null":
            return null()
        raise QueryError(f"{k} has no property {name}")
    if isinstance(v.type, T.MapType):
        return Value(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    if k in temporal.KINDS or k == "duration":
        return temporal.accessor(v, name) or null()
    if k in ("node", "relationship"):
        field = column_of(name)
        return Value(v.col[field], v.type[field].dataType) if field in scalar.property_names(v.type) else null()
    return Value(v.col[name], v.type[name].dataType) if isinstance(v.type, T.StructType) and name in v.type.names else null()


def literal(x) -> Value:
    """A parameter or literal as a value; lists and maps as arrays and structs."""
    if x is None:
        return null()
    if isinstance(x, bool):
        v = Value(F.lit(x), BOOL)
    elif isinstance(x, int):
        if not -(2**63) <= x < 2**63:
            raise QueryError(f"integer {x} is out of range")
        v = Value(F.lit(x).cast("long"), LONG)
    elif isinstance(x, float):
        v = Value(F.lit(x), DOUBLE)
    elif isinstance(x, str):
        v = Value(F.lit(x), STRING)
    elif isinstance(x, (list, tuple)):
        return listed([literal(y) for y in x])
    elif isinstance(x, dict):
        return mapped([(k, literal(y)) for k, y in x.items()])
    else:
        raise QueryError(f"no literal for {type(x).__name__}")
    v.literal = x
    return v


def listed(vs: list[Value]) -> Value:
    t = common([v.type for v in vs])
    if not vs:
        return Value(F.array(), T.ArrayType(NULL))
    return Value(F.array(*[to(v, t) for v in vs]), T.ArrayType(t))


def mapped(items: list[tuple[str, Value]]) -> Value:
    if not items:
        return Value(F.struct(), T.StructType([]))
    return Value(F.struct(*[v.col.alias(k) for k, v in items]), T.StructType([T.StructField(k, v.type) for k, v in items]))


def boolean(v: Value, of: str) -> Column:
    if kind(v.type) not in ("boolean", "null"):
        raise QueryError(f"{of} takes booleans, not {kind(v.type)}")
    return v.col.cast("boolean")


class Compiler:
    """Compiles expressions over bound names. ``hook`` gives columns for what needs joins (patterns, aggregates)."""

    def __init__(self, env: dict[str, Ref], params: dict, hook: Callable[[Expr], Value | None] | None = None):
        self.env, self.params, self.hook = env, params, hook

    def inner(self, **more: Ref) -> Compiler:
        return Compiler({**self.env, **more}, self.params, self.hook)

    def __call__(self, e: Expr) -> Value:
        if self.hook is not None:
            got = self.hook(e)
            if got is not None:
                return got
        f = _OPS.get(e.op)
        if f is None:
            raise QueryError(f"{e.op} is not possible here: {e.text}")
        return f(self, *e.args)

    def name(self, n: str) -> Ref:
        if n not in self.env:
            raise QueryError(f"unknown variable {n}")
        return self.env[n]

    def predicate(self, e: Expr, of: str = "WHERE") -> Column:
        return boolean(self(e), of)

    # Logic and comparison.

    def op_not(self, a):
        return Value(~boolean(self(a), "NOT"), BOOL)

    def op_and(self, a, b):
        return Value(boolean(self(a), "AND") & boolean(self(b), "AND"), BOOL)

    def op_or(self, a, b):
        return Value(boolean(self(a), "OR") | boolean(self(b), "OR"), BOOL)

    def op_xor(self, a, b):
        return Value(boolean(self(a), "XOR") != boolean(self(b), "XOR"), BOOL)

    def op_eq(self, a, b):
        return Value(equal(self(a), self(b)), BOOL)

    def op_ne(self, a, b):
        return Value(~equal(self(a), self(b)), BOOL)

    def op_in(self, a, b):
        needle, hay = self(a), self(b)
        if kind(hay.type) == "null":
            return null(BOOL)
        if kind(hay.type) != "list":
            raise QueryError("IN takes a list")
        t = hay.type.elementType
        if kind(t) == "null":
            return Value(F.when(F.size(hay.col) == 0, F.lit(False)), BOOL)
        got = F.exists(hay.col, lambda x: equal(needle, Value(x, t)))
        return Value(F.when(F.size(hay.col) == 0, F.lit(False)).otherwise(got), BOOL)

    def op_isnull(self, a):
        return Value(self(a).col.isNull(), BOOL)

    def op_notnull(self, a):
        return Value(self(a).col.isNotNull(), BOOL)

    def text_test(self, a, b, f):
        x, y = self(a), self(b)
        if kind(x.type) != "string" or kind(y.type) != "string":
            return null(BOOL)
        return Value(f(x.col, y.col), BOOL)

    def op_starts(self, a, b):
        return self.text_test(a, b, lambda x, y: F.startswith(x, y))

    def op_ends(self, a, b):
        return self.text_test(a, b, lambda x, y: F.endswith(x, y))

    def op_contains(self, a, b):
        return self.text_test(a, b, lambda x, y: F.contains(x, y))

    def op_regex(self, a, b):
        return self.text_test(a, b, lambda x, y: F.rlike(x, F.concat(F.lit("^(?:"), y, F.lit(")$"))))

    def op_has_labels(self, a, names):
        ref = self.name(a.args[0])
        if ref.kind == "rel":
            return Value((ref.prop(" type").col == names[0]) if len(names) == 1 else F.lit(False), BOOL)
        v = ref.prop(" labels") if ref.kind == "node" else Value(self(a).col["labels"], T.ArrayType(STRING))
        out = F.lit(True)
        for n in names:
            out = out & F.array_contains(v.col, n)
        return Value(out, BOOL)

    # Arithmetic.

    def op_neg(self, a):
        v = self(a)
        if kind(v.type) == "duration":
            return temporal.scaled(v, F.lit(-1.0))
        return Value(-scalar.expect(v, "number", of="-").col, v.type)

    def op_pos(self, a):
        return scalar.expect(self(a), "number", of="+")

    def numbers(self, x: Value, y: Value, op: str) -> tuple[Column, Column, bool]:
        for v in (x, y):
            scalar.expect(v, "number", of=op)
        whole = all(is_int(v.type) or kind(v.type) == "null" for v in (x, y))
        return x.col.cast("long" if whole else "double"), y.col.cast("long" if whole else "double"), whole

    def op_add(self, a, b):
        x, y = self(a), self(b)
        kx, ky = kind(x.type), kind(y.type)
        if "list" in (kx, ky):
            if "null" in (kx, ky):
                return null(x.type if kx == "list" else y.type)
            parts = [v if k == "list" else Value(F.array(v.col), T.ArrayType(v.type)) for v, k in ((x, kx), (y, ky))]
            t = T.ArrayType(common([p.type.elementType for p in parts]))
            return Value(F.concat(*[p.col.cast(t) for p in parts]), t)
        if "string" in (kx, ky):
            return Value(F.concat(temporal.text_of(x), temporal.text_of(y)), STRING)
        if kx == ky == "duration":
            return temporal.added(x, y, 1)
        if ky == "duration" and kx in temporal.KINDS:
            return temporal.shifted(x, y, 1)
        if kx == "duration" and ky in temporal.KINDS:
            return temporal.shifted(y, x, 1)
        p, q, whole = self.numbers(x, y, "+")
        return Value(p + q, LONG if whole else DOUBLE)

    def op_sub(self, a, b):
        x, y = self(a), self(b)
        if kind(x.type) == kind(y.type) == "duration":
            return temporal.added(x, y, -1)
        if kind(y.type) == "duration" and kind(x.type) in temporal.KINDS:
            return temporal.shifted(x, y, -1)
        p, q, whole = self.numbers(x, y, "-")
        return Value(p - q, LONG if whole else DOUBLE)

    def op_mul(self, a, b):
        x, y = self(a), self(b)
        if "duration" in (kind(x.type), kind(y.type)):
            d, n = (x, y) if kind(x.type) == "duration" else (y, x)
            return temporal.scaled(d, scalar.expect(n, "number", of="*").col.cast("double"))
        p, q, whole = self.numbers(x, y, "*")
        return Value(p * q, LONG if whole else DOUBLE)

    def op_div(self, a, b):
        x, y = self(a), self(b)
        if kind(x.type) == "duration":
            return temporal.scaled(x, F.lit(1.0) / scalar.expect(y, "number", of="/").col.cast("double"))
        p, q, whole = self.numbers(x, y, "/")
        if whole:
            return Value(F.call_function("div", p, q), LONG)
        sign = F.when(q.cast("string").startswith("-"), -1.0).otherwise(1.0)
        by_zero = F.when((p == 0) | F.isnan(p), F.lit(math.nan)).otherwise(F.signum(p) * sign * F.lit(math.inf))
        return Value(F.when(p.isNull() | q.isNull(), F.lit(None)).when(q == 0, by_zero).otherwise(p / F.when(q == 0, F.lit(1.0)).otherwise(q)), DOUBLE)

    def op_mod(self, a, b):
        p, q, whole = self.numbers(self(a), self(b), "%")
        if whole:
            return Value(p % q, LONG)
        return Value(F.when(p.isNull() | q.isNull(), F.lit(None)).when(q == 0, F.lit(math.nan)).otherwise(p % F.when(q == 0, F.lit(1.0)).otherwise(q)), DOUBLE)

    def op_pow(self, a, b):
        p, q, _ = self.numbers(self(a), self(b), "^")
        return Value(F.pow(p.cast("double"), q.cast("double")), DOUBLE)

    # Parts.

    def op_var(self, n):
        return self.name(n).value()

    def op_lit(self, x):
        return literal(x)

    def op_param(self, n):
        if n not in self.params:
            raise QueryError(f"missing parameter ${n}")
        return literal(self.params[n])

    def op_prop(self, e, name):
        if e.op == "var" and (self.hook is None or self.hook(e) is None):
            return self.name(e.args[0]).prop(name)
        return property_of(self(e), name)

    def op_index(self, e, i):
        v, at = self(e), self(i)
        k = kind(v.type)
        if k == "null" or kind(at.type) == "null":
            return null()
        if k == "list":
            if not is_int(at.type):
                raise QueryError("a list takes an integer index")
            n = at.col.cast("int")
            return Value(F.try_element_at(v.col, F.when(n >= 0, n + 1).otherwise(n)), v.type.elementType)
        key = getattr(at, "literal", None)
        if isinstance(key, str):
            return self.op_prop(e, key)
        if isinstance(v.type, T.MapType):
            return Value(F.try_element_at(v.col, at.col), v.type.valueType)
        fields = scalar.property_names(v.type) if isinstance(v.type, T.StructType) else []
        t = common([v.type[f].dataType for f in fields]) if fields else NULL
        out = F.lit(None).cast(t) if fields else F.lit(None)
        for f in fields:
            out = F.when(at.col == f, to(Value(v.col[f], v.type[f].dataType), t)).otherwise(out)
        return Value(out, t)

    def op_slice(self, e, lo, hi):
        v = self(e)
        if kind(v.type) == "null":
            return null()
        n = F.size(v.col)

        def place(x, default):
            if x is None:
                return default
            c = self(x).col.cast("int")
            return F.least(F.greatest(F.when(c < 0, n + c).otherwise(c), F.lit(0)), n)

        a, b = place(lo, F.lit(0)), place(hi, n)
        known = F.lit(True) if lo is None else self(lo).col.isNotNull()
        known = known if hi is None else known & self(hi).col.isNotNull()
        return Value(F.when(known, F.slice(v.col, a + 1, F.greatest(b - a, F.lit(0)))), v.type)

    def op_list(self, items):
        return listed([self(x) for x in items])

    def op_map(self, items):
        return mapped([(k, self(x)) for k, x in items])

    def op_map_projection(self, base, items):
        out: dict[str, Value] = {}
        for key, e in items:
            if key == "all":
                v = scalar.properties(self(base))
                for f in v.type.fields:
                    out[f.name] = Value(v.col[f.name], f.dataType)
            else:
                out[key] = self(e)
        there = self(base).col.isNotNull()
        v = mapped(list(out.items()))
        return Value(F.when(there, v.col), v.type)

    def op_case(self, subject, whens, other):
        vs = [self(x) for _, x in whens] + ([self(other)] if other is not None else [])
        t = common([v.type for v in vs])
        base = self(subject) if subject is not None else None
        out = None
        for (cond, _), v in zip(whens, vs, strict=False):
            test = equal(base, self(cond)) if base is not None else self.predicate(cond, "WHEN")
            out = F.when(test, to(v, t)) if out is None else out.when(test, to(v, t))
        return Value(out if other is None else out.otherwise(to(vs[-1], t)), t)

    # Lists.

    def lambda_over(self, v: Value, var: str):
        t = v.type.elementType
        return lambda x: self.inner(**{var: Ref(lambda: Value(x, t))})

    def op_comprehension(self, var, e, cond, body):
        v = self(e)
        if kind(v.type) == "null":
            return null(T.ArrayType(NULL))
        bind = self.lambda_over(v, var)
        out = v.col
        if cond is not None:
            out = F.filter(out, lambda x: bind(x).predicate(cond))
        if body is None:
            return Value(out, v.type)
        seen: list[T.DataType] = []

        def one(x):
            got = bind(x)(body)
            seen.append(got.type)
            return got.col

        out = F.transform(out, one)
        return Value(out, T.ArrayType(seen[-1]))

    def op_quantifier(self, which, var, e, cond):
        v = self(e)
        if kind(v.type) == "null":
            return null(BOOL)
        if kind(v.type.elementType) == "null":
            return Value(F.lit(which in ("all", "none")), BOOL)
        bind = self.lambda_over(v, var)
        test = lambda x: bind(x).predicate(cond)
        if which == "all":
            return Value(F.forall(v.col, test), BOOL)
        if which in ("any", "none"):
            out = F.exists(v.col, test)
            return Value(out if which == "any" else ~out, BOOL)
        marks = F.transform(v.col, test)
        sure, open_ = F.size(F.filter(marks, lambda m: m)), F.size(F.filter(marks, lambda m: m.isNull()))
        return Value(F.when(sure > 1, False).when(open_ > 0, F.lit(None)).otherwise(sure == 1), BOOL)

    def op_reduce(self, acc, first, var, e, body):
        v, start = self(e), self(first)
        if kind(v.type) == "null":
            return null(start.type)
        bind = self.lambda_over(v, var)
        t = start.type
        for _ in range(2):  # the accumulator's type may widen once
            got = bind(F.lit(None).cast(v.type.elementType)).inner(**{acc: Ref(lambda t=t: null(t))})(body).type
            t = common([t, got])
        out = F.aggregate(v.col, to(start, t), lambda a, x: to(bind(x).inner(**{acc: Ref(lambda: Value(a, t))})(body), t))
        return Value(out, t)

    def op_call(self, name, args, how):
        if name in scalar.AGGREGATES:
            raise QueryError(f"{name}() is not allowed here")
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name}")
        lo, hi, f = FUNCTIONS[name]
        if not lo <= len(args) <= hi:
            raise QueryError(f"{name} takes {lo} to {hi} arguments" if lo != hi else f"{name} takes {lo} arguments")
        if how:
            raise QueryError(f"{name} takes no {how}")
        if name in ("id", "labels", "type", "revision") and len(args) == 1 and args[0].op == "var":
            ref = self.name(args[0].args[0])
            if ref.kind in ("node", "rel"):
                wants = {"id": ("node", "rel"), "revision": ("node", "rel"), "labels": ("node",), "type": ("rel",)}
                if ref.kind not in wants[name]:
                    raise QueryError(f"InvalidArgumentValue: {name} takes no {ref.kind}")
                return ref.prop(" " + name)
        return f(*[self(a) for a in args])


def _order(op):
    return lambda self, a, b: Value(compare(op, self(a), self(b)), BOOL)


_OPS: dict[str, Callable] = {
    "=": Compiler.op_eq, "<>": Compiler.op_ne, "<": _order("<"), "<=": _order("<="), ">": _order(">"), ">=": _order(">="), "=~": Compiler.op_regex,
    "+": Compiler.op_add, "-": Compiler.op_sub, "*": Compiler.op_mul, "/": Compiler.op_div, "%": Compiler.op_mod, "^": Compiler.op_pow, "||": Compiler.op_add, "labels?": Compiler.op_has_labels,
}
_OPS |= {n[3:]: getattr(Compiler, n) for n in dir(Compiler) if n.startswith("op_")}

__all__ = ["Compiler", "Ref", "literal", "property_of", "order_key", "DURATION", "NodeT", "RelT"]
