"""Tokens to syntax trees: clauses, patterns and expressions."""

from __future__ import annotations

from .lexer import Token, tokens
from .tree import Clause, Expr, Item, NodePattern, PathPattern, Projection, Query, QueryError, RelPattern

#: Binding powers of binary operators.
POWER = {"OR": 10, "XOR": 15, "AND": 20, "+": 40, "-": 40, "||": 40, "*": 50, "/": 50, "%": 50, "^": 70}
COMPARISON = {"=", "<>", "!=", "<", "<=", ">", ">="}
SELECTORS = {"ANY", "ALL", "SHORTEST", "DIFFERENT", "REPEATABLE", "ACYCLIC"}


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at, self.hidden = text, tokens(text), 0, 0

    # Tokens.

    @property
    def tok(self) -> Token:
        return self.toks[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def fail(self, what: str):
        t = self.tok
        raise QueryError(f"expected {what} at {t.start}, found {self.text[t.start : t.end] or 'the end'!r}")

    def word(self, *words: str) -> bool:
        """Take these keywords in a row if they come next."""
        if all(self.peek(i).word == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(" ".join(words))

    def sign(self, s: str) -> bool:
        if self.tok.kind == "sign" and self.tok.value == s:
            self.at += 1
            return True
        return False

    def is_sign(self, s: str, n: int = 0) -> bool:
        t = self.peek(n)
        return t.kind == "sign" and t.value == s

    def need_sign(self, s: str) -> None:
        if not self.sign(s):
            self.fail(repr(s))

    def name(self, what: str = "a name") -> str:
        if self.tok.kind != "name":
            self.fail(what)
        self.at += 1
        return self.toks[self.at - 1].value

    def integer(self) -> int:
        if self.tok.kind != "int":
            self.fail("an integer")
        self.at += 1
        return self.toks[self.at - 1].value

    def fresh(self) -> str:
        self.hidden += 1
        return f" {self.hidden}"

    # Queries.

    def query(self) -> Query:
        out = Query([])
        while True:
            if self.word("USE", "LAYERS") or self.word("USE", "LAYER"):
                out.read_layers = [self.name().upper()]
                while self.sign(",") or self.sign("|") or self.sign("+"):
                    out.read_layers.append(self.name().upper())
            elif self.word("USE"):
                out.project = self.name("a project")
            elif self.word("WRITE", "LAYER"):
                out.write_layer = self.name().upper()
            elif self.word("AT", "TIME"):
                out.at_time = self.expr()
            else:
                break
        kinds = set()
        out.branches.append(self.clauses())
        while self.word("UNION"):
            kinds.add(self.word("ALL") or (self.word("DISTINCT") and False))
            out.branches.append(self.clauses())
        if len(kinds) > 1:
            raise QueryError("UNION and UNION ALL cannot be mixed")
        out.union_all = kinds == {True}
        self.sign(";")
        if self.tok.kind != "end":
            self.fail("a clause")
        return out

    def clauses(self) -> list[Clause]:
        out = []
        while self.tok.kind != "end" and not self.is_sign(";") and self.tok.word != "UNION":
            out.append(self.clause())
        if not out:
            self.fail("a clause")
        return out

    def clause(self) -> Clause:
        optional = self.tok.word == "OPTIONAL" and self.peek().word == "MATCH"
        if optional:
            self.at += 1
        if self.word("MATCH"):
            mode = None
            patterns = [self.path()]
            while self.sign(","):
                patterns.append(self.path())
            where = self.expr() if self.word("WHERE") else None
            return Clause("match", {"patterns": patterns, "where": where, "optional": optional, "mode": mode})
        if self.word("FILTER"):
            self.word("WHERE")
            return Clause("filter", {"where": self.expr()})
        if self.word("WHERE"):
            return Clause("filter", {"where": self.expr()})
        if self.word("UNWIND"):
            e = self.expr()
            self.need("AS")
            return Clause("unwind", {"list": e, "var": self.name()})
        if self.word("FOR"):
            var = self.name()
            self.need("IN")
            return Clause("unwind", {"list": self.expr(), "var": var})
        if self.word("LET"):
            items = []
            while True:
                var = self.name()
                self.need_sign("=")
                items.append((var, self.expr()))
                if not self.sign(","):
                    return Clause("let", {"items": items})
        if self.word("WITH") or self.word("RETURN"):
            kind = self.toks[self.at - 1].word.lower()
            return Clause(kind, {"projection": self.projection(kind)})
        if self.word("ORDER", "BY"):
            return Clause("with", {"projection": Projection([], True, order=self.order())})
        if self.word("SKIP") or self.word("OFFSET"):
            return Clause("with", {"projection": Projection([], True, skip=self.expr())})
        if self.word("LIMIT"):
            return Clause("with", {"projection": Projection([], True, limit=self.expr())})
        if self.word("CALL"):
            return self.call()
        if self.word("SEARCH"):
            return self.search()
        if self.word("HISTORY"):
            var = self.name()
            self.need_sign(".")
            prop = self.name()
            self.need("FROM")
            lo = self.expr()
            self.need("TO")
            hi = self.expr()
            self.need("AS")
            return Clause("history", {"var": var, "prop": prop, "from": lo, "to": hi, "alias": self.name()})
        if self.word("WINDOW"):
            return self.window()
        if self.word("CREATE") or self.word("INSERT"):
            patterns = [self.path()]
            while self.sign(","):
                patterns.append(self.path())
            return Clause("create", {"patterns": patterns})
        if self.word("MERGE"):
            pattern, on = self.path(), {"create": [], "match": []}
            while self.word("ON"):
                which = "create" if self.word("CREATE") else "match" if self.word("MATCH") else self.fail("CREATE or MATCH")
                self.need("SET")
                on[which] += self.sets()
            return Clause("merge", {"pattern": pattern, "on": on})
        if self.word("SET"):
            return Clause("set", {"items": self.sets()})
        if self.word("REMOVE"):
            items = []
            while True:
                var = self.name()
                if self.sign("."):
                    items.append(("prop", var, self.name()))
                else:
                    while self.sign(":"):
                        items.append(("label", var, self.name()))
                if not self.sign(","):
                    return Clause("remove", {"items": items})
        detach = self.word("DETACH")
        if not detach:
            self.word("NODETACH")
        if self.word("DELETE"):
            names = [self.name()]
            while self.sign(","):
                names.append(self.name())
            return Clause("delete", {"vars": names, "detach": detach})
        if self.word("FINISH"):
            return Clause("finish", {})
        self.fail("a clause")

    def order(self) -> list[tuple[Expr, bool]]:
        out = []
        while True:
            e = self.expr()
            down = self.word("DESC") or self.word("DESCENDING")
            if not down:
                self.word("ASC") or self.word("ASCENDING")
            out.append((e, down))
            if not self.sign(","):
                return out

    def projection(self, kind: str) -> Projection:
        out = Projection([], distinct=self.word("DISTINCT"))
        if self.sign("*"):
            out.star = True
        if not out.star or self.sign(","):
            while True:
                e = self.expr()
                named = self.name() if self.word("AS") else None
                if named is None and kind == "with" and e.op != "var":
                    raise QueryError(f"WITH needs a name for {e.text}")
                out.items.append(Item(e, named if named is not None else e.text))
                if not self.sign(","):
                    break
        if self.word("ORDER", "BY"):
            out.order = self.order()
        if self.word("SKIP") or self.word("OFFSET"):
            out.skip = self.expr()
        if self.word("LIMIT"):
            out.limit = self.expr()
        if kind == "with" and self.word("WHERE"):
            out.where = self.expr()
        return out

    def sets(self) -> list[tuple]:
        out = []
        while True:
            var = self.name()
            if self.sign("."):
                prop = self.name()
                self.need_sign("=")
                value = self.expr()
                out.append(("prop", var, prop, value, self.expr() if self.word("AT", "TIME") else None))
            elif self.sign("+="):
                out.append(("merge", var, self.expr()))
            elif self.sign("="):
                out.append(("replace", var, self.expr()))
            else:
                if not self.is_sign(":"):
                    self.fail("a property or label")
                while self.sign(":"):
                    out.append(("label", var, self.name()))
            if not self.sign(","):
                return out

    def call(self) -> Clause:
        name = self.name()
        while self.sign("."):
            name += "." + self.name()
        args = None
        if self.sign("("):
            args = []
            while not self.sign(")"):
                args.append(self.expr())
                if not self.is_sign(")"):
                    self.need_sign(",")
        yields, star, where = None, False, None
        if self.word("YIELD"):
            if self.sign("*"):
                star = True
            else:
                yields = []
                while True:
                    column = self.name()
                    yields.append((column, self.name() if self.word("AS") else column))
                    if not self.sign(","):
                        break
            where = self.expr() if self.word("WHERE") else None
        return Clause("call", {"name": name, "args": args, "yields": yields, "star": star, "where": where})

    def search(self) -> Clause:
        var = self.name()
        self.need("IN")
        self.need_sign("(")
        self.word("EMBEDDING") or self.word("VECTOR") or self.word("TEXT")
        self.need("INDEX")
        data = {"var": var, "index": self.name(), "method": None, "alias": None, "evidence": None}
        self.need("FOR")
        if self.word("HYBRID", "TEXT"):
            data["kind"] = "hybrid"
        else:
            data["kind"] = "text" if self.word("TEXT") else "vector"
            if data["kind"] == "vector":
                self.word("VECTOR")
        data["input"] = self.expr()
        if self.word("VECTOR"):
            data["vector"] = self.expr()
        if self.word("USING"):
            data["method"] = self.name().lower()
        self.need("LIMIT")
        data["limit"] = self.expr()
        self.need_sign(")")
        self.need("SCORE", "AS")
        data["alias"] = self.name()
        if self.word("EVIDENCE", "AS"):
            data["evidence"] = self.name()
        return Clause("search", data)

    def window(self) -> Clause:
        hopping = self.word("HOPPING")
        if not hopping:
            self.need("TUMBLING")
        data = {"width": self.expr(), "every": None, "align": None, "zone": None, "empty": False}
        if hopping:
            self.need("EVERY")
            data["every"] = self.expr()
        self.need("ON")
        data["on"] = self.expr()
        while True:
            if self.word("ALIGN", "TO"):
                data["align"] = self.expr()
            elif self.word("TIME", "ZONE"):
                data["zone"] = self.expr()
            elif self.word("EMIT", "EMPTY"):
                data["empty"] = True
            else:
                break
        self.need("AS")
        data["alias"] = self.name()
        return Clause("window", data)

    # Patterns.

    def path(self) -> PathPattern:
        out = PathPattern([])
        if self.tok.kind == "name" and self.is_sign("=", 1):
            out.var = self.name()
            self.at += 1
        if self.tok.word in SELECTORS and not self.is_sign("("):
            self.selector(out)
        out.parts = self.chain()
        return out

    def selector(self, out: PathPattern) -> None:
        if self.word("DIFFERENT", "RELATIONSHIPS"):
            out.mode = "trail"
        elif self.word("REPEATABLE", "ELEMENTS"):
            out.mode = "walk"
        elif self.word("ACYCLIC"):
            out.mode = "acyclic"
        elif self.word("ALL", "SHORTEST"):
            out.selector = "all_shortest"
        elif self.word("ANY", "SHORTEST"):
            out.selector = "any_shortest"
        elif self.word("ANY"):
            out.selector = "any"
        elif self.word("SHORTEST"):
            out.count = self.integer() if self.tok.kind == "int" else 1
            out.selector = "groups" if self.word("GROUPS") or self.word("GROUP") else "shortest"
            if out.count < 1:
                raise QueryError("SHORTEST needs a positive count")
        else:
            self.fail("a path selector")

    def chain(self) -> list:
        parts: list = [self.node()]
        while self.is_sign("-") or self.is_sign("<"):
            parts += [self.rel(), self.node()]
        return parts

    def props(self) -> list[tuple[str, Expr]]:
        out = []
        if self.sign("{"):
            while not self.sign("}"):
                key = self.name()
                self.need_sign(":")
                out.append((key, self.expr()))
                if not self.is_sign("}"):
                    self.need_sign(",")
        return out

    def node(self) -> NodePattern:
        self.need_sign("(")
        named = self.tok.kind == "name"
        out = NodePattern(self.name() if named else self.fresh(), named=named)
        while self.sign(":") or self.sign("&"):
            out.labels.append(self.name("a label"))
        out.props = self.props()
        self.need_sign(")")
        return out

    def rel(self) -> RelPattern:
        left = self.sign("<")
        self.need_sign("-")
        out = RelPattern("")
        out.named = False
        if self.sign("["):
            if self.tok.kind == "name":
                out.var, out.named = self.name(), True
            if self.sign(":"):
                out.types.append(self.name("a type"))
                while self.sign("|"):
                    self.sign(":")
                    out.types.append(self.name("a type"))
            if self.sign("*"):
                out.lo, out.hi = 1, None
                if self.tok.kind == "int":
                    out.lo = out.hi = self.integer()
                    if self.sign(".."):
                        out.hi = self.integer() if self.tok.kind == "int" else None
                elif self.sign(".."):
                    out.hi = self.integer() if self.tok.kind == "int" else None
            out.props = self.props()
            self.need_sign("]")
        self.need_sign("-")
        right = self.sign(">")
        out.direction = "both" if left == right else "in" if left else "out"
        if not out.variable:
            if self.sign("+"):
                out.lo, out.hi = 1, None
            elif self.sign("*"):
                out.lo, out.hi = 0, None
            elif self.is_sign("{"):
                self.at += 1
                out.lo = self.integer() if self.tok.kind == "int" else 0
                if self.sign(","):
                    out.hi = self.integer() if self.tok.kind == "int" else None
                else:
                    out.hi = out.lo
                self.need_sign("}")
                if out.hi is not None and out.hi < out.lo:
                    raise QueryError("the maximum is below the minimum")
        out.var = out.var or self.fresh()
        return out

    # Expressions.

    def make(self, start: int, op: str, *args) -> Expr:
        return Expr(op, args, self.text[self.toks[start].start : self.toks[self.at - 1].end])

    def expr(self, power: int = 0) -> Expr:
        start = self.at
        left = self.prefix()
        while True:
            t = self.tok
            op = t.word if t.word in ("OR", "XOR", "AND") else t.value if t.kind == "sign" else None
            if op in POWER and POWER[op] > power:
                self.at += 1
                left = self.make(start, op.lower(), left, self.expr(POWER[op])) if op.isalpha() else self.binary(start, op, left, POWER[op])
            elif op in COMPARISON and power < 30:
                left = self.comparison(start, left)
            elif op == "=~" and power < 30:
                self.at += 1
                right = self.expr(30)
                left = self.make(start, "=~", left, right)
            elif power < 35 and t.word in ("IN", "STARTS", "ENDS", "CONTAINS", "IS"):
                left = self.predicate(start, left)
            elif op == ":" and left.op == "var" and power < 35:
                names = []
                while self.sign(":"):
                    names.append(self.name())
                left = self.make(start, "labels?", left, tuple(names))
            else:
                return left

    def binary(self, start: int, op: str, left: Expr, power: int) -> Expr:
        right = self.expr(power)
        return self.make(start, op, left, right)

    def comparison(self, start: int, left: Expr) -> Expr:
        out, a = None, left
        while self.tok.kind == "sign" and self.tok.value in COMPARISON:
            op = "<>" if self.tok.value == "!=" else self.tok.value
            self.at += 1
            b = self.expr(30)
            one = self.make(start, op, a, b)
            out = one if out is None else self.make(start, "and", out, one)
            a = b
        return out

    def predicate(self, start: int, left: Expr) -> Expr:
        if self.word("IN"):
            right = self.expr(35)
            return self.make(start, "in", left, right)
        if self.word("STARTS", "WITH"):
            right = self.expr(35)
            return self.make(start, "starts", left, right)
        if self.word("ENDS", "WITH"):
            right = self.expr(35)
            return self.make(start, "ends", left, right)
        if self.word("CONTAINS"):
            right = self.expr(35)
            return self.make(start, "contains", left, right)
        if self.word("IS", "NOT", "NULL"):
            return self.make(start, "notnull", left)
        if self.word("IS", "NULL"):
            return self.make(start, "isnull", left)
        self.fail("an operator")

    def prefix(self) -> Expr:
        start = self.at
        if self.word("NOT"):
            e = self.expr(25)
            return self.make(start, "not", e)
        if self.sign("-"):
            if self.tok.kind in ("int", "float") and not self.is_sign("^", 1):
                value = -self.tok.value
                self.at += 1
                return self.postfix(start, self.make(start, "lit", value))
            e = self.expr(80)
            return self.make(start, "neg", e)
        if self.sign("+"):
            e = self.expr(80)
            return self.make(start, "pos", e)
        return self.postfix(start, self.primary())

    def postfix(self, start: int, e: Expr) -> Expr:
        while True:
            if self.is_sign(".") and self.peek().kind == "name":
                self.at += 1
                e = self.make(start, "prop", e, self.name())
            elif self.sign("["):
                lo = None if self.is_sign("..") else self.expr()
                if self.sign(".."):
                    hi = None if self.is_sign("]") else self.expr()
                    self.need_sign("]")
                    e = self.make(start, "slice", e, lo, hi)
                else:
                    self.need_sign("]")
                    e = self.make(start, "index", e, lo)
            elif self.is_sign("{") and e.op == "var" and (self.is_sign(".", 1) or self.is_sign("}", 1) or (self.peek().kind == "name" and (self.is_sign(":", 2) or self.is_sign(",", 2) or self.is_sign("}", 2)))):
                e = self.map_projection(start, e)
            else:
                return e

    def map_projection(self, start: int, base: Expr) -> Expr:
        self.need_sign("{")
        items = []
        while not self.sign("}"):
            if self.sign("."):
                if self.sign("*"):
                    items.append(("all", None))
                else:
                    key = self.name()
                    items.append((key, Expr("prop", (base, key), "")))
            else:
                key = self.name()
                items.append((key, self.expr() if self.sign(":") else Expr("var", (key,), key)))
            if not self.is_sign("}"):
                self.need_sign(",")
        return self.make(start, "map_projection", base, tuple(items))

    def try_pattern(self) -> Expr | None:
        """A pattern predicate, if a relationship follows the node."""
        start, hidden = self.at, self.hidden
        try:
            parts = self.chain()
        except QueryError:
            parts = []
        if len(parts) < 3:
            self.at, self.hidden = start, hidden
            return None
        return self.make(start, "pattern", PathPattern(parts))

    def primary(self) -> Expr:
        start, t = self.at, self.tok
        if t.kind in ("int", "float", "string"):
            self.at += 1
            return self.make(start, "lit", t.value)
        if t.kind == "param":
            self.at += 1
            return self.make(start, "param", t.value)
        if self.is_sign("("):
            got = self.try_pattern()
            if got:
                return got
            self.at += 1
            e = self.expr()
            self.need_sign(")")
            return Expr(e.op, e.args, self.text[t.start : self.toks[self.at - 1].end])
        if self.is_sign("["):
            return self.bracket()
        if self.sign("{"):
            items = []
            while not self.sign("}"):
                key = self.name() if self.tok.kind == "name" else self.tok.value
                if self.tok.kind == "string":
                    self.at += 1
                self.need_sign(":")
                items.append((key, self.expr()))
                if not self.is_sign("}"):
                    self.need_sign(",")
            return self.make(start, "map", tuple(items))
        if t.kind != "name":
            self.fail("an expression")
        if t.word in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return self.make(start, "lit", {"TRUE": True, "FALSE": False, "NULL": None}[t.word])
        if t.word == "CASE":
            return self.case()
        if t.word == "EXISTS" and self.is_sign("{", 1):
            return self.exists()
        if t.word in ("ALL", "ANY", "NONE", "SINGLE") and self.is_sign("(", 1) and self.peek(2).kind == "name" and self.peek(3).word == "IN":
            self.at += 2
            var = self.name()
            self.need("IN")
            e = self.expr()
            self.need("WHERE")
            cond = self.expr()
            self.need_sign(")")
            return self.make(start, "quantifier", t.word.lower(), var, e, cond)
        if t.word == "REDUCE" and self.is_sign("(", 1):
            self.at += 2
            acc = self.name()
            self.need_sign("=")
            first = self.expr()
            self.need_sign(",")
            var = self.name()
            self.need("IN")
            e = self.expr()
            self.need_sign("|")
            body = self.expr()
            self.need_sign(")")
            return self.make(start, "reduce", acc, first, var, e, body)
        n = 1
        while self.is_sign(".", n) and self.peek(n + 1).kind == "name":
            n += 2
        if self.is_sign("(", n):
            name = self.name()
            while self.sign("."):
                name += "." + self.name()
            self.need_sign("(")
            if self.is_sign("*") and self.is_sign(")", 1):
                self.at += 2
                return self.make(start, "call", name.lower(), (), "star")
            distinct, args = self.word("DISTINCT"), []
            while not self.sign(")"):
                args.append(self.expr())
                if not self.is_sign(")"):
                    self.need_sign(",")
            return self.make(start, "call", name.lower(), tuple(args), "distinct" if distinct else "")
        self.at += 1
        return self.make(start, "var", t.value)

    def case(self) -> Expr:
        start = self.at
        self.need("CASE")
        subject = None if self.tok.word == "WHEN" else self.expr()
        whens = []
        while self.word("WHEN"):
            cond = self.expr()
            self.need("THEN")
            whens.append((cond, self.expr()))
        other = self.expr() if self.word("ELSE") else None
        self.need("END")
        return self.make(start, "case", subject, tuple(whens), other)

    def exists(self) -> Expr:
        start = self.at
        self.need("EXISTS")
        self.need_sign("{")
        if self.tok.word in ("MATCH", "OPTIONAL", "UNWIND", "WITH", "FOR", "LET"):
            clauses = []
            while not self.is_sign("}"):
                clauses.append(self.clause())
                if clauses[-1].kind not in ("match", "filter", "unwind", "let", "with", "return"):
                    raise QueryError(f"{clauses[-1].kind.upper()} is not allowed in EXISTS")
        else:
            patterns = [self.path()]
            while self.sign(","):
                patterns.append(self.path())
            clauses = [Clause("match", {"patterns": patterns, "where": self.expr() if self.word("WHERE") else None, "optional": False, "mode": None})]
        self.need_sign("}")
        return self.make(start, "exists", tuple(clauses))

    def bracket(self) -> Expr:
        start = self.at
        self.need_sign("[")
        if self.tok.kind == "name" and self.peek().word == "IN":
            at = self.at
            var = self.name()
            self.need("IN")
            e = self.expr()
            if self.tok.word == "WHERE" or self.is_sign("|") or self.is_sign("]"):
                cond = self.expr() if self.word("WHERE") else None
                body = self.expr() if self.sign("|") else None
                self.need_sign("]")
                return self.make(start, "comprehension", var, e, cond, body)
            self.at = at
        if self.is_sign("(") or (self.tok.kind == "name" and self.is_sign("=", 1) and self.is_sign("(", 2)):
            at, hidden = self.at, self.hidden
            try:
                pattern = self.path()
                cond = self.expr() if self.word("WHERE") else None
                if len(pattern.parts) >= 3 and self.sign("|"):
                    body = self.expr()
                    self.need_sign("]")
                    return self.make(start, "pattern_comprehension", pattern, cond, body)
            except QueryError:
                pass
            self.at, self.hidden = at, hidden
        items = []
        while not self.sign("]"):
            items.append(self.expr())
            if not self.is_sign("]"):
                self.need_sign(",")
        return self.make(start, "list", tuple(items))


def parse(text: str) -> Query:
    """The syntax tree of a query."""
    return Parser(text).query()
