"""Syntax trees: expressions, patterns and clauses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A query that cannot be parsed, bound or run."""


@dataclass(frozen=True)
class Expr:
    """``op`` with ``args`` (expressions, names or values); ``text``: its source."""

    op: str
    args: tuple = ()
    text: str = ""

    def walk(self):
        yield self
        for a in self.args:
            for x in a if isinstance(a, (list, tuple)) else (a,):
                if isinstance(x, Expr):
                    yield from x.walk()
                elif isinstance(x, (list, tuple)):
                    for y in x:
                        if isinstance(y, Expr):
                            yield from y.walk()
                elif isinstance(x, PathPattern):
                    for part in x.parts:
                        for _, e in part.props:
                            yield from e.walk()


@dataclass
class NodePattern:
    var: str
    labels: list[str] = field(default_factory=list)
    props: list[tuple[str, Expr]] = field(default_factory=list)
    named: bool = True


@dataclass
class RelPattern:
    var: str
    types: list[str] = field(default_factory=list)
    props: list[tuple[str, Expr]] = field(default_factory=list)
    direction: str = "out"  # out, in, both
    lo: int | None = None  # None: a single relationship
    hi: int | None = None
    named: bool = True

    @property
    def variable(self) -> bool:
        return self.lo is not None


@dataclass
class PathPattern:
    parts: list  # node, relationship, node, ...
    var: str | None = None
    selector: str | None = None  # any, any_shortest, all_shortest, shortest, groups
    count: int = 1
    mode: str = "trail"  # trail, walk, acyclic

    @property
    def nodes(self) -> list[NodePattern]:
        return self.parts[::2]

    @property
    def rels(self) -> list[RelPattern]:
        return self.parts[1::2]


@dataclass
class Item:
    expr: Expr
    name: str


@dataclass
class Projection:
    items: list[Item]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)  # expression, descending
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None


@dataclass
class Clause:
    kind: str
    data: dict[str, Any]


@dataclass
class Query:
    branches: list[list[Clause]]
    union_all: bool = False
    project: str | None = None
    read_layers: list[str] | None = None
    write_layer: str | None = None
    at_time: Expr | None = None
