"""The property graph: typed node and relationship tables, layers, catalog. Immutable; writes make new ones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVED, KNOWLEDGE, WORKSPACE = 0, 1, 2
LAYERS = {"OBSERVED": OBSERVED, "KNOWLEDGE": KNOWLEDGE, "WORKSPACE": WORKSPACE}
DEFAULT_LAYERS = (OBSERVED, KNOWLEDGE)
#: Columns that are no properties.
NODE_SYSTEM = ("id", "layer", "revision", "labels")
REL_SYSTEM = ("id", "src", "dst", "layer", "revision")
SYSTEM = {*NODE_SYSTEM, *REL_SYSTEM, "type"}


def column_of(prop: str) -> str:
    """The column of a property: its name, with a dot in front if a system column has that name."""
    return f".{prop}" if prop in SYSTEM else prop


def prop_of(column: str) -> str:
    return column.removeprefix(".")


def widened(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, other numbers as DOUBLE: the two number types of the graph."""
    out = []
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) and f.name != "layer":
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class NodeTable:
    """Nodes that all carry ``labels``; a column ``labels`` lists further ones. Column ``id`` is unique in the graph."""

    labels: frozenset[str]
    df: DataFrame

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in NODE_SYSTEM}

    @property
    def dynamic(self) -> bool:
        return "labels" in self.df.columns


@dataclass(frozen=True)
class RelTable:
    """Relationships of one type: ``id``, ``src``, ``dst`` and properties.

    ``ends``: the labels that all sources and all targets carry, if that is known; scans of
    such nodes whose properties nobody asks for are left out of plans.
    """

    type: str
    df: DataFrame
    ends: tuple[str | None, str | None] = (None, None)

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in REL_SYSTEM}


@dataclass(frozen=True)
class Graph:
    """A named graph. ``samples``: (kind, label or type, property) -> temporal samples (entity, time, seq, value)."""

    spark: SparkSession
    nodes: tuple[NodeTable, ...] = ()
    rels: tuple[RelTable, ...] = ()
    layers: tuple[int, ...] = DEFAULT_LAYERS
    samples: dict = field(default_factory=dict)
    indexes: dict = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)
    rollups: dict = field(default_factory=dict)
    procedures: dict = field(default_factory=dict)
    name: str = "graph"

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def visible(self, df: DataFrame) -> DataFrame:
        """The rows of the layers that are read; tables without a layer are OBSERVED."""
        if "layer" in df.columns:
            return df.where(F.col("layer").isin(*self.layers))
        return df if OBSERVED in self.layers else df.where(F.lit(False))

    def node_scan(self, labels: list[str] | tuple = ()) -> DataFrame:
        """id, labels and all properties of visible nodes that carry all labels; absent properties are null."""
        want, parts, props = set(labels), [], {}
        for t in self.nodes:
            if want <= t.labels or t.dynamic:
                parts.append(t)
                for k, v in t.props.items():
                    if props.setdefault(k, v) != v:
                        props[k] = _common(props[k], v)
        out = None
        for t in parts:
            df = self.visible(t.df)
            own = F.array(*[F.lit(x) for x in sorted(t.labels)]).cast("array<string>")
            all_ = F.array_union(own, F.coalesce(F.col("labels"), F.array().cast("array<string>"))) if t.dynamic else own
            for label in sorted(want - t.labels):
                df = df.where(F.array_contains("labels", label))
            have = t.props
            cols = [(F.col(f"`{k}`").cast(v) if k in have else F.lit(None).cast(v)).alias(k) for k, v in props.items()]
            df = df.select("id", all_.alias("labels"), (F.col("revision") if "revision" in t.df.columns else F.lit(1).cast("long")).alias("revision"), *cols)
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.createDataFrame([], "id long, labels array<string>, revision long")
        return out

    def rel_scan(self, types: list[str] | tuple = ()) -> DataFrame:
        """id, src, dst, type and all properties of visible relationships of any of the types (all, if none)."""
        parts = [t for t in self.rels if not types or t.type in types]
        props: dict[str, T.DataType] = {}
        for t in parts:
            for k, v in t.props.items():
                if props.setdefault(k, v) != v:
                    props[k] = _common(props[k], v)
        out = None
        for t in parts:
            have = t.props
            cols = [(F.col(f"`{k}`").cast(v) if k in have else F.lit(None).cast(v)).alias(k) for k, v in props.items()]
            df = self.visible(t.df).select("id", "src", "dst", F.lit(t.type).alias("type"), (F.col("revision") if "revision" in t.df.columns else F.lit(1).cast("long")).alias("revision"), *cols)
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], "id long, src long, dst long, type string, revision long")

    def edges(self) -> DataFrame:
        """src, dst of all visible relationships between visible nodes, with id and weights as found."""
        return self.rel_scan().select("id", "src", "dst")

    def ends(self, types: list[str], side: int) -> str | None:
        """The label of all sources (0) or targets (1) of these types, if one is declared for each."""
        found = {t.ends[side] for t in self.rels if not types or t.type in types}
        return found.pop() if len(found) == 1 else None

    # Entry points; the work is done elsewhere.

    def cypher(self, text: str, **params) -> DataFrame:
        """The rows of a reading query."""
        from .plans.compiler import run

        return run(self, text, params).rows

    def execute(self, text: str, **params):
        """The result of any query: rows, the graph after it, and counts of changes."""
        from .plans.compiler import run

        return run(self, text, params)


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    raise ValueError(f"a property holds {a.simpleString()} and {b.simpleString()}")
