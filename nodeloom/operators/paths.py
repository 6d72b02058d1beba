"""Variable-length expansion: bounded and unbounded, trails, walks, acyclic and shortest paths, reachability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import stored
from ..plans.tree import QueryError

#: Hops after which an expansion without an upper bound is refused rather than cut short.
MOST_HOPS = 64


@dataclass
class Expansion:
    lo: int
    hi: int | None
    mode: str = "trail"
    selector: str | None = None
    count: int = 1
    endpoints_only: bool = False
    nodes: DataFrame | None = None  # (id, node): structs to collect on the way


def _c(name: str):
    return F.col(f"`{name}`")


def expand(rows: DataFrame, start: str, edges: DataFrame, x: Expansion) -> DataFrame:
    """``rows`` joined with the paths that leave the node in column ``start``.

    ``edges``: near, far and, unless only endpoints are asked for, id and ``rel`` (struct). Adds ``_end`` (last node), ``_len``, and,
    unless only endpoints are asked for, ``_ids`` and ``_rels`` (of the relationships) and
    ``_nodes`` (structs of the nodes after the first, if ``x.nodes`` is given).
    """
    keys = rows.columns
    if x.hi is not None and x.hi < x.lo:
        return rows.limit(0).withColumns({"_end": _c(start), "_len": F.lit(0)} if x.endpoints_only else _zero(start, edges, x)).limit(0)
    shortest = x.selector in ("any_shortest", "all_shortest", "any") or (x.selector in ("shortest", "groups") and x.count == 1)
    one = x.selector in ("any_shortest", "any") or (x.selector == "shortest" and x.count == 1)
    front = rows.withColumns({"_end": _c(start), "_len": F.lit(0)} if x.endpoints_only else _zero(start, edges, x))
    found = [front] if x.lo == 0 else []
    seen = front.select(*map(_c, keys), "_end") if (shortest and x.lo <= 1) else None
    if seen is not None and x.lo == 1:
        seen = None  # the start itself may be reached again
    hop, bounded = 0, x.hi is not None
    if not bounded or x.hi > 1:
        edges = stored(edges)  # read by each hop, computed once
    walked = edges.select(*[F.col(c).alias(f"_e_{c}") for c in edges.columns])
    while hop < (x.hi if bounded else MOST_HOPS):
        hop += 1
        step = front.join(walked, F.col("_end") == F.col("_e_near"))
        if not x.endpoints_only:
            if x.mode == "trail":
                step = step.where(~F.array_contains("_ids", F.col("_e_id")))
            elif x.mode == "acyclic":
                step = step.where(~F.array_contains("_nids", F.col("_e_far")))
        new = {"_end": F.col("_e_far"), "_len": F.lit(hop)}
        if not x.endpoints_only:
            new |= {"_ids": F.array_append("_ids", F.col("_e_id")), "_rels": F.array_append("_rels", F.col("_e_rel")), "_nids": F.array_append("_nids", F.col("_e_far"))}
            if x.nodes is not None:
                step = step.join(x.nodes.select(F.col("id").alias("_n_id"), F.col("node").alias("_n_node")), F.col("_e_far") == F.col("_n_id"))
                new["_nodes"] = F.array_append("_nodes", F.col("_n_node"))
        front = step.withColumns(new).select(*map(_c, keys), *map(_c, new))
        if x.endpoints_only:
            front = front.distinct()
        if shortest and x.lo <= 1:
            if one:
                order = F.struct("_ids") if not x.endpoints_only else F.col("_end")
                front = front.withColumn("_rn", F.row_number().over(Window.partitionBy(*map(_c, keys), F.col("_end")).orderBy(order))).where("_rn = 1").drop("_rn")
            if seen is not None:
                front = _unseen(front, seen, keys)
        if not bounded or (seen is not None and hop > 1):
            front = stored(front)
        if hop >= x.lo:
            found.append(front)
        if shortest and x.lo <= 1:
            now = front.select(*map(_c, keys), "_end").distinct()
            seen = now if seen is None else seen.union(now)
        elif x.endpoints_only and not bounded:
            now = front.select(*map(_c, keys), "_end")
            front = _unseen(front, seen, keys) if seen is not None else front
            seen = now if seen is None else seen.union(now)
        if not bounded and front.isEmpty():
            break
    else:
        if not bounded:
            raise QueryError(f"the expansion goes on after {MOST_HOPS} hops: give it an upper bound")
    out = found[0] if found else rows.limit(0).withColumns({"_end": _c(start), "_len": F.lit(0)} if x.endpoints_only else _zero(start, edges, x))
    for f in found[1:]:
        out = out.unionByName(f)
    if x.endpoints_only:
        return out.groupBy(*map(_c, keys), F.col("_end")).agg(F.min("_len").alias("_len"))
    return out


def select_paths(paths: DataFrame, keys: list[str], x: Expansion) -> DataFrame:
    """Of the paths of each row of ``keys`` and end node, those that the selector wants."""
    if x.selector is None:
        return paths
    over = Window.partitionBy(*map(_c, keys), F.col("_end")).orderBy("_len", "_ids")
    by_length = Window.partitionBy(*map(_c, keys), F.col("_end")).orderBy("_len")
    if x.selector in ("any", "any_shortest"):
        return paths.withColumn("_rn", F.row_number().over(over)).where("_rn = 1").drop("_rn")
    if x.selector == "all_shortest":
        return paths.withColumn("_rn", F.rank().over(by_length)).where("_rn = 1").drop("_rn")
    if x.selector == "groups":
        return paths.withColumn("_rn", F.dense_rank().over(by_length)).where(F.col("_rn") <= x.count).drop("_rn")
    return paths.withColumn("_rn", F.row_number().over(over)).where(F.col("_rn") <= x.count).drop("_rn")


def _zero(start: str, edges: DataFrame, x: Expansion) -> dict:
    rel = edges.schema["rel"].dataType.simpleString()
    out = {"_end": _c(start), "_len": F.lit(0), "_ids": F.array().cast("array<bigint>"), "_rels": F.expr(f"cast(array() as array<{rel}>)"), "_nids": F.array(_c(start))}
    if x.nodes is not None:
        out["_nodes"] = F.expr(f"cast(array() as array<{x.nodes.schema['node'].dataType.simpleString()}>)")
    return out


def _unseen(front: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    old = seen.select(*[_c(k).alias(f"_s_{i}") for i, k in enumerate(keys)], F.col("_end").alias("_s_end"))
    same = F.col("_end") == F.col("_s_end")
    for i, k in enumerate(keys):
        same = same & _c(k).eqNullSafe(F.col(f"_s_{i}"))
    return front.join(old, same, "left_anti")
