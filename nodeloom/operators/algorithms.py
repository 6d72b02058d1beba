"""Graph algorithms over nodes (id) and edges (src, dst), as iterated DataFrame joins.

Iterations write their state to the shared folder, so lineage stays short and a lost executor
costs one round at most. No node or edge is gathered on the driver; only counts and sums are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import forget, stored
from ..plans.tree import QueryError


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with 0, 1, ... in order of a unique key: ranges are counted, then numbered each on its own."""
    dealt = stored(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.expr("sum(_n) over (order by _part) - _n").alias("_before"))  # a row for each range
    own = F.expr(f"row_number() over (partition by _part order by `{key}`)") - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def simple(edges: DataFrame) -> DataFrame:
    """Undirected edges a < b, once each, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outDegree"))
    in_ = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inDegree"))
    both = nodes.select("id").join(out, "id", "left").join(in_, "id", "left").fillna(0, ["outDegree", "inDegree"])
    return both.withColumn("degree", F.col("outDegree") + F.col("inDegree"))


def levels(nodes: DataFrame, edges: DataFrame, source: int, targets: set[int] | None = None) -> list[DataFrame]:
    """Stored tables (id, distance, parent) of what ``source`` reaches, by distance; the parent is the smallest on a shortest path.

    Ends where the last of ``targets`` is reached, if they are given.
    """
    walk = stored(edges.select("src", "dst").distinct())
    out = [stored(nodes.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("distance"), F.lit(None).cast("long").alias("parent")))]
    seen, left = out[0].select("id"), None if targets is None else set(targets) - {source}
    while left is None or left:
        step = out[-1].join(walk, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = stored(step.join(seen, "id", "left_anti").select("id", F.lit(len(out)).cast("long").alias("distance"), "parent"))
        if front.isEmpty():
            forget(front)
            break
        out.append(front)
        if left is not None:
            left -= {r["id"] for r in front.where(F.col("id").isin(list(left))).select("id").collect()}
        now = stored(seen.union(front.select("id")))
        forget(seen)
        seen = now
    forget(walk)
    return out


def bfs(nodes: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """id, distance of what ``source`` reaches."""
    out, *more = levels(nodes, edges, source)
    for front in more:
        out = out.union(front)
    return out.select("id", "distance")


def shortest_paths(nodes: DataFrame, edges: DataFrame, source: int, targets: set[int]) -> dict[int, list[int]]:
    """Target -> ids of the nodes of a shortest path, of the targets that are reached: one search, and one job for each length of a path."""
    found, out = levels(nodes, edges, source, targets), {}
    for n, level in enumerate(found):
        rows = level.where(F.col("id").isin(list(targets))).select(F.col("id").alias("n0"), F.col("parent").alias("up"))  # a row for each target, at most
        for i, before in enumerate(reversed(found[:n]), 1):
            rows = F.broadcast(rows).join(before.select(F.col("id").alias(f"n{i}"), F.col("parent").alias("_up")), F.col("up") == F.col(f"n{i}")).drop("up").withColumnRenamed("_up", "up")
        out |= {r["n0"]: [r[f"n{i}"] for i in range(n, -1, -1)] for r in rows.drop("up").collect()}
    return out


def dfs(nodes: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """id, order: preorder, neighbours by ascending id. The order is sequential by nature: one task walks what is reachable."""
    reached = bfs(nodes, edges, source).select("id")
    inside = edges.select("src", "dst").distinct().join(reached, F.col("src") == F.col("id"), "left_semi")
    links = inside.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = {r.src: r.to for batch in batches for r in batch.itertuples()}
        seen, order, stack = {source}, [source], [iter(to.get(source, ()))]
        while stack:
            for x in stack[-1]:
                if x not in seen:
                    seen.add(x)
                    order.append(x)
                    stack.append(iter(to.get(x, ())))
                    break
            else:
                stack.pop()
        yield pd.DataFrame({"id": order, "order": range(len(order))})

    found = links.coalesce(1).mapInPandas(walk, "id long, `order` long")
    return found.join(nodes.select("id"), "id", "left_semi")


def dijkstra(nodes: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """id, cost, predecessor: relaxation of the edges (src, dst, weight) from those whose cost has just sunk."""
    bad = "weight is null or isnan(weight) or weight < 0 or weight = double('Infinity')"
    walk = stored(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.count_if(F.expr(bad)).alias("bad")))
    if not walk.where("bad > 0").isEmpty():
        raise QueryError("InvalidArgumentValue: weights must be finite numbers of 0 or more")
    walk = walk.drop("bad")
    best = stored(nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("predecessor")))
    front = best
    while True:
        tried = front.join(walk, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("c"), F.col("src").alias("p"))
        tried = tried.groupBy("id").agg(F.min(F.struct("c", "p")).alias("m")).select("id", "m.c", "m.p")
        both = best.join(tried, "id", "full")
        better = F.expr(f"id <> {source} and c is not null and (cost is null or c < cost or (c = cost and p < predecessor))")
        now = stored(both.select("id", F.when(better, F.col("c")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("p")).otherwise(F.col("predecessor")).alias("predecessor"), F.coalesce(better, F.lit(False)).alias("sunk")))
        front = now.where("sunk").select("id", "cost", "predecessor")
        best = now.select("id", "cost", "predecessor")
        if front.isEmpty():
            return best


def least_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, least: the smallest id of each node's weakly connected component, by star contraction."""
    links = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while True:
        ends = links.select(F.col("a").alias("x"), F.lit(1).alias("child")).unionAll(links.select("b", F.lit(0)))
        rough = ends.groupBy("x").agg(F.sum("child").alias("up"), F.min("child").alias("down")).where("up > 1 or (up = 1 and down = 0)")
        if rough.isEmpty():
            return nodes.select("id").join(links, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("least"))
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links, old = stored(small.union(least.select("a", "m")).distinct()), links
        forget(old)


def wcc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: 0, 1, ... in order of the smallest ids."""
    least = stored(least_ids(nodes, edges))
    names = numbered(least.select(F.col("least")).distinct(), "least", "component")
    return least.join(names, "least").select("id", "component")


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: strongly connected components, numbered by their smallest ids.

    Rounds of colouring: the largest id that reaches a node is its colour, and what reaches
    the colour's own node within the colour is its component; both are then taken out.
    """
    left = stored(nodes.select("id"))
    walk = stored(edges.where("src <> dst").select("src", "dst").distinct())
    done = []
    while not left.isEmpty():
        # Nodes without a way in or out are components of their own.
        inner = left.join(walk.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(walk.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        alone = stored(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("root")))
        if not alone.isEmpty():
            done.append(alone)
        else:
            colour = stored(left.select("id", F.col("id").alias("colour")))
            while True:
                sent = walk.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("colour").alias("c"))
                now = stored(colour.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") > F.col("colour")).alias("moved")))
                same = now.where("moved").isEmpty()
                forget(colour)
                colour = now.select("id", "colour")
                if same:
                    break
            within = stored(walk.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("x")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("y")), "dst").where("x = y").select("src", "dst"))
            front = stored(colour.where("id = colour").select("id", F.col("colour").alias("root")))
            found = front
            while True:
                back = within.join(front, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "root").distinct()
                front = stored(back.join(found.select("id"), "id", "left_anti"))
                if front.isEmpty():
                    break
                found = found.union(front)
            done.append(stored(found))
        left = stored(left.join(done[-1].select("id"), "id", "left_anti"))
        walk = stored(walk.join(done[-1].select(F.col("id").alias("src")), "src", "left_anti").join(done[-1].select(F.col("id").alias("dst")), "dst", "left_anti"))
    if not done:
        return nodes.select("id", F.lit(0).cast("long").alias("component"))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.union(d)
    least = all_.groupBy("root").agg(F.min("id").alias("least"))
    names = numbered(least, "least", "component")
    return all_.join(names, "root").select("id", "component")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """id, score: parallel edges count, dangling mass is spread evenly, the sum is 1."""
    if not 0 <= damping < 1 or tolerance < 0 or most < 0:
        raise QueryError("InvalidArgumentValue: damping lies in [0, 1), tolerance and rounds are 0 or more")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = stored(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    rank = stored(nodes.select("id", F.lit(1.0 / n).alias("score")).join(out.select(F.col("src").alias("id"), F.lit(False).alias("d")), "id", "left").select("id", "score", F.coalesce("d", F.lit(True)).alias("dangling")))
    for _ in range(int(most)):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        sent = links.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        now = stored(rank.join(sent, F.col("id") == F.col("dst"), "left").select("id", score.alias("score"), "dangling", F.abs(score - F.col("score")).alias("moved")))
        moved = now.agg(F.sum("moved")).first()[0]
        forget(rank)
        rank = now.select("id", "score", "dangling")
        if moved <= tolerance:
            break
    return rank.select("id", "score")


def triangles(edges: DataFrame) -> DataFrame:
    """a, b, c of each triangle. Edges run from the smaller degree to the larger, so no hub has many of its own."""
    pairs = stored(simple(edges))
    deg = pairs.select(F.col("a").alias("v")).unionAll(pairs.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.join(deg.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    first = F.expr("da < db or (da = db and a < b)")
    out = stored(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = out.join(out.select("u", F.col("v").alias("w")), "u").where("v < w")
    return wedges.join(pairs, (F.col("v") == F.col("a")) & (F.col("w") == F.col("b"))).select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("z"))


def triangle_count(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count(F.lit(1)).alias("triangleCount"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, coefficient: links between neighbours over the possible ones; 0 with fewer than two."""
    pairs = simple(edges)
    deg = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    t = triangles(edges)
    per = t.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    got = nodes.select("id").join(deg, "id", "left").join(per, "id", "left")
    return got.select("id", F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def kcore(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, core: each estimate becomes the h-index of the neighbours' until none moves; that is the core number."""
    pairs = simple(edges)
    links = stored(pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(pairs.select("b", "a")))
    core = stored(links.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("core")))
    while True:
        seen = links.join(core, F.col("w") == F.col("id")).select("v", F.col("core").alias("c"))
        # h-index without ordering a hub's neighbours: counts by estimate, then running sums from above.
        steps = seen.groupBy("v", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("at_least", F.expr("sum(n) over (partition by v order by c desc)"))
        h = steps.groupBy("v").agg(F.max(F.least("c", "at_least")).alias("h"))
        now = stored(core.join(h, F.col("id") == F.col("v")).select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")))
        still = now.where("moved").isEmpty()
        forget(core)
        core = now.select("id", "core")
        if still:
            return nodes.select("id").join(core, "id", "left").fillna(0, ["core"])


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, community: levels of local moves (half of the nodes at a time, by a hash) and coarsening."""
    pairs = simple(edges)
    links = stored(pairs.select(F.col("a").alias("v"), F.col("b").alias("w"), F.lit(1).cast("long").alias("n")).unionAll(pairs.select("b", "a", F.lit(1).cast("long"))))
    total = links.agg(F.sum("n")).first()[0] or 0
    names = stored(nodes.select("id", F.col("id").alias("community")))
    if not total:
        return numbered_communities(names)
    loops = names.select(F.col("community").alias("v"), F.lit(0).cast("long").alias("own"))
    while True:
        weight = links.groupBy("v").agg(F.sum("n").alias("k")).join(loops, "v", "full").select("v", (F.coalesce("k", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("k"))
        at = stored(weight.select("v", "k", F.col("v").alias("c")))
        any_move, quiet = False, 0
        for r in range(rounds):
            sizes = at.groupBy("c").agg(F.sum("k").alias("tot"))
            to = links.where("v <> w").join(at.select(F.col("v").alias("w"), F.col("c").alias("to")), "w").groupBy("v", "to").agg(F.sum("n").alias("inside"))
            own = at.select("v", F.col("c").alias("to"), F.lit(0).cast("long").alias("inside"))
            options = to.unionAll(own).groupBy("v", "to").agg(F.sum("inside").alias("inside")).join(at, "v").join(sizes.withColumnRenamed("c", "to"), "to")
            # Whole numbers: links to the community times the graph's, less what chance gives.
            gain = F.col("inside") * total - F.col("k") * (F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0))
            best = options.select("v", "c", "k", "to", gain.alias("gain")).groupBy("v", "c", "k").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("b"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay"))
            turn = F.pmod(F.xxhash64("v", F.lit(r // 2)), F.lit(2)) == r % 2
            moves = turn & (F.col("b.gain") > F.col("stay"))
            now = stored(best.select("v", "k", F.when(moves, -F.col("b.to")).otherwise(F.col("c")).alias("c"), moves.alias("moved")))
            moved = not now.where("moved").isEmpty()
            any_move, quiet = any_move or moved, 0 if moved else quiet + 1
            at = now.select("v", "k", "c")
            if quiet == 2:
                break
        if not any_move:
            return numbered_communities(names)
        names = stored(names.join(at, F.col("community") == F.col("v")).select("id", F.col("c").alias("community")))
        up = links.join(at.select("v", F.col("c").alias("cv")), "v").join(at.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w")
        inner = up.where("cv = cw").groupBy(F.col("cv").alias("v")).agg(F.sum("n").alias("i"))
        old = loops.join(at.select("v", "c"), "v").groupBy(F.col("c").alias("v")).agg(F.sum("own").alias("o"))
        loops = stored(old.join(inner, "v", "left").select("v", (F.col("o") + F.coalesce("i", F.lit(0))).alias("own")))
        links = stored(up.where("cv <> cw").groupBy(F.col("cv").alias("v"), F.col("cw").alias("w")).agg(F.sum("n").alias("n")))


def numbered_communities(names: DataFrame) -> DataFrame:
    least = names.groupBy("community").agg(F.min("id").alias("least"))
    return names.join(numbered(least, "least", "number"), "community").select("id", F.col("number").alias("community"))
