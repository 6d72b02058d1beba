"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of the document id, so that the number of a block
is a random permutation of the source's documents. A target is a number of whole passes over
the source and a rest; the rest is the first blocks in that order, found by descending the
block numbers ten bits at a time, and in the last block those documents that fill what is
left, the large ones first. All that gives each source an exact quota of blocks.

The tree deals these quotas among the output shards: a node draws from its quotas, by a
multivariate hypergeometric draw, as many blocks of each source as its left half of shards
gets, and leaves the others to the right half. A shard's quotas are disjoint ranges of the
permuted blocks of each source; within a shard, blocks and their documents are shuffled by
hashes. All draws follow from the seed, so a rerun gives the same mix.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, packed

BLOCK_DOCS = 64
MAX_UNITS = 10_000_000
MAX_SOURCES = 100_000
DIGIT = 10
#: Words of a shard, about, where no number of shards is given, and the least and greatest number then.
SHARD_WORDS, SHARDS = 50_000_000, (16, 16_384)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> dict[str | None, float]:
    """Shares of the whole size by weight, none above ``cap`` times its source's size.

    Sources are taken by code point, null last; the weights repeat. What a capped source
    cannot take is shared by weight among the others until none is above its cap.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, out, open_ = float(sum(sizes.values())), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            out |= share
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        rest = max(0.0, rest - sum(out[s] for s in over))
        open_ = [s for s in open_ if s not in out]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source each shard gets.

    Rows add up to ``quotas``; shards have equal numbers of blocks, or one more.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        n = int(left.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(left, n, method="marginals")
        split(lo, mid, draw)
        split(mid, hi, left - draw)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _name(column: str) -> Column:
    """An id as text that tells a null one from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _rests(sized: DataFrame, plan: DataFrame, bits: int) -> DataFrame:
    """plan with ``whole`` (blocks of the rest that are taken whole) and ``gap`` (words still to take)."""
    state = plan.withColumns({"whole": F.lit(0).cast("long"), "gap": F.col("rest")})
    for low in range((max(1, bits) - 1) // DIGIT * DIGIT, -1, -DIGIT):
        # Blocks that share the digits found so far, summed by their next digit.
        inside = sized.join(F.broadcast(state.select("source", "whole", "gap")), sized["source"].eqNullSafe(state["source"])).select(sized["source"], "block", "size", "whole", "gap")
        inside = inside.where(F.expr(f"block >= whole and shiftright(block, {low + DIGIT}) = shiftright(whole, {low + DIGIT})"))
        digits = inside.groupBy("source", F.expr(f"shiftright(block, {low})").alias("digit")).agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        # At most 2^DIGIT rows of a source: the last digit up to which all fits.
        before = F.expr("sum(words) over (partition by source order by digit)")
        fits = digits.withColumn("total", before).where("total <= gap").groupBy("source").agg(F.max("total").alias("took"), F.max("digit").alias("last"))
        fits = fits.select(F.col("source").alias("_s"), "took", "last")
        state = state.join(F.broadcast(fits), state["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
        # With empty digits in between, the next digit that holds something must be found: they take nothing.
        state = state.withColumns({"whole": F.coalesce((F.col("last") + 1) * (1 << low), "whole"), "gap": F.col("gap") - F.coalesce("took", F.lit(0))}).drop("took", "last")
        later = digits.select(F.col("source").alias("_s"), (F.col("digit") * (1 << low)).alias("_at"))
        nxt = state.join(later, state["source"].eqNullSafe(F.col("_s")) & (F.col("_at") >= F.col("whole"))).groupBy(state["source"].alias("_s")).agg(F.min("_at").alias("_at"))
        state = cut(state.join(F.broadcast(nxt), state["source"].eqNullSafe(F.col("_s")), "left").withColumn("whole", F.coalesce("_at", "whole")).drop("_s", "_at"))
    return state


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None,
    weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, shards: int | None = None, seed: int = 17,
) -> DataFrame:
    """Each row of ``docs`` with its share of the mix.

    Returns ``row`` (struct of the columns ``carry``, all by default), ``size`` (words of the
    text, 0 for null), ``source_size``, ``target`` (of its source), ``shards`` (the shard of
    each copy that the mix takes, at most ``cap`` of them, an empty list if none), ``block`` and
    ``spot`` (order within a shard: by block, then spot). A null source is a source. Rows with
    equal ids and sources are taken together; a null id and an empty one are two ids. Sources
    without words have target 0. An empty table gives an empty result. Texts are read once for
    their sizes; (id, source, size) is written and read from then on. At most MAX_SOURCES
    sources, else an error: their plan is made on the driver, a row each. Without a number of
    shards there is one for SHARD_WORDS words, within the bounds of SHARDS.
    """
    if cap != int(cap) or cap < 1:
        raise ValueError("cap must be a whole number of passes")
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    light = carry is not None and text_col not in carry  # the rows themselves are as short as their sizes
    keys = [docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size")]
    rows = cut(docs.select(*keys, *([packed(docs, carry).alias("row")] if light else [])), result=light)
    stats = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    if shards is None:
        shards = min(SHARDS[1], max(SHARDS[0], -(-sum(r["words"] for r in stats) // SHARD_WORDS)))
    goal = targets({r["source"]: r["words"] for r in stats}, weights, cap)
    a_block = max(BLOCK_DOCS, math.ceil(sum(r["docs"] for r in stats) / MAX_UNITS))
    plan = []
    for r in stats:
        blocks = 1 << max(0, math.ceil(math.log2(r["docs"] / a_block)))
        passes = min(int(cap), int(goal[r["source"]] // r["words"])) if r["words"] else 0
        plan.append((r["source"], r["words"], goal[r["source"]], blocks, passes, goal[r["source"]] - passes * r["words"]))
    bits = max([1, *(p[3].bit_length() for p in plan)])
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, blocks long, passes long, rest double")
    plan_at = F.broadcast(plan.select(F.col("source").alias("_s"), "source_size", "target", "blocks", "passes"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(plan_at, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("block", F.pmod(_hash(seed, _name("id")), F.col("blocks")))

    sized = dealt(rows).select("id", "source", "size", "block")
    state = _rests(sized, plan, bits)
    # The last block of each source, about BLOCK_DOCS ids: fill the gap, large ones first.
    edge = sized.join(F.broadcast(state.select(F.col("source").alias("_s"), "whole", "gap")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("whole")))
    units = edge.groupBy("source", _name("id").alias("id")).agg(F.sum("size").alias("size"), F.first("gap").alias("gap"))
    listed = units.groupBy("source").agg(F.max("gap").alias("gap"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("n"), _hash(seed + 1, F.col("id")).alias("h"), "id"))).alias("all"))
    filled = F.expr("""aggregate(all, struct(gap as left, cast(array() as array<string>) as got), (acc, x) -> CASE
        WHEN -x.n <= acc.left AND x.n < 0 THEN struct(acc.left + x.n as left, array_append(acc.got, x.id) as got) ELSE acc END).got""")
    extra = listed.select("source", F.explode(filled).alias("id"), F.lit(1).alias("extra"))
    extra = cut(extra, result=True)
    # Quotas in blocks; the one that is taken in part counts as one.
    rows_of = {r["source"]: r for r in state.collect()}
    parts = {r["source"] for r in extra.select("source").distinct().collect()}
    order = [rows_of[r["source"]] for r in stats]
    quotas = np.array([r["passes"] * r["blocks"] + r["whole"] + (r["source"] in parts) for r in order], np.int64)
    ends = np.cumsum(split_tree(quotas, shards, seed), axis=0).T if len(order) else np.zeros((0, shards))
    ranges = spark.createDataFrame([(r["source"], r["whole"], e.tolist()) for r, e in zip(order, ends, strict=True)], "_s string, whole long, ends array<long>")
    drop_cut(state)

    base = rows if light else docs.select(packed(docs, carry).alias("row"), *keys)
    base = dealt(base).join(F.broadcast(ranges), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    extra = extra.select(F.col("source").alias("_s"), F.col("id").alias("_i"), "extra")
    base = base.join(F.broadcast(extra), F.col("source").eqNullSafe(F.col("_s")) & (_name("id") == F.col("_i")) & (F.col("block") == F.col("whole")), "left")
    more = ((F.col("block") < F.col("whole")) | F.col("extra").isNotNull()).cast("long")
    copies = F.when(F.col("source_size") > 0, F.least(F.col("passes") + more, F.lit(int(cap)))).otherwise(F.lit(0)).cast("int")
    dealt_to = F.expr("CASE WHEN copies = 0 THEN cast(array() as array<int>) ELSE transform(sequence(0, copies - 1), c -> size(filter(ends, e -> e <= c * blocks + block))) END")
    out = base.withColumn("copies", copies).withColumn("shards", dealt_to)
    if not light:
        drop_cut(rows)
    out = out.select("row", "id", "source", "size", "source_size", "target", "shards", _hash(seed + 2, F.col("block"), F.col("source")).alias("block"), _hash(seed + 3, _name("id")).alias("spot"))
    out.shard_count = shards
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, **options) -> DataFrame:
    """The mix: a row for each copy taken, with its ``_shard``, a partition for each shard, in the shuffled order."""
    plan = mix_plan(docs, id_col, text_col, source_col, shards=shards, **options)
    plan = plan.withColumn("_shard", F.explode("shards")).repartitionById(plan.shard_count, F.col("_shard")).sortWithinPartitions("_shard", "block", "spot")
    return plan.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "_shard")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, shard by shard in the shuffled order, with their own columns only."""
    return mixed(docs, id_col, text_col, source_col, **options).select(*docs.columns)


def op6_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the shards of its copies."""
    plan = mix_plan(docs, carry=["doc_id"])
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
