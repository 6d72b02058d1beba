"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. Each text becomes its set of k-word shingles, a digest of that set and a SuperMinHash
   signature cut into bands. Documents with equal sets collapse to the smallest id.
2. Representatives that share a band are candidates. No bucket is ever expanded into its
   pairs: each bucket gets a centre (its smallest id), and each member meets the one centre
   with which it shares the most bands. A bucket of two is its one pair, which is compared too
   if its ends are not in one component by then.
3. Candidate pairs are confirmed on the full sets, recomputed from the whole texts, and
   confirmed links are merged by union-find.
4. Buckets that are not within one component then (copies of copies, candidates that are not
   near enough) are settled exactly. Their members are bucketed again by the prefix filter:
   in one order of all shingles, rare ones first, two sets that are near enough share one of
   the first few, how few depending on both sizes. A set with many shingles of its own shares
   none and drops out. In each such bucket the texts with the fewest rarer shingles are
   centres that the members in other components meet; what is left outside the bucket's
   largest component then meets all members in other components, but for pairs that the
   place of the shared shingle already rules out. Nothing is capped; no link between components is lost.

With 32 bands of 5 places a pair of similarity 0.8 shares no band with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, attach, cut, drop_cut, give_back, hot_keys, packed, scratch, small_batches
from .textops import as_sets, band_keys, blocks, mix, overlaps, set_digests, shingle_sets, shingles, super_min_hash, word_hashes, words
from .union_find import components

BANDS, ROWS = 32, 5
#: Cells of the sketch that orders shingles; ratio of the sizes in a class.
SKETCH, CLASS = 1 << 20, 1.05
#: Centres of a bucket in the rounds before the last.
STARS = (1, 4)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n (set size), d1 and d2 (digest of the set), bands (keys; empty for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, at in blocks(batch.column(1)):
                doc, start, end = words(data, at)
                of, got = as_sets(*shingles(doc, word_hashes(data, start, end), n, k))
                size = np.bincount(of, minlength=n)
                one, two = set_digests(of, got, n)
                keys = band_keys(super_min_hash(of, got, n, bands * rows), bands, rows)
                full = size > 0
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(first, n), "n": pa.array(size.astype(np.int64)), "d1": pa.array(one.view(np.int64)),
                    "d2": pa.array(two.view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel().view(np.int64))),
                })
        give_back()

    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return plain.mapInArrow(sign, "id long, n long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least ``percent`` in common."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            while i < len(batch):  # about 2 MB of text at a time
                j = min(len(batch), i + 256)
                while j > i + 1 and batch.slice(i, j - i).get_total_buffer_size() > 1 << 21:
                    j = i + (j - i) // 2
                part = batch.slice(i, j - i)
                both, either = overlaps([part.column(2), part.column(3)], k)
                good = pa.array((100 * both >= percent * either) & (both > 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(good)
                i = j
        give_back()

    sides = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return sides.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, carry: list[str] | None = None, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Each row of ``docs`` with its class of near-duplicate documents.

    Returns ``row`` (struct of the columns ``carry``, all by default), ``id``,
    ``n_shingles``, ``component_id`` (smallest id reachable over links of at least
    ``percent`` similarity of k-word shingle sets) and ``kept`` (id = component_id). Null and
    empty texts have no shingles and are linked with nothing; so are rows whose id is null,
    of which component_id is null and kept is true. Rows that repeat an id are one node (of several
    texts, the greatest is compared). An
    empty table gives an empty result; extra columns travel inside ``row`` only.
    """
    small_batches(docs.sparkSession)
    with scratch():
        ids = cut(_classes(docs, id_col, text_col, k, percent, bands, rows), result=True)
    if carry == [id_col]:
        out = ids.select(F.struct(F.col("id").alias(id_col)).alias("row"), "*")
    else:
        one = ids.where("id is not null").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
        out = docs.select(packed(docs, carry).alias("row"), docs[id_col].cast("long").alias("id")).join(one, "id", "left").select("row", "id", "n_shingles", "component_id")
    return out.select("row", "id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, component_id of each row."""
    sig = cut(signatures(docs, id_col, text_col, k, bands, rows))
    live = sig.where("n > 0 and id is not null")
    reps = live.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    keyed = cut(live.join(reps.select(F.col("rep").alias("id"), "d1", "d2", "n"), ["id", "d1", "d2", "n"], "left_semi").select("id", "bands"))
    keyed = keyed.select("id", F.explode("bands").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).where("centre < hi").drop("hi"))
    crowded = cut(buckets.where(F.col("n") * HOT_KEYS > (buckets.agg(F.sum("n")).first()[0] or 0)).select("key"))
    members = cut(attach(keyed, buckets.select("key", "centre"), ["key"], crowded, "inner").select("key", "id", "centre").distinct())
    shared = members.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("bands"))
    best = shared.groupBy("id").agg(F.max(F.struct("bands", (-F.col("centre")).alias("c"))).alias("best"))
    pairs = cut(best.select((-F.col("best.c")).alias("a"), F.col("id").alias("b")))
    candidates = members.select("id").distinct()
    texts = cut(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).join(candidates, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
    comp = _linked(members, pairs, texts, crowded, k, percent)

    named = reps.join(comp, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"), "rep", "size")
    named = cut(named.where("size > 1 or component <> rep").select("d1", "d2", "n", "component"))
    hot = cut(hot_keys(live, ["d1", "d2", "n"], sig.count()))
    ids = attach(sig.select("id", "n", "d1", "d2"), named, ["d1", "d2", "n"], hot)
    return ids.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"))


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS) + 1e-9).astype(np.int64)


def _class_start(c: np.ndarray) -> np.ndarray:
    """A lower bound of the sizes in a class."""
    return np.maximum(1, np.floor(CLASS**c - 1e-6)).astype(np.int64)


def prefix_buckets(texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, id): two texts with ``percent`` similarity or more share a key. And the keys with more than 1/HOT_KEYS of the rows.

    Shingles are ordered by how often they occur in ``texts``, as counted in a sketch of SKETCH
    cells (which may only put a shingle later than it deserves), then by hash. A set of size n
    and one of size s that are near enough share at least t = percent (n + s) / (100 + percent)
    shingles, so one of the first n - t + 1 of the one is one of the first s - t + 1 of the
    other. Keys hold a shingle and the two classes of sizes. Keys of one text, or of texts of
    one class where two are asked for, are left out. ``n`` and ``rank`` are the set's size
    and how many of its shingles come before this one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, _, got in shingle_sets(batch.column(1), k):
                cells += np.bincount((got % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(cells[full])], ["cell", "n"])

    counted = texts.select("id", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SKETCH, np.int64)
    sketch[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    often = texts.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, n_docs, docs, got in shingle_sets(batch.column(1), k):
                seen = often.value[(got % np.uint64(SKETCH)).astype(np.int64)]
                order = np.lexsort((got, seen, docs))
                docs, got, seen = docs[order], got[order], seen[order]
                n = np.bincount(docs, minlength=n_docs)
                rank = np.arange(len(docs)) - (np.cumsum(n) - n)[docs]
                single = np.bincount(docs[seen == 1], minlength=n_docs)  # certainly in no other text
                own, least, most = _size_class(n), -(-percent * n // 100), n * 100 // percent
                low, high = _size_class(least), _size_class(most)
                for step in range(-int((own - low).max(initial=0)), int((high - own).max(initial=0)) + 1):
                    other = own + step
                    s = np.maximum(_class_start(other), least)
                    t = -(-percent * (n + s) // (100 + percent))
                    prefix = np.where((other >= low) & (other <= high) & (n - single >= t), n - t + 1, 0)
                    take = (rank < prefix[docs]) & (seen > 1)
                    of = docs[take]
                    lo, hi = np.minimum(own, other)[of], np.maximum(own, other)[of]
                    key = mix(got[take] + mix((lo * 4096 + hi).astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[first + of]), pa.array(np.full(len(of), np.sign(step), np.int32)), pa.array(n[of].astype(np.int32)), pa.array(rank[take].astype(np.int32))], ["key", "id", "side", "n", "rank"])
        give_back()

    keys = texts.select("id", "text").mapInArrow(emit, "key long, id long, side int, n int, rank int")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("side").alias("small"), F.max("side").alias("large"), F.count(F.lit(1)).alias("c"))
    shared = cut(shared.where("lo < hi and (small < large or small = 0)").select("key", "c"))
    crowded = cut(shared.where(F.col("c") * HOT_KEYS > (shared.agg(F.sum("c")).first()[0] or 0)).select("key"))
    return attach(keys, shared.select("key"), ["key"], crowded, "left_semi").select("key", "id", "n", "rank"), crowded


def _open(placed: DataFrame) -> DataFrame:
    """Keys of buckets (key, id, component) that are not within one component."""
    return placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")


def _placed(members: DataFrame, comp: DataFrame) -> DataFrame:
    return members.join(comp, members["id"] == comp["node"], "left").select(*members.columns, F.coalesce("component", "id").alias("component"))


def _pairs(centres: DataFrame, members: DataFrame, percent: int, meet: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pairs in different components that the place of a shared shingle does not rule out.

    The first shingle that two sets share is followed by all others that they share, so these
    are no more than what is left of either set there.
    """
    side = centres.select("key", F.col("id").alias("centre"), F.col("component").alias("of"), F.col("n").alias("cn"), F.col("rank").alias("cr"))
    possible = F.expr(f"component <> of and least(n - rank, cn - cr) * {100 + percent}L >= {percent}L * (n + cn)")
    return meet(members, side).where(possible).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _linked(members: DataFrame, pairs: DataFrame, texts: DataFrame, crowded: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) over all links among the members of each bucket."""
    comp = cut(components(verified(pairs, texts, k, percent)))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    # The only pair of a bucket of two is compared here, unless its centre was the one that the member met.
    two = members.where("id <> centre").join(sizes.where("size = 2").select("key"), "key", "left_semi").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    more = cut(_apart(two.join(pairs, ["a", "b"], "left_anti"), comp))
    pairs = pairs.union(more)
    comp = _merged(verified(more, texts, k, percent), comp)
    large = sizes.where("size > 2").select("key")
    placed = cut(_placed(attach(members.select("key", "id"), large, ["key"], crowded, "left_semi"), comp))
    doubtful = cut(attach(placed, _open(placed), ["key"], crowded, "left_semi").select("id").distinct())
    drop_cut(placed)
    if doubtful.isEmpty():
        return comp
    left, crowded = prefix_buckets(cut(texts.join(doubtful, "id", "left_semi")), k, percent)
    left, tested = cut(left), pairs
    for ways in (*STARS, 0):
        placed = _placed(left.select("key", "id", "n", "rank"), comp)
        now = cut(attach(placed, _open(placed), ["key"], crowded, "left_semi"))
        drop_cut(left)
        left = now
        if left.isEmpty():
            break
        if ways:
            way = F.pmod(F.xxhash64("id", F.lit(ways)), F.lit(ways)).alias("way")
            centres = left.groupBy("key", way).agg(F.min(F.struct("rank", "id", "n", "component")).alias("c")).select("key", "c.*")
            meet = lambda rows, side: attach(rows, side, ["key"], crowded, "inner")  # noqa: E731 - a row for each way at most
        else:
            most = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"))
            centres = attach(left, most.select("key", F.col("most.component").alias("main")), ["key"], crowded, "inner").where("component <> main").drop("main")
            meet = lambda rows, side: rows.join(side, "key")  # noqa: E731 - many rows on both sides: left to adaptive execution
        more = cut(_pairs(centres, left, percent, meet).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(more)
        comp = _merged(verified(more, texts, k, percent), comp)
    return comp


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    placed = pairs
    for side in ("a", "b"):
        placed = placed.join(comp.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    return placed.where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")


def _merged(links: DataFrame, comp: DataFrame) -> DataFrame:
    """``comp`` with the components joined that ``links`` connect."""
    found = cut(links)
    if found.isEmpty():
        return comp
    joined = components(_between(found, comp))
    grown = comp.join(joined.withColumnRenamed("component", "to").withColumnRenamed("node", "component"), "component", "left")
    grown = grown.select("node", F.coalesce("to", "component").alias("component"))
    out = cut(grown.union(joined.join(comp, "node", "left_anti")))
    drop_cut(comp)
    return out


def _between(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links of nodes as links of the components that they are in."""
    for side in ("a", "b"):
        got = comp.select(F.col("node").alias(side), F.col("component").alias("_to"))
        links = links.join(got, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    return links.select("a", "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their own columns only."""
    kept = near_groups(docs, id_col, text_col, k, percent).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, on 4-word shingles at 80 %."""
    got = near_groups(docs, k=4, percent=80, carry=["doc_id"])
    return got.select("row.doc_id", "n_shingles", "component_id", "kept")
