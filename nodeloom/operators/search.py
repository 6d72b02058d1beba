"""SEARCH: exact, prefix, quantised, adaptive vector search; text search; hybrid by reciprocal ranks."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Clause, QueryError
from ..plans.values import DOUBLE

#: Rank offset of reciprocal rank fusion; BM25's saturation and length weight.
RRF, K1, B = 60, 1.2, 0.75
OVERSAMPLE = 8


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def similarity(a: Column, b: Column, measure: str) -> Column:
    """COSINE and DOT: higher is better; EUCLIDEAN: the distance."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    if measure == "dot":
        return dot
    if measure == "euclidean":
        return F.sqrt(_sum(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))
    norm = F.sqrt(_sum(F.transform(x, lambda p: p * p))) * F.sqrt(_sum(F.transform(y, lambda p: p * p)))
    return dot / F.when(norm == 0, F.lit(None)).otherwise(norm)


def _best(df: DataFrame, score: Column, limit: int, measure: str) -> DataFrame:
    order = score.asc_nulls_last() if measure == "euclidean" else score.desc_nulls_last()
    return df.orderBy(order, F.col("id").asc()).limit(limit)


def vector_search(items: DataFrame, query: list[float], limit: int, measure: str = "cosine", method: str = "exact", candidates: int | None = None) -> DataFrame:
    """id, score of the best ``limit`` of items (id, vector); ties by ascending id.

    ``prefix`` and ``quantized`` choose candidates by the first dimensions, or by the signs after
    a seeded rotation, and score these fully; ``adaptive`` scores all if there are few.
    """
    measure, method = measure.lower(), (method or "exact").lower()
    if method not in ("exact", "prefix", "quantized", "adaptive"):
        raise QueryError(f"no search method {method}")
    if any(not np.isfinite(x) for x in query):
        raise QueryError("InvalidArgumentValue: a query vector has finite components")
    items = items.where(F.col("vector").isNotNull() & (F.size("vector") == len(query)))
    n = candidates or OVERSAMPLE * limit
    if method == "adaptive":
        method = "exact" if items.limit(2 * max(n, limit) + 1).count() <= 2 * max(n, limit) else "quantized"
    q = F.array(*[F.lit(float(x)) for x in query])
    if method == "prefix":
        d = max(1, len(query) // 4)
        items = _best(items, similarity(F.slice("vector", 1, d), F.slice(q, 1, d), measure), n, measure)
    elif method == "quantized":
        spin = np.linalg.qr(np.random.default_rng(7).normal(size=(len(query), len(query))))[0]
        want = (np.asarray(query) @ spin > 0).tolist()
        differ = reduce(lambda a, b: a + b, [((_sum(F.zip_with(F.col("vector").cast("array<double>"), F.array(*[F.lit(float(x)) for x in spin[:, j]]), lambda p, r: p * r)) > 0) != F.lit(want[j])).cast("int") for j in range(len(query))])
        items = items.orderBy(differ.asc(), F.col("id").asc()).limit(n)
    return _best(items.withColumn("score", similarity(F.col("vector"), q, measure)), F.col("score"), limit, measure).select("id", "score")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of the text in compatibility form (NFKC), as those of a query."""
    wide = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.filter(F.split(F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), wide).otherwise(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    import re
    import unicodedata

    return sorted({t for t in re.split(r"[\W_]+", unicodedata.normalize("NFKC", text).lower()) if t})


def text_search(items: DataFrame, text: str) -> DataFrame:
    """Of items (id, text), those that hold every term."""
    want = query_terms(text)
    if not want:
        return items.limit(0)
    have = terms(F.col("text"))
    return items.where(reduce(lambda a, b: a & b, [F.array_contains(have, t) for t in want]))


def _is(word: str):
    return lambda x: x == word


def bm25(items: DataFrame, text: str) -> DataFrame:
    """id, score of the items (id, text) that hold any term."""
    want = query_terms(text)
    if not want:
        return items.select("id", F.lit(0.0).alias("score")).limit(0)
    cut = items.select("id", terms(F.coalesce("text", F.lit(""))).alias("t"))
    counts = {f"tf{i}": F.size(F.filter("t", _is(w))) for i, w in enumerate(want)}
    counted = cut.select("id", F.size("t").alias("len"), *[c.alias(n) for n, c in counts.items()])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(want))]).first()
    score = F.lit(0.0)
    for i in range(len(want)):
        idf = float(np.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["mean"] or 1.0))))
    return counted.withColumn("score", score).where("score > 0").select("id", "score")


def fused(branches: list[DataFrame], limit: int) -> DataFrame:
    """id, score: reciprocal ranks 1 / (60 + rank) summed over branches (id, score), each of its best ``limit`` rows."""
    ranked = []
    for b in branches:
        top = b.orderBy(F.desc("score"), "id").limit(limit)
        ranked.append(top.select("id", (1.0 / (RRF + F.expr("row_number() over (order by score desc, id)"))).alias("part")))  # ``limit`` rows
    both = reduce(lambda a, b: a.unionByName(b), ranked)
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(ctx, rows, c: Clause):
    """The SEARCH clause: bound rows are the eligible set; an unbound name searches all that the index covers."""
    from ..plans.compiler import Bound, Rows, col
    from ..plans.tree import NodePattern
    from .temporal import constant

    d = c.data
    index = ctx.graph.indexes.get(d["index"])
    if index is None or index["kind"] not in ("vector", "text", "embedding"):
        raise QueryError(f"no search index {d['index']}")
    limit = ctx.count_of(d["limit"], "LIMIT")
    bound = d["var"] in rows.env
    if not bound:
        rows = ctx.bind_node(rows, NodePattern(d["var"], [index["label"]]))
    b = rows.env[d["var"]]
    key = col(b.cols["id"][0])
    scan = ctx.node_scan([index["label"]])
    eligible = scan.join(rows.df.select(key.alias("_e")).distinct(), F.col("id") == F.col("_e"), "left_semi") if bound else scan
    given = constant(ctx, d["input"])[1]
    encoder = ctx.graph.indexes.get("encoder")

    def vectors(q) -> DataFrame:
        items = eligible.select("id", F.col(f"`{index['prop']}`").alias("vector"))
        return vector_search(items, [float(x) for x in q], limit, index.get("similarity", "cosine"), d["method"])

    texts = eligible.select("id", F.col(f"`{index.get('text', index['prop'])}`").cast("string").alias("text")) if (index["kind"] == "text" or index.get("text")) else None
    if d["kind"] == "vector":
        top = vectors(given)
    elif d["kind"] == "hybrid":
        if texts is None:
            raise QueryError(f"{d['index']} has no text source")
        branches = [bm25(texts, given)]
        q = constant(ctx, d["vector"])[1] if d.get("vector") is not None else encoder(given) if encoder else None
        if q is not None:
            branches.append(vectors(q))
        top = fused(branches, limit)
    elif index["kind"] == "text":
        top = text_search(texts, given).orderBy("id").limit(limit).select("id", F.lit(1.0).alias("score"))
    elif encoder:
        top = vectors(encoder(given))
    else:
        raise QueryError("FOR TEXT needs an encoder: register a function under indexes['encoder']")
    uid = ctx.uid(d["alias"])
    df = rows.df.join(F.broadcast(top.select(F.col("id").alias(f"{uid}.id"), F.col("score").alias(uid))), key == col(f"{uid}.id"))  # LIMIT rows
    out = Rows(df, {**rows.env, d["alias"]: Bound("value", {"": (uid, DOUBLE)})})
    if d["evidence"]:
        from ..plans.tree import PathPattern

        path = PathPattern([NodePattern(d["var"])], d["evidence"])
        out = ctx.bind_path(out, path)
    return out


__all__ = ["search", "vector_search", "text_search", "bm25", "fused", "similarity"]
