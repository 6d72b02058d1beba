"""Exact deduplication by skew-safe combining.

1. Local: the map side of an aggregation by (digest, whole text) leaves at most one row
   for each text in each task.
2. Salted: digests that hold more than 1/4096 of all rows are first merged in salted
   groups (digest, salt, whole text), so that no reducer meets all tasks' rows of one text.
3. Global: the winners of the salts (and all other groups, which need no salt) are merged
   by (digest, whole text).

The text itself is a grouping key at every stage, so two texts that share a digest are
never merged. Texts cross the network once; decisions go back by digest alone, except for
digests that really hold several texts, whose rows are matched by text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, hot_keys, packed

SALTS = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combine(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """(digest, text, top, size) of each distinct text."""
    tops = (F.max("top").alias("top"), F.sum("size").alias("size"))
    rows = rows.select("digest", "text", F.col("id").alias("top"), F.lit(1).cast("long").alias("size"))
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").groupBy("digest", "text").agg(*tops)
    salted = (
        rows.join(F.broadcast(hot), "digest", "left_semi")
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(*tops)
    )
    return cold.unionByName(salted.groupBy("digest", "text").agg(*tops))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    digest: Callable[[Column], Column] = _sha256,
    salts: int = SALTS,
) -> DataFrame:
    """Each row of ``docs`` with the group of equal texts that it belongs to.

    Returns ``row`` (struct of the columns ``carry``, all by default), ``keep_id`` (largest
    id of the group), ``group_size``, ``kept`` and ``digest``. Null texts count as empty
    texts. A null id never wins unless the whole group has none; rows that repeat the
    winning id with the same text are the same document and are all marked kept. An empty
    table gives an empty result. Extra columns travel inside ``row`` only.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(packed(docs, carry).alias("row"), docs[id_col].alias("id"), text.alias("text"), digest(text).alias("digest"))
    keys = rows.select("digest")
    hot = cut(hot_keys(keys, ["digest"], docs.count()))
    classes = _combine(rows, hot, salts)
    groups = (
        classes.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.max("top").alias("top"), F.max("size").alias("size"))
        .where((F.col("size") > 1) | (F.col("texts") > 1))
    )
    groups = cut(groups)
    clashes = groups.where("texts > 1").select("digest")
    light = rows.select("row", "id", "digest")
    found = attach(light, groups.where("texts = 1").select("digest", "top", "size"), ["digest"], hot)
    if not clashes.isEmpty():
        found = found.join(clashes, "digest", "left_anti")
        odd = rows.join(clashes, "digest", "left_semi").join(classes.join(clashes, "digest", "left_semi"), ["digest", "text"])
        found = found.unionByName(odd.select(*found.columns))
    keep, size = F.coalesce("top", "id"), F.coalesce("size", F.lit(1).cast("long"))
    return found.select("row", keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    kept = exact_groups(docs, id_col, text_col).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    got = exact_groups(docs, carry=["doc_id"])
    return got.select("row.doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
