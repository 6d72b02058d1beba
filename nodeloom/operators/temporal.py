"""HISTORY, WINDOW and rollups over temporal samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import temporal as TF
from ..plans.tree import Clause, Expr, QueryError
from ..plans.values import DURATION, LONG, ZDT, Value, kind

MOST_BUCKETS = 1_000_000
WINDOW_T = T.StructType([T.StructField("start", LONG), T.StructField("end", LONG)])


def samples_of(graph, what: str, known, prop: str) -> DataFrame:
    for (w, name, p), df in graph.samples.items():
        if w == what and p == prop and (not known or name in known):
            return df
    raise QueryError(f"{prop} is not declared temporal")


def history(ctx, rows, c: Clause):
    """One row for each sample in [FROM, TO) of the property of a bound entity."""
    from ..plans.compiler import Bound, Rows, col

    var = c.data["var"]
    b = rows.env.get(var)
    if b is None or b.kind not in ("node", "rel"):
        raise QueryError(f"HISTORY takes a bound entity, not {var}")
    samples = samples_of(ctx.graph, b.kind, b.known, c.data["prop"])
    rows, comp = ctx.prepared(rows, c.data["from"], c.data["to"])
    lo, hi = TF.epoch_nanos(comp(c.data["from"])), TF.epoch_nanos(comp(c.data["to"]))
    uid = ctx.uid(c.data["alias"])
    side = samples.select(F.col("entity").alias(f"{uid}.entity"), F.struct("time", "value").alias(uid), F.col("time").alias(f"{uid}.time"))
    inside = F.when(lo >= hi, F.raise_error(F.lit("InvalidArgumentValue: HISTORY needs FROM before TO")).cast("boolean")).otherwise((col(f"{uid}.time") >= lo) & (col(f"{uid}.time") < hi))
    df = rows.df.join(side, col(b.cols["id"][0]) == col(f"{uid}.entity")).where(inside)
    return Rows(df, {**rows.env, c.data["alias"]: Bound("value", {"": (uid, side.schema[uid].dataType)})})


def constant(ctx, e: Expr | None, fields: list[str] | None = None):
    """The value of an expression without names."""
    from ..plans.expressions import Compiler

    v = Compiler({}, ctx.params)(e)
    row = ctx.graph.spark.range(1).select(v.col.alias("x")).first()
    return v, row["x"]


def _span(ctx, e: Expr) -> tuple[int, int]:
    """(months, nanoseconds) of a constant duration; days have 24 hours."""
    v, x = constant(ctx, e)
    if kind(v.type) != "duration":
        raise QueryError("a window's width is a duration")
    months, nanos = x["months"], (x["days"] * 86_400 + x["seconds"]) * TF.NS + x["nanos"]
    if (months and nanos) or months < 0 or nanos < 0 or not (months or nanos):
        raise QueryError("a window's width is a positive number of months, or of days and less")
    return months, nanos


def bucketed(df: DataFrame, at: Column, width: tuple[int, int], every: tuple[int, int] | None, align: Column | None, zone: str | None, name: str) -> DataFrame:
    """Each row once for each window [start, end) that holds its instant ``at`` (nanoseconds): a struct column ``name``."""
    months, nanos = width
    step = every or width
    if bool(step[0]) != bool(months) or step > width:
        raise QueryError("EVERY is of the width's kind and not wider")
    zone = zone or "UTC"

    def local(n: Column) -> Column:
        return n if zone == "UTC" else TF._micros(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(F.floor(n / 1000)).cast("timestamp_ntz"))) * 1000

    def universal(n: Column) -> Column:
        return n if zone == "UTC" else TF.epoch_nanos(Value(TF.in_zone(F.timestamp_micros(F.floor(n / 1000)).cast("timestamp_ntz"), F.lit(zone)), ZDT))

    t, origin = local(at), local(align) if align is not None else F.lit(0).cast("long")
    if not months:
        n = -(-nanos // step[1])
        last = t - F.pmod(t - origin, F.lit(step[1]))
        starts = F.sequence(last - (n - 1) * step[1], last, F.lit(step[1]).cast("long")) if n > 1 else F.array(last)
        out = df.withColumn("_t", t).withColumn("_start", F.explode(starts)).where(F.col("_t") < F.col("_start") + nanos)
        return out.withColumn(name, F.when(F.col("_t").isNotNull(), F.struct(universal(F.col("_start")).alias("start"), universal(F.col("_start") + nanos).alias("end")))).drop("_t", "_start")
    base = F.timestamp_micros(F.floor(origin / 1000)).cast("timestamp_ntz")
    stamp = F.timestamp_micros(F.floor(t / 1000)).cast("timestamp_ntz")

    def boundary(k: Column) -> Column:
        """The anchor moved by k steps' months; a day that the month lacks becomes its last."""
        return TF.at_clock(F.add_months(base.cast("date"), k.cast("int")), F.pmod(origin, F.lit(TF.DAY)))

    diff = (F.year(stamp) - F.year(base)) * 12 + F.month(stamp) - F.month(base)
    k = F.floor(diff / step[0])
    k = F.when(boundary(k * step[0]) > stamp, k - 1).otherwise(k)
    n = -(-months // step[0])
    out = df.withColumn("_t", stamp).withColumn("_k", F.explode(F.sequence(k - (n - 1), k)))
    start, end = boundary(F.col("_k") * step[0]), boundary(F.col("_k") * step[0] + months)
    out = out.where((start <= F.col("_t")) & (F.col("_t") < end))
    return out.withColumn(name, F.struct(universal(TF._micros(start) * 1000).alias("start"), universal(TF._micros(end) * 1000).alias("end"))).drop("_t", "_k")


def window(ctx, rows, c: Clause):
    """Rows in their time windows; the alias has ``start`` and ``end`` in nanoseconds."""
    from ..plans.compiler import Bound, Rows, col

    d = c.data
    width, every = _span(ctx, d["width"]), _span(ctx, d["every"]) if d["every"] is not None else None
    rows, comp = ctx.prepared(rows, d["on"])
    at = TF.epoch_nanos(comp(d["on"]))
    align = TF.epoch_nanos(constant(ctx, d["align"])[0]) if d["align"] is not None else None
    zone = constant(ctx, d["zone"])[1] if d["zone"] is not None else None
    uid = ctx.uid(d["alias"])
    df = bucketed(rows.df, at, width, every, align, zone, uid)
    if d["empty"]:
        df = with_empty(df, uid, every or width, width)
    return Rows(df, {**rows.env, d["alias"]: Bound("value", {"": (uid, WINDOW_T)})})


def with_empty(df: DataFrame, name: str, step: tuple[int, int], width: tuple[int, int]) -> DataFrame:
    """The windows between the first and the last that have no rows, too, with nulls."""
    lo, hi = df.agg(F.min(F.col(f"`{name}`.start")), F.max(F.col(f"`{name}`.start"))).first()
    if lo is None:
        return df
    spark = df.sparkSession
    if step[0]:
        first = F.timestamp_micros(F.lit(lo // 1000)).cast("timestamp_ntz")
        count = (hi - lo) // (28 * TF.DAY * step[0]) + 1
        starts = spark.range(count).select(F.add_months(first.cast("date"), (F.col("id") * step[0]).cast("int")).alias("d"))
        starts = starts.select((F.unix_date("d").cast("long") * TF.DAY + lo % TF.DAY).alias("s"), (F.unix_date(F.add_months("d", width[0])).cast("long") * TF.DAY + lo % TF.DAY).alias("e")).where(F.col("s") <= hi)
    else:
        count = (hi - lo) // step[1] + 1
        starts = spark.range(count).select((F.col("id") * step[1] + lo).alias("s"), (F.col("id") * step[1] + lo + width[1]).alias("e"))
    if count > MOST_BUCKETS:
        raise QueryError(f"more than {MOST_BUCKETS} windows")
    joined = starts.join(df, F.col("s") == F.col(f"`{name}`.start"), "left")
    return joined.withColumn(name, F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).drop("s", "e")


def rollup(samples: DataFrame, width: tuple[int, int], every: tuple[int, int] | None = None, align: Column | None = None, zone: str | None = None) -> DataFrame:
    """entity, start, end, count, sum, min, max, avg of numeric samples by window."""
    out = bucketed(samples.where("value is not null"), F.col("time"), width, every, align, zone, "w")
    return out.groupBy("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end")).agg(
        F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.col("value").cast("double")).alias("avg")
    )


def append(samples: DataFrame | None, new: DataFrame, retention: int | None = None, now: int | None = None) -> DataFrame:
    """Samples with further ones (entity, time, value), which may be out of order; older than the horizon is an error."""
    last = 0 if samples is None else (samples.agg(F.max("seq")).first()[0] or 0)
    new = new.withColumn("seq", F.monotonically_increasing_id() + last + 1).select("entity", "time", "seq", "value")
    if retention is not None and now is not None and not new.where(F.col("time") < now - retention).isEmpty():
        raise QueryError("RetentionExpired: a sample is older than the retention")
    return new if samples is None else samples.select("entity", "time", "seq", "value").unionByName(new)


def compacted(samples: DataFrame, retention: int, now: int) -> DataFrame:
    """Samples within the retention."""
    return samples.where(F.col("time") >= now - retention)


__all__ = ["history", "window", "rollup", "append", "compacted", "bucketed", "DURATION"]
