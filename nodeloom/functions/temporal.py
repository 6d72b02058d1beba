"""Temporal values: constructors, clocks, truncation, accessors, durations, arithmetic, text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tree import QueryError
from ..plans.values import DATE, DURATION, LDT, LONG, LTIME, NULL, STRING, TEMPORAL, ZDT, ZTIME, Value, is_type, kind, null

NS = 1_000_000_000
DAY = 86_400 * NS
KINDS = ("date", "localdatetime", "localtime", "time", "datetime")


def _long(c: Column) -> Column:
    return c.cast("long")


def _struct(t: T.StructType, *cols: Column) -> Column:
    made = F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, t.fields, strict=True)])
    return F.when(cols[0].isNotNull(), made)


# The parts of any temporal value.


def local(v: Value) -> Column:
    """Date and time on the value's own clock, as TIMESTAMP_NTZ."""
    k = kind(v.type)
    if k == "datetime":
        return F.convert_timezone(F.lit("UTC"), zone_name(v.col["zone"]), v.col["ts"].cast("timestamp_ntz"))
    return v.col.cast("timestamp_ntz") if k in ("date", "localdatetime", "instant") else None


def zone_name(zone: Column) -> Column:
    return F.when(zone == "Z", "UTC").otherwise(zone)


def day_nanos(v: Value) -> Column:
    k = kind(v.type)
    if k in ("localtime", "time"):
        return v.col["day_nanos"]
    if k == "date":
        return F.when(v.col.isNotNull(), F.lit(0)).cast("long")
    return F.pmod(_micros(local(v)), F.lit(86_400_000_000)) * 1000


def _micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a local time, taken as UTC (``ntz`` is named once, so nesting stays small)."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    return F.unix_micros((ntz if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)).cast("timestamp"))


def epoch_nanos(v: Value) -> Column:
    """Nanoseconds since 1970; local values count as UTC, integers are taken as such."""
    k = kind(v.type)
    if k == "number":
        return v.col.cast("long")
    if k == "datetime":
        return F.unix_micros(v.col["ts"]) * 1000
    if k == "instant":
        return F.unix_micros(v.col) * 1000
    if k == "date":
        return F.unix_date(v.col).cast("long") * DAY
    if k == "localdatetime":
        return _micros(v.col) * 1000
    raise QueryError(f"{kind(v.type)} is no instant")


def once(c: Column, f) -> Column:
    """f of a column that f names often: bound as a variable, so the tree grows by one copy only."""
    return F.element_at(F.transform(F.array(c), f), 1)


# Text.


def _two(c: Column, n: int = 2) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _clock(nanos: Column) -> Column:
    s, f = F.floor(nanos / NS).cast("long"), F.pmod(nanos, F.lit(NS))
    base = F.concat(_two(F.floor(s / 3600)), F.lit(":"), _two(F.floor(F.pmod(s, F.lit(3600)) / 60)))
    seconds = F.concat(F.lit(":"), _two(F.pmod(s, F.lit(60))))
    fraction = F.when(f == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(_two(f, 9), "0+$", "")))
    return F.concat(base, F.when((F.pmod(s, F.lit(60)) == 0) & (f == 0), "").otherwise(F.concat(seconds, fraction)))


def _offset(seconds: Column) -> Column:
    a = F.abs(seconds)
    return F.when(seconds == 0, "Z").otherwise(F.concat(F.when(seconds < 0, "-").otherwise("+"), _two(F.floor(a / 3600)), F.lit(":"), _two(F.floor(F.pmod(a, F.lit(3600)) / 60))))


def text_of(v: Value) -> Column:
    """ISO text of temporal values, plain text of others."""
    if kind(v.type) in ("duration", "datetime", "time", "localtime", "localdatetime"):
        return F.when(v.col.isNotNull(), once(v.col, lambda c: _text(Value(c, v.type))))
    return F.date_format(v.col, "yyyy-MM-dd") if kind(v.type) == "date" else v.col.cast("string")


def _text(v: Value) -> Column:
    k, c = kind(v.type), v.col
    if k == "localtime":
        return _clock(c["day_nanos"])
    if k == "time":
        return F.concat(_clock(c["day_nanos"]), _offset(c["offset"]))
    if k == "localdatetime":
        return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T"), _clock(day_nanos(v)))
    if k == "datetime":
        at = local(v)
        shift = F.floor((_micros(at) - F.unix_micros(c["ts"])) / 1_000_000).cast("long")
        named = F.when(c["zone"].rlike("^(Z|[+-].*)$"), "").otherwise(F.concat(F.lit("["), c["zone"], F.lit("]")))
        return F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T"), _clock(day_nanos(v)), _offset(shift), named)
    if k == "duration":
        months, days, seconds, nanos = (c[f] for f in ("months", "days", "seconds", "nanos"))

        def part(n: Column, letter: str) -> Column:
            return F.when(n != 0, F.concat(n.cast("string"), F.lit(letter))).otherwise("")

        y, mo = (months / 12).cast("long"), F.try_mod(months, F.lit(12).cast("long"))
        h, mi, s = (seconds / 3600).cast("long"), (F.try_mod(seconds, F.lit(3600).cast("long")) / 60).cast("long"), F.try_mod(seconds, F.lit(60).cast("long"))
        fraction = F.when(nanos == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(_two(F.abs(nanos), 9), "0+$", "")))
        sec = F.when((s != 0) | (nanos != 0), F.concat(s.cast("string"), fraction, F.lit("S"))).otherwise("")
        clock = F.concat(part(h, "H"), part(mi, "M"), sec)
        body = F.concat(part(y, "Y"), part(mo, "M"), part(days, "D"), F.when(clock == "", "").otherwise(F.concat(F.lit("T"), clock)))
        return F.concat(F.lit("P"), once(body, lambda b: F.when(b == "", "T0S").otherwise(b)))
    raise QueryError(f"no text of {k}")


# Constructors.


def _parse_clock(text: Column) -> Column:
    """Nanoseconds of the day of hh[:mm[:ss[.f]]] or hhmmss."""
    plain = F.replace(F.regexp_extract(text, r"^([0-9:]+)", 1), F.lit(":"), F.lit(""))
    fraction = F.rpad(F.regexp_extract(text, r"[.,]([0-9]+)", 1), 9, "0")

    def two(at: int) -> Column:
        return F.coalesce(F.substring(plain, at, 2).try_cast("long"), F.lit(0))

    return ((two(1) * 3600 + two(3) * 60 + two(5)) * NS + fraction.try_cast("long")).cast("long")


def _parse_offset(text: Column) -> Column:
    """Seconds of Z, +hh, +hhmm or +hh:mm at the end; null without."""
    m = F.regexp_extract(text, r"(Z|[+-][0-9]{2}:?(?:[0-9]{2})?)(?:\[.*\])?$", 1)
    hours, minutes = F.substring(m, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(m, r"^[+-][0-9]{2}:?([0-9]{2})$", 1).try_cast("int"), F.lit(0))
    return F.when(m == "Z", F.lit(0)).when(m != "", (hours * 3600 + minutes * 60) * F.when(m.startswith("-"), -1).otherwise(1))


def _parse_date(text: Column) -> Column:
    week = F.regexp_extract(text, r"^([0-9]{4})-?W", 1).try_cast("int"), F.regexp_extract(text, r"W([0-9]{2})", 1).try_cast("int"), F.regexp_extract(text, r"W[0-9]{2}-?([1-7])$", 1).try_cast("int")
    ordinal = F.regexp_extract(text, r"^([0-9]{4})-?([0-9]{3})$", 1).try_cast("int"), F.regexp_extract(text, r"^([0-9]{4})-?([0-9]{3})$", 2).try_cast("int")
    plain = F.regexp_extract(text, r"^(-?[0-9]{4})-?([0-9]{2})?-?([0-9]{2})?$", 1).try_cast("int")
    month, day = (F.coalesce(F.regexp_extract(text, r"^(-?[0-9]{4})-?([0-9]{2})?-?([0-9]{2})?$", i).try_cast("int"), F.lit(1)) for i in (2, 3))
    return (
        F.when(week[0].isNotNull(), _week_date(week[0], week[1], F.coalesce(week[2], F.lit(1))))
        .when(ordinal[0].isNotNull(), F.date_add(F.make_date(ordinal[0], F.lit(1), F.lit(1)), ordinal[1] - 1)).otherwise(F.make_date(plain, month, day))
    )


def _week_date(year: Column, week: Column, day: Column) -> Column:
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week - 1) * 7 + day - 1).cast("int"))


def _fields(v: Value) -> dict[str, Value] | None:
    return {f.name.lower(): Value(v.col[f.name], f.dataType) for f in v.type.fields} if kind(v.type) == "map" and isinstance(v.type, T.StructType) else None


def _date_of(f: dict[str, Value], base: Column | None) -> Column:
    """A date from calendar, week, ordinal or quarter fields; what is not named comes from ``base`` or is 1."""

    def get(name: str, of: Column | None = None) -> Column:
        return f[name].col.cast("int") if name in f else of if of is not None else F.lit(1)

    year = get("year", F.year(base) if base is not None else None)
    if "week" in f:
        return _week_date(year, get("week"), get("dayofweek", F.weekday(base) + 1 if base is not None else None))
    if "ordinalday" in f:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), get("ordinalday") - 1)
    if "quarter" in f:
        first = F.make_date(year, (get("quarter") - 1) * 3 + 1, F.lit(1))
        if "dayofquarter" in f:
            return F.date_add(first, get("dayofquarter") - 1)
    return F.make_date(year, get("month", F.month(base) if base is not None else None), get("day", F.dayofmonth(base) if base is not None else None))


def _clock_of(f: dict[str, Value], base: Column | None) -> Column:
    def get(name: str, of: Column | None = None) -> Column:
        return f[name].col.cast("long") if name in f else of if of is not None else F.lit(0).cast("long")

    b = base
    hour = get("hour", F.floor(b / (3600 * NS)) if b is not None else None)
    minute = get("minute", F.floor(F.pmod(b, F.lit(3600 * NS)) / (60 * NS)) if b is not None else None)
    second = get("second", F.floor(F.pmod(b, F.lit(60 * NS)) / NS) if b is not None else None)
    fine = get("millisecond") * 1_000_000 + get("microsecond") * 1000 + get("nanosecond") if {"millisecond", "microsecond", "nanosecond"} & set(f) else F.pmod(b, F.lit(NS)) if b is not None else F.lit(0).cast("long")
    return _long((hour * 3600 + minute * 60 + second) * NS + fine)


def at_clock(date: Column, nanos: Column) -> Column:
    """The local date and time of a date and nanoseconds of its day (microseconds are kept)."""
    return (date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(nanos / 1000) / 1_000_000).cast("decimal(18,6)"))).cast("timestamp_ntz")


def in_zone(at: Column, zone: Column) -> Column:
    """A zoned value of a local time in a zone."""
    return _struct(ZDT, F.convert_timezone(zone_name(zone), F.lit("UTC"), at).cast("timestamp"), zone)


def construct(name: str, v: Value) -> Value:
    k, t = kind(v.type), TEMPORAL[name]
    if k == "null":
        return null(t)
    if k == "string":
        s = F.trim(v.col)
        day, clock = F.regexp_extract(s, r"^([^T]*)", 1), F.regexp_extract(s, r"T(.*)$", 1)
        if name == "date":
            return Value(_parse_date(day), t)
        if name in ("localtime", "time"):
            body = F.when(s.contains("T"), clock).otherwise(s)
            nanos = F.when(s.isNotNull(), _parse_clock(body))
            return Value(_struct(LTIME, nanos) if name == "localtime" else _struct(ZTIME, nanos, F.coalesce(_parse_offset(body), F.lit(0))), t)
        at = at_clock(_parse_date(day), _parse_clock(clock))
        if name == "localdatetime":
            return Value(at, t)
        named, shift = F.regexp_extract(s, r"\[(.*)\]$", 1), _parse_offset(clock)
        zone = F.when(named != "", named).when(shift.isNotNull(), _offset(shift)).otherwise("Z")
        by_offset = _struct(ZDT, (at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), shift.cast("decimal(18,6)"))).cast("timestamp"), zone)
        return Value(F.when(shift.isNotNull(), by_offset).otherwise(in_zone(at, zone)), t)
    f = _fields(v)
    if f is None:
        f, base = {}, v
    else:
        given = next((f[n] for n in ("date", "datetime", "localdatetime", "time", "localtime") if n in f), None)
        base = given
    day_base = next((f[n] for n in ("date", "datetime") if n in f), base if base is not None and kind(base.type) in ("date", "localdatetime", "datetime") else None)
    clock_base = next((f[n] for n in ("time", "datetime") if n in f), base if base is not None and kind(base.type) != "date" else None)
    day = _date_of(f, local(day_base).cast("date") if day_base is not None else None)
    nanos = _clock_of(f, day_nanos(clock_base) if clock_base is not None else None)
    zone = f["timezone"].col if "timezone" in f else None
    if zone is None:
        zoned = next((b for b in (clock_base, day_base) if b is not None and kind(b.type) in ("datetime", "time")), None)
        zone = F.lit("Z") if zoned is None else zoned.col["zone"] if kind(zoned.type) == "datetime" else _offset(zoned.col["offset"])
    there = v.col.isNotNull()
    out = {
        "date": lambda: day, "localtime": lambda: _struct(LTIME, nanos), "time": lambda: _struct(ZTIME, nanos, F.coalesce(_parse_offset(zone), F.lit(0))),
        "localdatetime": lambda: at_clock(day, nanos), "datetime": lambda: in_zone(at_clock(day, nanos), zone),
    }[name]()
    return Value(F.when(there, out), t)


def now(name: str, zone: Value | None = None) -> Value:
    """The clock: one instant for the whole query."""
    z = F.lit("Z") if zone is None else zone.col.cast("string")
    return construct(name, Value(F.when(z.isNotNull(), _struct(ZDT, F.current_timestamp(), z)), ZDT))


def from_epoch(seconds: Value, nanos: Value) -> Value:
    micros = seconds.col.cast("long") * 1_000_000 + F.floor(nanos.col.cast("long") / 1000)
    return Value(_struct(ZDT, F.timestamp_micros(micros), F.lit("Z")), ZDT)


def from_millis(v: Value) -> Value:
    return Value(_struct(ZDT, F.timestamp_millis(v.col.cast("long")), F.lit("Z")), ZDT)


# Durations.

_WHOLE = {"years": ("months", 12), "quarters": ("months", 3), "months": ("months", 1), "weeks": ("days", 7), "days": ("days", 1), "hours": ("seconds", 3600), "minutes": ("seconds", 60), "seconds": ("seconds", 1)}
_FINE = {"milliseconds": 1_000_000, "microseconds": 1000, "nanoseconds": 1}


def make_duration(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    return _struct(DURATION, months, days, seconds + F.floor(nanos / NS), F.pmod(nanos, F.lit(NS)))


def duration(v: Value) -> Value:
    k = kind(v.type)
    if k in ("null", "duration"):
        return Value(v.col, DURATION) if k == "duration" else null(DURATION)
    zero = F.lit(0).cast("long")
    parts = {"months": zero, "days": zero, "seconds": zero, "nanos": zero}

    def add(name: str, n: Column) -> None:
        """n of a unit; what is no whole number goes down to smaller units."""
        if name in _FINE:
            parts["nanos"] = parts["nanos"] + (n * _FINE[name]).cast("long")
            return
        at, times = _WHOLE[name]
        total = n * times
        whole = total.cast("long")
        parts[at] = parts[at] + whole
        rest = total - whole
        if at == "months":
            days = rest * 30.436875
            parts["days"] = parts["days"] + days.cast("long")
            rest = days - days.cast("long")
        if at != "seconds":
            seconds = rest * 86_400
            parts["seconds"] = parts["seconds"] + seconds.cast("long")
            rest = seconds - seconds.cast("long")
        parts["nanos"] = parts["nanos"] + F.round(rest * NS).cast("long")

    if k == "string":
        day, clock = F.regexp_extract(v.col, r"^(-?)P([^T]*)", 2), F.regexp_extract(v.col, r"T(.*)$", 1)
        sign = F.when(v.col.startswith("-"), -1.0).otherwise(1.0)
        for letter, unit, where in (("Y", "years", day), ("M", "months", day), ("W", "weeks", day), ("D", "days", day), ("H", "hours", clock), ("M", "minutes", clock), ("S", "seconds", clock)):
            add(unit, F.coalesce(F.regexp_extract(where, rf"(-?[0-9]+(?:[.][0-9]+)?){letter}", 1).try_cast("double"), F.lit(0.0)) * sign)
        bad = F.raise_error(F.lit("InvalidArgumentValue: duration takes ISO 8601 text")).cast("boolean")
        good = v.col.rlike(r"^-?P(?=.)(-?[0-9.]+[YMWD])*(T(-?[0-9.]+[HMS])+)?$")
        return Value(F.when(v.col.isNull(), F.lit(None)).when(F.when(good, F.lit(True)).otherwise(bad), make_duration(*parts.values())), DURATION)
    f = _fields(v)
    if f is None:
        raise QueryError(f"InvalidArgumentValue: duration takes text or a map, not {k}")
    for name, x in f.items():
        if name not in _WHOLE and name not in _FINE:
            raise QueryError(f"InvalidArgumentValue: duration has no {name}")
        add(name, x.col.cast("double"))
    return Value(make_duration(*parts.values()), DURATION)


def shifted(v: Value, d: Value, sign: int) -> Value:
    """A temporal value plus or minus a duration; a day that its month lacks becomes the month's last."""
    months, days, seconds, nanos = (d.col[n] * sign for n in ("months", "days", "seconds", "nanos"))
    k = kind(v.type)
    if k in ("localtime", "time"):
        at = F.pmod(v.col["day_nanos"] + seconds * NS + nanos, F.lit(DAY))
        return Value(_struct(LTIME, at) if k == "localtime" else _struct(ZTIME, at, v.col["offset"]), v.type)
    if k == "date":
        whole = days + F.floor((seconds * NS + nanos) / DAY)
        return Value(F.date_add(F.add_months(v.col, months.cast("int")), whole.cast("int")), DATE)
    at = local(v)
    day = F.date_add(F.add_months(at.cast("date"), months.cast("int")), days.cast("int"))
    clock = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds + F.floor(nanos / 1000) / 1_000_000).cast("decimal(18,6)"))
    at = at_clock(day, day_nanos(v))
    if k == "localdatetime":
        return Value((at + clock).cast("timestamp_ntz"), LDT)
    moved = in_zone(at, v.col["zone"])
    return Value(_struct(ZDT, (moved["ts"] + clock).cast("timestamp"), v.col["zone"]), ZDT)


def added(a: Value, b: Value, sign: int) -> Value:
    return Value(make_duration(*[a.col[n] + b.col[n] * sign for n in ("months", "days", "seconds", "nanos")]), DURATION)


def scaled(d: Value, by: Column) -> Value:
    zero = F.lit(0).cast("long")
    total = (d.col["seconds"].cast("double") * by + d.col["nanos"].cast("double") * by / NS)
    months, days = d.col["months"] * by, d.col["days"] * by
    more_days = (months - months.cast("long")) * 30.436875 + days
    seconds = (more_days - more_days.cast("long")) * 86_400 + total
    return Value(make_duration(months.cast("long"), more_days.cast("long"), seconds.cast("long"), F.round((seconds - seconds.cast("long")) * NS).cast("long") + zero), DURATION)


def _instants(a: Value, b: Value) -> tuple[Column, Column]:
    """Both as local date and time (on one clock if both have a zone; times of day on 1970-01-01)."""
    if kind(a.type) == "datetime" and kind(b.type) == "datetime":
        return local(a), F.convert_timezone(F.lit("UTC"), zone_name(a.col["zone"]), b.col["ts"].cast("timestamp_ntz"))
    day = next((local(v).cast("date") for v in (a, b) if kind(v.type) not in ("localtime", "time")), F.lit("1970-01-01").cast("date"))
    return tuple(local(v) if kind(v.type) not in ("localtime", "time") else at_clock(day, day_nanos(v)) for v in (a, b))


def between(a: Value, b: Value, unit: str) -> Value:
    """The duration from a to b: in months, days and the rest, or in one of them."""
    if "null" in (kind(a.type), kind(b.type)):
        return null(DURATION)
    x, y = _instants(a, b)
    zero = F.lit(0).cast("long")

    def spanned(p: Column) -> Column:
        """x, y, the microseconds between them, and the whole months."""
        x, y = p["x"], p["y"]
        whole = _micros(y) - _micros(x)
        months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
        stepped = at_clock(F.add_months(x.cast("date"), months), F.pmod(_micros(x), F.lit(86_400_000_000)) * 1000)
        over = F.when((whole >= 0) & (stepped > y), -1).when((whole < 0) & (stepped < y), 1).otherwise(0)
        return F.struct(x.alias("x"), y.alias("y"), whole.alias("whole"), (months + over).alias("months"))

    def parts(p: Column) -> Column:
        whole, months = p["whole"], p["months"].cast("long")
        if unit == "seconds":
            return make_duration(zero + whole * 0, zero, zero, whole * 1000)
        if unit == "days":
            return make_duration(zero + whole * 0, (whole / 86_400_000_000).cast("long"), zero, zero)
        if unit == "months":
            return make_duration(months, zero, zero, zero)
        stepped = at_clock(F.add_months(p["x"].cast("date"), p["months"]), F.pmod(_micros(p["x"]), F.lit(86_400_000_000)) * 1000)
        return once(_micros(p["y"]) - _micros(stepped), lambda rest: make_duration(months, (rest / 86_400_000_000).cast("long"), zero, (rest - (rest / 86_400_000_000).cast("long") * 86_400_000_000) * 1000))

    return Value(once(once(F.struct(x.alias("x"), y.alias("y")), spanned), parts), DURATION)


# Truncation and accessors.


def truncate(name: str, unit: Value, v: Value, fields: Value | None = None) -> Value:
    """The value cut to a unit (a literal), then with the fields that are given."""
    u = getattr(unit, "literal", None)
    if not isinstance(u, str):
        raise QueryError("InvalidArgumentValue: the unit must be a literal string")
    u = u.lower()
    steps = {"hour": 3600 * NS, "minute": 60 * NS, "second": NS, "millisecond": 1_000_000, "microsecond": 1000, "day": DAY}
    if kind(v.type) in ("localtime", "time"):
        if u not in steps:
            raise QueryError(f"InvalidArgumentValue: no unit {u} for times")
        nanos, day = v.col["day_nanos"], None
    else:
        day, nanos = local(v).cast("date"), day_nanos(v)
    if u in steps and u != "day":
        nanos = nanos - F.pmod(nanos, F.lit(steps[u]))
    else:
        nanos = F.when(nanos.isNotNull(), F.lit(0)).cast("long")
        if day is not None:
            y = F.year(day)
            century = {"millennium": 1000, "century": 100, "decade": 10}
            if u in century:
                day = F.make_date(y - F.pmod(y, F.lit(century[u])), F.lit(1), F.lit(1))
            elif u == "weekyear":
                day = _week_date(F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.lit(1), F.lit(1))
            elif u in ("year", "quarter", "month", "week", "day"):
                day = F.date_trunc(u, day.cast("timestamp_ntz")).cast("date")
            else:
                raise QueryError(f"InvalidArgumentValue: no unit {u}")
    f = _fields(fields) if fields is not None else {}
    if f and day is not None and set(f) & {"year", "month", "day", "week", "dayofweek", "ordinalday", "quarter", "dayofquarter"}:
        if set(f) & {"dayofweek"} and "week" not in f:
            day = F.date_add(F.date_sub(day, F.weekday(day)), f["dayofweek"].col.cast("int") - 1)
        else:
            day = _date_of(f, day)
    if f:
        nanos = _clock_of(f, nanos)
    zone = f["timezone"].col if f and "timezone" in f else v.col["zone"] if kind(v.type) == "datetime" else F.lit("Z")
    offset = v.col["offset"] if kind(v.type) == "time" else F.lit(0)
    out = {
        "date": lambda: day, "localdatetime": lambda: at_clock(day, nanos), "datetime": lambda: in_zone(at_clock(day, nanos), zone),
        "localtime": lambda: _struct(LTIME, nanos), "time": lambda: _struct(ZTIME, nanos, offset),
    }[name]()
    return Value(out, TEMPORAL[name])


def accessor(v: Value, name: str) -> Value | None:
    """A named part of a temporal value; null if there is none of that name."""
    k, n = kind(v.type), name.lower()
    if k == "duration":
        c = v.col
        whole = {
            "months": c["months"], "years": c["months"] / 12, "quarters": c["months"] / 3, "quartersofyear": F.try_mod(c["months"] / 3, F.lit(4.0)), "monthsofyear": F.try_mod(c["months"], F.lit(12).cast("long")),
            "days": c["days"], "weeks": c["days"] / 7, "daysofweek": F.try_mod(c["days"], F.lit(7).cast("long")),
            "seconds": c["seconds"], "minutes": c["seconds"] / 60, "hours": c["seconds"] / 3600, "minutesofhour": F.try_mod((c["seconds"] / 60).cast("long"), F.lit(60).cast("long")), "secondsofminute": F.try_mod(c["seconds"], F.lit(60).cast("long")),
            "milliseconds": c["seconds"] * 1000 + F.floor(c["nanos"] / 1_000_000), "microseconds": c["seconds"] * 1_000_000 + F.floor(c["nanos"] / 1000), "nanoseconds": c["seconds"] * NS + c["nanos"],
            "millisecondsofsecond": F.floor(c["nanos"] / 1_000_000), "microsecondsofsecond": F.floor(c["nanos"] / 1000), "nanosecondsofsecond": c["nanos"],
        }
        return Value(whole[n].cast("long"), LONG) if n in whole else None
    if k not in KINDS:
        return None
    if k not in ("localtime", "time"):
        day = local(v).cast("date")
        quarter = F.trunc(day, "quarter")
        dates = {
            "year": F.year(day), "quarter": F.quarter(day), "month": F.month(day), "week": F.weekofyear(day), "weekyear": F.extract(F.lit("YEAROFWEEK"), day), "day": F.dayofmonth(day),
            "ordinalday": F.dayofyear(day), "dayofweek": F.weekday(day) + 1, "weekday": F.weekday(day) + 1, "dayofquarter": F.datediff(day, quarter) + 1,
        }
        if n in dates:
            return Value(dates[n].cast("long"), LONG)
    if k != "date":
        t = day_nanos(v)
        clocks = {"hour": F.floor(t / (3600 * NS)), "minute": F.floor(F.pmod(t, F.lit(3600 * NS)) / (60 * NS)), "second": F.floor(F.pmod(t, F.lit(60 * NS)) / NS), "millisecond": F.floor(F.pmod(t, F.lit(NS)) / 1_000_000), "microsecond": F.floor(F.pmod(t, F.lit(NS)) / 1000), "nanosecond": F.pmod(t, F.lit(NS))}
        if n in clocks:
            return Value(clocks[n].cast("long"), LONG)
    if k in ("datetime", "time"):
        shift = v.col["offset"].cast("long") if k == "time" else F.floor((_micros(local(v)) - F.unix_micros(v.col["ts"])) / 1_000_000).cast("long")
        zone = _offset(shift) if k == "time" else v.col["zone"]
        zones = {"timezone": Value(zone, STRING), "offset": Value(_offset(shift), STRING), "offsetseconds": Value(shift, LONG), "offsetminutes": Value(F.floor(shift / 60).cast("long"), LONG)}
        if n in zones:
            return zones[n]
        if k == "datetime" and n in ("epochseconds", "epochmillis"):
            return Value(F.floor(F.unix_micros(v.col["ts"]) / (1_000_000 if n == "epochseconds" else 1000)).cast("long"), LONG)
    return None


def _clock_functions(name: str) -> dict[str, tuple]:
    out = {name: (0, 1, lambda v=None, n=name: now(n) if v is None else construct(n, v))}
    for which in ("realtime", "statement", "transaction"):
        out[f"{name}.{which}"] = (0, 1, lambda z=None, n=name: now(n, z))
    out[f"{name}.truncate"] = (2, 3, lambda u, v, f=None, n=name: truncate(n, u, v, f))
    return out


FUNCTIONS: dict[str, tuple] = {}
for _name in KINDS:
    FUNCTIONS |= _clock_functions(_name)
FUNCTIONS |= {
    "datetime.fromepoch": (2, 2, from_epoch),
    "datetime.fromepochmillis": (1, 1, from_millis),
    "duration": (1, 1, duration),
    "duration.between": (2, 2, lambda a, b: between(a, b, "all")),
    "duration.inmonths": (2, 2, lambda a, b: between(a, b, "months")),
    "duration.indays": (2, 2, lambda a, b: between(a, b, "days")),
    "duration.inseconds": (2, 2, lambda a, b: between(a, b, "seconds")),
}
