"""Column expressions that several operators use."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as which kind of event.
IMPRESSIONS = ("impression", "exposure")
ORDERS = ("order", "purchase")
ENGAGEMENT = ("click", "order", "purchase")
THUMBS = ("thumb_up", "thumb_down")
FEEDBACK = ("click", "order", "purchase", "thumb_up", "thumb_down", "abandon")


def utc_date(seconds: Column) -> Column:
    """The UTC date of epoch seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def day_bucket(seconds: Column) -> Column:
    return F.date_format(utc_date(seconds), "yyyyMMdd")


_UNITS = {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_MONTHS = {"month": 1, "year": 12}


def _parts(text: str) -> list[tuple[int, str]]:
    """The numbers and units of '1 day 2 hours' and the like."""
    body = text.strip().lower().removeprefix("interval ")
    found = re.findall(r"(-?\d+)\s+([a-z]+?)s?(?=\s|$)", body)
    if not found or any(u not in _UNITS and u not in _MONTHS for _, u in found) or re.sub(r"-?\d+\s+[a-z]+", "", body).strip():
        raise ValueError(f"not an interval: {text!r}")
    return [(int(n), u) for n, u in found]


def is_fixed(text: str) -> bool:
    """Whether an interval has the same length at any time: no months, no years."""
    return not any(u in _MONTHS for _, u in _parts(text))


def interval_seconds(text: str) -> int:
    """Seconds of '10 minutes', '1 day 2 hours' and the like; months and years have no fixed length and are refused."""
    if not is_fixed(text):
        raise ValueError(f"not an interval of fixed length: {text!r}")
    return int(sum(n * _UNITS[u] for n, u in _parts(text)))


def cutoff_ms(ms: int, delay: str) -> int:
    """The time `delay` before an epoch millisecond, in UTC; months go by the calendar, to the month's last day where the day is missing."""
    import calendar
    import datetime as dt

    parts = _parts(delay)
    months = sum(n * _MONTHS[u] for n, u in parts if u in _MONTHS)
    rest = round(sum(n * _UNITS[u] for n, u in parts if u in _UNITS) * 1000)
    if months:
        at = dt.datetime.fromtimestamp(ms // 1000, dt.UTC)
        year, month = divmod(at.year * 12 + at.month - 1 - months, 12)
        at = at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))
        ms = int(at.timestamp()) * 1000 + ms % 1000
    return ms - rest


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def held_out(request: Column, folds: int = 5) -> Column:
    """MD5(request) as a number is divisible by 5: 16 is 1 modulo 5, so the sum of the hex digits decides."""
    if folds != 5:
        raise ValueError("the sum of digits decides for 5 only")
    digits = F.transform(F.split(F.md5(request.cast("binary")), ""), lambda d: F.coalesce(F.try_to_number(F.conv(d, 16, 10), F.lit("99")).cast("int"), F.lit(0)))
    return F.aggregate(digits, F.lit(0), lambda a, b: a + b) % 5 == 0


def cosine(a: Column, b: Column, truncate: bool = False) -> Column:
    """Cosine of two double arrays; 0 if a norm is 0. truncate: norms over the common length only."""
    if truncate:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda xs: F.sqrt(total(F.transform(xs, lambda x: x.cast("double") * x.cast("double"))))
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot / scale).otherwise(0.0)


class Gate:
    """Rules in order; the first that a row breaks is its reason for rejection."""

    def __init__(self, df: DataFrame, rules: Sequence[tuple[str, Column]], tag: str = "rejection_reason"):
        if not rules:
            raise ValueError("a gate needs a rule")
        self.tag, self.reasons = tag, [r for r, _ in rules]
        reason = None
        for name, keeps in rules:
            broken = ~F.coalesce(keeps, F.lit(False))
            reason = F.when(broken, name) if reason is None else reason.when(broken, name)
        self.tagged = df.withColumn(tag, reason)

    @property
    def kept(self) -> DataFrame:
        return self.tagged.filter(F.col(self.tag).isNull()).drop(self.tag)

    @property
    def rejected(self) -> DataFrame:
        return self.tagged.filter(F.col(self.tag).isNotNull())

    def counts(self) -> DataFrame:
        """(reason, n): kept, and every declared reason, zeros included."""
        spark = self.tagged.sparkSession
        names = spark.createDataFrame([(i, r) for i, r in enumerate(["kept", *self.reasons])], "rank int, reason string")
        found = self.tagged.groupBy(F.coalesce(self.tag, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
        return F.broadcast(names).join(found, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
