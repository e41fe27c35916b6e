"""Timestamps as column expressions. The session's time zone is that of local days; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers from here on are milliseconds; times outside these years are not believed.
MS_FROM, EARLIEST, LATEST = 1_000_000_000_000, 1_420_070_400, 2_051_222_400


def _believed(t: Column) -> Column:
    return F.when(F.unix_seconds(t).between(EARLIEST, LATEST), t)


def parse_any_iso(c: Column) -> Column:
    """ISO text as a time, without a zone as UTC; null if it can't be read."""
    zoned = F.when(F.regexp_like(c, F.lit("(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$")), c).otherwise(F.concat(c, F.when(F.contains(c, F.lit(":")), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.try_to_timestamp(F.regexp_replace(zoned, "[zZ]$", "+00:00"))


def parse_iso(c: Column) -> Column:
    """parse_any_iso() inside the believed years."""
    return _believed(parse_any_iso(c))


def from_epoch(x: Column) -> Column:
    """Seconds or milliseconds since 1970 as a time inside the believed years; negative, NaN and infinite numbers are null."""
    d = x.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < 1e17)
    ms = F.when(ok, F.when(d >= MS_FROM, d).otherwise(d * 1000))
    return _believed(F.timestamp_millis(F.when(ms < 1e15, ms).cast("long")))


def parse_any(c: Column) -> Column:
    """Numbers by from_epoch(), other text by parse_iso()."""
    number = F.regexp_like(c, F.lit("^-?[0-9]+(?:\\.[0-9]+)?$"))
    return F.when(number, from_epoch(c.try_cast("double"))).otherwise(parse_iso(c))


def tagged(c: Column) -> Column:
    """The time in a text's <timestamp> tag, such as `Sunday, Apr 26, 2026, 9:53 PM (UTC-4)`, without regard to its zone; null without one."""
    inside = F.regexp_extract(c, "(?s)<timestamp>(.*?)</timestamp>", 1)
    said = F.regexp_extract(inside, "([A-Z][a-z]{2}) [0-9]{1,2}, [0-9]{4}, [0-9]{1,2}:[0-9]{2} [AP]M", 0)
    return F.try_to_timestamp(F.nullif(said, F.lit("")), F.lit("MMM d, yyyy, h:mm a"))


def day(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, none below 0."""
    return F.greatest(F.timestamp_diff("SECOND", a, b), F.lit(0))


def period_starts(now: Column) -> dict[str, Column]:
    return {p: day(F.date_trunc(p, now)) for p in ("year", "month", "week")}
