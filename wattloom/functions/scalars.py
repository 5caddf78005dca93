"""Column expressions shared by the operators. All of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.config import STATUSES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text ------------------------------------------------------------------------------
def name_key(c) -> Column:
    """Trimmed, lower-cased name used to compare column names."""
    return F.lower(F.trim(_col(c)))


def composite_key(*parts) -> Column:
    return F.concat_ws("-", *[_col(p) for p in parts])


def digest16(c) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def stable_id(prefix: str, *parts) -> Column:
    """Identifier that is the same on every run and every task retry."""
    text = F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 32))


def word_cap(c, limit: int, keep: int) -> Column:
    """Text cut to `keep` words plus an ellipsis when it has more than `limit` words."""
    words = F.split(F.trim(_col(c)), r"\s+")
    return F.when(
        F.size(words) > limit,
        F.concat(F.array_join(F.slice(words, 1, keep), " "), F.lit("...")),
    ).otherwise(_col(c))


def fixed_text(c, digits: int) -> Column:
    """Fixed-point text of a half-even rounded number."""
    return F.format_string(f"%.{digits}f", half_even(c, digits))


def percent_text(c) -> Column:
    return F.concat(F.rint(_col(c) * 100).cast("long").cast("string"), F.lit("%"))


def spaced(c) -> Column:
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


def title_name(c) -> Column:
    """`load_shift_v1` becomes `Load Shift`."""
    return F.initcap(spaced(F.replace(_col(c), F.lit("_v1"), F.lit(""))))


def iso_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# --- numbers -----------------------------------------------------------------------------
def to_number(c) -> Column:
    """Lenient text to double; anything unreadable, and NaN, is null."""
    n = F.try_cast(_col(c), "double") if hasattr(F, "try_cast") else _col(c).try_cast("double")
    return F.when(F.isnan(n), F.lit(None)).otherwise(n)


def half_even(c, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def stable_sum(c) -> Column:
    """Sum with the last bits settled, so that the order of partial sums cannot show."""
    return F.round(F.sum(_col(c)), 6)


def annual_factor(days: int) -> float:
    return 365.0 / max(days, 1)


def coded(c, codes: Mapping[str, int], default: int = 0) -> Column:
    table = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, _col(c)), F.lit(default))


# --- time --------------------------------------------------------------------------------
_OFFSET = r"([zZ]|[+-]\d{2}:?\d{2})\s*$"


def to_utc(text, zone) -> Column:
    """Instant of a timestamp text; text without an offset is read in the source's zone."""
    t = F.trim(_col(text).cast("string"))
    z = F.lit(zone) if isinstance(zone, str) else zone  # a zone name, or a column of names
    aware = F.try_to_timestamp(t)
    naive = F.to_utc_timestamp(F.try_to_timestamp(t), z)
    return F.when(t.rlike(_OFFSET), aware).otherwise(naive)


def hour_floor(ts) -> Column:
    return F.date_trunc("hour", _col(ts))


def hour_ceil(ts) -> Column:
    floor = hour_floor(ts)
    return F.when(floor == _col(ts), floor).otherwise(floor + F.expr("interval 1 hour"))


def iso_weekday(ts) -> Column:
    return F.weekday(_col(ts)) + 1


def minutes_between(start, end) -> Column:
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(6e7)


def days_before(as_of, days) -> Column:
    n = F.lit(days) if isinstance(days, int) else _col(days).cast("int")
    return _col(as_of) - F.make_dt_interval(n)


def hours_seq(first, last) -> Column:
    """Array of hours first..last; empty when last lies before first."""
    f, l = _col(first), _col(last)
    return F.when(f <= l, F.sequence(f, l, F.expr("interval 1 hour"))).otherwise(
        F.array().cast("array<timestamp>")
    )


# --- statuses ------------------------------------------------------------------------------
def status_rank(c) -> Column:
    return coded(c, {s: i for i, s in enumerate(STATUSES)})


def rank_status(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), _col(rank).cast("int") + 1)


# --- maps, json ------------------------------------------------------------------------------
def flag(mapping, key: str) -> Column:
    return F.coalesce(F.try_element_at(_col(mapping), F.lit(key)), F.lit(False))


def drop_null_entries(mapping) -> Column:
    return F.map_filter(_col(mapping), lambda k, v: v.isNotNull())
