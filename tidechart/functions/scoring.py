"""Scores, times and identifiers as column functions. No function reads the clock: times are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_duration_s(c: Column) -> Column:
    """Seconds of an ISO-8601 duration in days, hours, minutes and seconds; null if it is none."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda g: F.coalesce(F.regexp_extract(c, pattern, g).try_cast("long"), F.lit(0))
    return F.when(c.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def snapshot_id(chart: Column, ms: Column, minutes: int = 30) -> Column:
    """chart@time, the time floored to `minutes` in UTC."""
    floored = F.floor(ms / (minutes * 60_000)) * (minutes * 60_000)
    at = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(floored).cast("timestamp_ntz")), "yyyyMMdd'T'HHmm")
    return F.concat(chart, F.lit("@"), at)


def salted_hash(c: Column, salt: str | None = None, n: int = 16) -> Column:
    """The first n hex digits of SHA-256 of salt:value, or of the value; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), c) if salt is not None else c, 256), 1, n)


def previous_rank(rank: Column, move: Column) -> Column:
    """The rank before a printed movement: '+2', '-1' or '='."""
    return F.when(move.rlike(r"^[+-]\d+$"), rank + move.try_cast("int")).when(move == "=", rank)


def week_period(title: Column, subtitle: Column) -> Column:
    """(start, end) of a printed date range such as '28.12 - 03.01.2026'; the year is the text's, never the clock's.

    A range that starts in a later month than it ends began in the year before.
    """
    both = F.concat_ws(" ", title, subtitle)
    pattern = r"(\d{1,2})[./](\d{1,2})(?:[./](\d{4}))?\s*[-–—]\s*(\d{1,2})[./](\d{1,2})[./](\d{4})"
    g = lambda k: F.regexp_extract(both, pattern, k)
    year = g(6).try_cast("int")
    first = F.coalesce(g(3).try_cast("int"), F.when(g(2).try_cast("int") > g(5).try_cast("int"), year - 1).otherwise(year))
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.struct(day(first, g(2), g(1)).alias("start"), day(year, g(5), g(4)).alias("end"))


def movement_direction(url: Column) -> Column:
    """up, down, same or new from an image's name; null if it says none."""
    name = F.lower(F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1))
    return F.when(name.rlike("up|rise|asc"), "up").when(name.rlike("down|fall|desc"), "down").when(name.rlike("same|equal|stay|keep"), "same").when(name.rlike("new"), "new")


def recency_decay(ts_ms: Column, as_of_ms: Column, tau_ms: float = 15 * 60_000.0) -> Column:
    return F.exp(-(as_of_ms - ts_ms) / F.lit(tau_ms))


def action_weight(action: Column, weights: dict[str, float] | None = None) -> Column:
    """What an action says: a like 2, a play 1, a skip -0.7, others nothing."""
    out = F.lit(0.0)
    for name, w in (weights or {"like": 2.0, "play": 1.0, "skip": -0.7}).items():
        out = F.when(action == name, F.lit(float(w))).otherwise(out)
    return out


def rank_points(rank: Column, size: Column, weight: Column) -> Column:
    return F.try_divide(weight * (size - rank + 1), size)


def rank_gain(rank: Column, previous: Column, size: Column, weight: Column) -> Column:
    """Places won over the previous rank, by size; null without one."""
    return F.when(previous > 0, F.try_divide(weight * (previous - rank), size))


def placement_score(position: Column) -> Column:
    return 1 / F.log2(position + 1)


def local_hour(ts: Column, zone: str) -> Column:
    return F.hour(F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz")))


def local_dow(ts: Column, zone: str) -> Column:
    """1 is Sunday."""
    return F.dayofweek(F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz")))


def doc_id(*cols: Column | str) -> Column:
    """The parts with | between them. A null part is a mark of its own, so that ids of different parts differ."""
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(r"\N")) for c in cols])


def record_type(given: Column, action: Column, rank: Column, chart_id: Column) -> Column:
    """The stated type, else what the filled fields say."""
    return F.coalesce(given, F.when(action.isNotNull() & (action != ""), "event").when((rank > 0) & chart_id.isNotNull(), "chart_entry"))
