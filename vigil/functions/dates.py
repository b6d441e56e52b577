"""Date parsing and formatting (F08–F11, F17).  Every parse is a ``try_*``
built-in, so a bad value becomes NULL (then the caller's fallback) instead
of failing the task under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.text import strip_ws

# Month abbreviations of partial dates.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
          "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


# F08
def parse_iso(c: Column | str, as_of=None) -> Column:
    """ISO-8601 with ``Z``, ``+00:00`` or ``+0000``; invalid → ``as_of``."""
    parsed = _c(c).try_cast("timestamp")
    return parsed if as_of is None else F.coalesce(parsed, _ts(as_of))


# F10
def parse_compact_date(c: Column | str, as_of=None) -> Column:
    """``20260323T100000Z`` style; invalid → ``as_of``."""
    parsed = F.try_to_timestamp(_c(c), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return parsed if as_of is None else F.coalesce(parsed, _ts(as_of))


# F09
def parse_pubmed_date(c: Column | str, as_of=None) -> Column:
    """``Y``, ``Y Mon`` or ``Y Mon D`` (unknown month → January); any other
    failure → ``as_of``."""
    parts = F.split(strip_ws(_c(c)), r"\s+")
    n = F.size(parts)
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    mon_key = F.lower(F.substring(F.try_element_at(parts, F.lit(2)), 1, 3))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.when(n > 1, F.coalesce(F.try_element_at(months, mon_key), F.lit(1))).otherwise(1)
    day = F.when(n > 2, F.try_element_at(parts, F.lit(3)).try_cast("int")).otherwise(1)
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    ok = year.isNotNull() & day.isNotNull() & (year >= 1) & (year <= 9999) & (day >= 1)
    parsed = F.when(ok, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    # try_to_timestamp rolls no dates over: 2024-02-30 is NULL
    return parsed if as_of is None else F.coalesce(parsed, _ts(as_of))


# F11
# Offsets of the zone names that feeds use (RFC 822).
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500",
         "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
         "PST": "-0800", "PDT": "-0700"}
_RFC822 = (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4}|\d{2})\s+"
           r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([A-Za-z]{1,4}|[+-]\d{4})?$")


def parse_feed_date(c: Column | str) -> Column:
    """RFC 822 (weekday and seconds optional, two- or four-digit year, zone as
    offset or name, none is UTC; years 69-99 are 19xx) or ISO (Atom)."""
    body = strip_ws(_c(c))

    def part(i: int) -> Column:
        return F.regexp_extract(body, _RFC822, i)

    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    zones = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    y = part(3)
    year = F.when(F.length(y) == 2, F.concat(F.when(y >= "69", F.lit("19")).otherwise(
        F.lit("20")), y)).otherwise(y)
    zone = F.when(part(7).rlike(r"^[+-]\d{4}$"), part(7)).when(part(7) == "", F.lit("+0000")) \
        .otherwise(F.try_element_at(zones, F.upper(part(7))))
    text = F.concat(year, F.lit("-"),
                    F.lpad(F.try_element_at(months, F.lower(part(2))).cast("string"), 2, "0"),
                    F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "), F.lpad(part(4), 2, "0"),
                    F.lit(":"), part(5), F.lit(":"),
                    F.when(part(6) == "", F.lit("00")).otherwise(part(6)), zone)
    return F.coalesce(F.when(part(1) != "", F.try_to_timestamp(
        text, F.lit("yyyy-MM-dd HH:mm:ssZ"))), body.try_cast("timestamp"))


# F17
def relative_time(ts: Column | str, as_of) -> Column:
    """``Xm ago`` under an hour, ``Xh ago`` up to 48 h, else ``MMM d``."""
    ts = _c(ts)
    secs = F.unix_timestamp(_ts(as_of)) - F.unix_timestamp(ts)
    return (F.when(secs < 3600, F.concat((F.floor(secs / 60)).cast("string"), F.lit("m ago")))
            .when(secs <= 48 * 3600, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
            .otherwise(F.date_format(ts, "MMM d")))


def ts_text(c: Column | str) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
