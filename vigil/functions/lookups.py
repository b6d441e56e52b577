"""Small fixed lookups (F13, F15, F16, F18, F19, F20) as literal maps or
CASE chains — they compile into the generated code, no join needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.conventions import PUSH_PRIORITY, PUSH_PRIORITY_DEFAULT, URGENCY_RANK

# --- Fixed values -----------------------------------------------------------
# WMO weather codes → description.
WEATHER_CODES = {
    0: "clear sky",
    1: "mainly clear", 2: "partly cloudy", 3: "overcast",
    45: "fog", 48: "icy fog",
    51: "light drizzle", 53: "drizzle", 55: "heavy drizzle",
    61: "light rain", 63: "rain", 65: "heavy rain",
    71: "light snow", 73: "snow", 75: "heavy snow", 77: "snow grains",
    80: "rain showers", 81: "heavy showers", 82: "violent showers",
    85: "snow showers", 86: "heavy snow showers",
    95: "thunderstorm",
    96: "thunderstorm with hail", 99: "severe thunderstorm with hail",
}
# Codes worth surfacing as a result.
NOTABLE_CODES = [45, 48, 65, 73, 75, 77, 80, 81, 82, 85, 86, 95, 96, 99]

# Topic icon: first key (in this order) contained in the lower-cased name.
TOPIC_ICONS = [
    ("jobs", "💼"),
    ("shopping", "🛍"),
    ("film", "🎬"),
    ("drag", "👑"),
    ("queer", "🏳️‍🌈"),
    ("immigration", "⚠️"),
    ("health", "🔬"),
    ("politics", "🌐"),
    ("queens", "🗺"),
    ("substack", "📬"),
    ("ai", "🤖"),
    ("nyc", "🗽"),
    ("theater", "🎭"),
]
TOPIC_ICON_DEFAULT = "📌"
# -----------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# F13
def weather_text(code: Column | str) -> Column:
    code = _c(code)
    return F.coalesce(F.try_element_at(_map(WEATHER_CODES), code.cast("int")),
                      F.concat(F.lit("weather code "), code.cast("string")))


def weather_notable(code: Column | str) -> Column:
    return _c(code).cast("int").isin(*NOTABLE_CODES)


def weather_codes(spark: SparkSession) -> DataFrame:
    """The code dimension as a table (24 rows) for joins."""
    rows = [(k, v, k in NOTABLE_CODES) for k, v in WEATHER_CODES.items()]
    return spark.createDataFrame(rows, "code int, description string, notable boolean")


def capitalize_first(c: Column | str) -> Column:
    """Upper-case only the first character (``light rain`` → ``Light rain``)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


# F15
def topic_icon(name: Column | str) -> Column:
    low = F.lower(_c(name))
    out = F.lit(TOPIC_ICON_DEFAULT)
    for key, icon in reversed(TOPIC_ICONS):
        out = F.when(F.contains(low, F.lit(key)), F.lit(icon)).otherwise(out)
    return out


# F16
def score_band(score: Column | str) -> Column:
    s = _c(score)
    return (F.when(s.isNull(), "muted").when(s >= 0.75, "green")
            .when(s >= 0.55, "yellow").otherwise("red"))


# F18
def novelty_dot(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.9, "green").when(s >= 0.8, "yellow")


# F19
def urgency_rank(level: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(URGENCY_RANK), _c(level)), F.lit(0))


def push_priority(level: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_map(PUSH_PRIORITY), _c(level)),
                      F.lit(PUSH_PRIORITY_DEFAULT))


def rank_level(rank: Column | str) -> Column:
    inv = {v: k for k, v in URGENCY_RANK.items()}
    return F.try_element_at(_map(inv), _c(rank))


# F20
def topic_hue(name: Column | str) -> Column:
    """A colour angle from the name (the first 32 bits of its MD5)."""
    return F.conv(F.substring(F.md5(_c(name).cast("binary")), 1, 8), 16, 10).cast("bigint") % 360
