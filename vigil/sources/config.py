"""Topic configuration scans.

S32 validate_topics   importance ∈ {high, low}, urgency ∈ {urgent, high, medium, low};
    topic_records     JSON topic records, typed, with their defaults
S33 sources_for_tier  source entries of one polling tier (missing tier → none)
S34 request_plan      one request per term, feed, product, profile, subreddit or
                      place of a source entry, with the parameters a fetcher sends
S35 union_results     results of all sources, each tagged with its source order
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.conventions import AS_OF, NOVELTY_THRESHOLD_DEFAULT, PUSH_THRESHOLD_DEFAULT

# The accepted enumerations of a topic record.
IMPORTANCE = ["high", "low"]
URGENCY = ["urgent", "high", "medium", "low"]

ENTRY_TYPE = ("struct<source:string,terms:array<string>,filters:map<string,string>,"
              "subreddits:array<string>,profiles:array<string>>")
POLLING_TYPE = f"map<string,array<{ENTRY_TYPE}>>"

# Request parameters that a source is sent unless its entry's
# filters say otherwise (newest first wherever a source can sort).
REQUEST_DEFAULTS = {
    "gdelt": {"timespan": "1d"},
    "guardian": {"order-by": "newest", "page-size": "20"},
    "nytimes": {"sort": "newest"},
    "newsapi": {"sortBy": "publishedAt", "pageSize": "20"},
    "google_news": {"hl": "en-US", "gl": "US", "ceid": "US:en"},
    "reddit": {"sort": "new", "limit": "25"},
    "mastodon": {"type": "statuses", "limit": "20"},
    "bluesky": {"limit": "25"},
    "hacker_news": {"tags": "story", "hitsPerPage": "20"},
    "youtube": {"order": "date"},
    "ebay": {"limit": "20"},
    "etsy": {"limit": "25"},
    "grailed": {"hits_per_page": "20"},
    "mercari": {"pageSize": "30", "sort": "SORT_CREATED_TIME", "order": "ORDER_DESC"},
    "pubmed": {"retmax": "20", "sort": "date"},
    "arxiv": {"max_results": "20", "sortBy": "submittedDate", "sortOrder": "descending"},
    "semantic_scholar": {"limit": "20"},
    "adzuna": {"country": "us", "where": "New York", "results_per_page": "20",
               "sort_by": "date", "max_days_old": "14"},
    "indeed": {"l": "New York, NY", "radius": "25", "fromage": "14", "sort": "date",
               "limit": "25"},
    "tmdb": {"language": "en-US", "page": "1"},
    "email": {"limit": "20"},
}
# Days that a source's date window spans from the clock, and the
# filter that changes it.
AHEAD_DAYS, BACK_DAYS = ("days_ahead", 90), ("days_back", 7)
# The date field that upcoming titles are found by, per kind.
UPCOMING = {"movie": "primary_release_date", "tv": "first_air_date"}
REGION = ("region", "US")
# Filters of an entry that become request parameters.
REQUEST_FILTERS = {
    "gdelt": {"timespan": "timespan", "sourcelang": "sourcelang",
              "sourcecountry": "sourcecountry"},
    "guardian": {"section": "section", "from_date": "from-date"},
    "mastodon": {"instance": "instance"},
    "ebay": {"price_max": "price_max"},
    "pubmed": {"retmax": "retmax", "sort": "sort"},
    "arxiv": {"max_results": "max_results", "sort_by": "sortBy", "categories": "categories"},
    "semantic_scholar": {"limit": "limit", "year": "year"},
    "adzuna": {"country": "country", "location": "where", "sort_by": "sort_by",
               "results_per_page": "results_per_page", "max_days_old": "max_days_old"},
    "indeed": {"location": "l", "radius": "radius", "fromage": "fromage", "jt": "jt",
               "sort": "sort", "limit": "limit"},
    "tmdb": {"language": "language"},
    "email": {"max_emails": "limit"},
    "weather": {"lat": "latitude", "lon": "longitude"},
}
# The most that a source returns for one request.
REQUEST_CAPS = {("indeed", "limit"): 25, ("semantic_scholar", "limit"): 100}
# Sources that search for the topic's name instead of terms.
BY_NAME = ["ebay", "etsy", "grailed"]
# Sources that search for the topic's name where an entry has no terms.
NAME_WITHOUT_TERMS = ["mercari"]


def entry(source: Column, terms: Column, filters: Column | None = None,
          subreddits: Column | None = None, profiles: Column | None = None) -> Column:
    """A source entry of a topic record, lists and filters empty by default."""
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    return F.struct(source.alias("source"), terms.alias("terms"),
                    (empty if filters is None else filters).alias("filters"),
                    (none if subreddits is None else subreddits).alias("subreddits"),
                    (none if profiles is None else profiles).alias("profiles")).cast(ENTRY_TYPE)


def _nested(table: dict[str, dict[str, str]]) -> Column:
    return F.create_map(*(c for k, v in table.items() for c in (
        F.lit(k), F.create_map(*(F.lit(x) for kv in v.items() for x in kv)))))


# S32
def validate_topics(topics: DataFrame, key: str = "topic_id") -> DataFrame:
    """One row per violation: (key, field, value)."""
    checks = [("importance", IMPORTANCE), ("urgency", URGENCY)]
    parts = [topics.where(~F.coalesce(F.col(f).isin(*allowed), F.lit(False)))
             .select(key, F.lit(f).alias("field"), F.col(f).alias("value"))
             for f, allowed in checks]
    return reduce(DataFrame.unionByName, parts)


TOPIC_RECORD = (
    "name string, description string, importance string, urgency string, "
    f"source_categories array<string>, polling {POLLING_TYPE}, "
    "notifications struct<push:boolean,email:string,novelty_push_threshold:double>, "
    "llm_filter struct<novelty_threshold:double,tags:array<string>>, "
    "escalation struct<triggers:array<struct<tag:string,bump_to:string,duration_hours:double>>,"
    "auto_revert:boolean>")


def topic_records(raw: DataFrame, key: str = "topic_id", body: str = "json") -> DataFrame:
    """Topics from their JSON records, with what a record leaves out filled in:
    no name is ``<unnamed>``; lists, tiers and tags are empty, the thresholds
    their defaults, ``auto_revert`` is on, push off, mail not set.  A record
    that cannot be read is a topic with nothing but defaults and so fails
    ``validate_topics``."""
    t = F.from_json(F.col(body), TOPIC_RECORD, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    tiers = F.create_map().cast(POLLING_TYPE)
    triggers = F.array().cast("array<struct<tag:string,bump_to:string,duration_hours:double>>")

    def entries(found: Column) -> Column:  # a source entry may leave out all but its source
        return F.transform_values(found, lambda _, es: F.transform(F.coalesce(
            es, F.array().cast(f"array<{ENTRY_TYPE}>")), lambda e: F.struct(
            e["source"].alias("source"), F.coalesce(e["terms"], none).alias("terms"),
            F.coalesce(e["filters"], F.create_map().cast("map<string,string>")).alias("filters"),
            F.coalesce(e["subreddits"], none).alias("subreddits"),
            F.coalesce(e["profiles"], none).alias("profiles"))))

    return raw.withColumn("_t", t).select(
        key, F.coalesce("_t.name", F.lit("<unnamed>")).alias("name"),
        F.coalesce("_t.description", F.lit("")).alias("description"),
        F.col("_t.importance").alias("importance"), F.col("_t.urgency").alias("urgency"),
        F.coalesce("_t.source_categories", none).alias("source_categories"),
        entries(F.coalesce("_t.polling", tiers)).alias("polling"),
        F.coalesce("_t.notifications.push", F.lit(False)).alias("push"),
        F.col("_t.notifications.email").alias("email"),
        F.coalesce("_t.notifications.novelty_push_threshold", F.lit(PUSH_THRESHOLD_DEFAULT))
        .alias("push_threshold"),
        F.coalesce("_t.llm_filter.novelty_threshold", F.lit(NOVELTY_THRESHOLD_DEFAULT))
        .alias("novelty_threshold"),
        F.coalesce("_t.llm_filter.tags", none).alias("tags"),
        F.coalesce("_t.escalation.triggers", triggers).alias("triggers"),
        F.coalesce("_t.escalation.auto_revert", F.lit(True)).alias("auto_revert"))


# S33
def sources_for_tier(topics: DataFrame, tier: str, key: str = "topic_id") -> DataFrame:
    entries = F.try_element_at(F.col("polling"), F.lit(tier))
    return (topics.select(key, "name", F.posexplode(entries).alias("source_pos", "entry"))
            .select(key, "name", F.lit(tier).alias("tier"), "source_pos", "entry.*"))


# S34
def request_plan(sources: DataFrame, key: str = "topic_id", as_of=AS_OF) -> DataFrame:
    """Requests of each entry in order (``request_pos``): what is asked for
    (``unit``, ``value``) and the other parameters as sorted ``name=value``.

    Date windows run from the clock: upcoming titles (an entry without terms
    asks per kind) from today ``days_ahead``, preprints ``days_back`` until
    today (one interval per entry, whatever its terms)."""
    src = F.col("source")
    today = F.to_date(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp"))

    def window(of: tuple[str, int]) -> Column:
        return F.coalesce(F.try_element_at("filters", F.lit(of[0])).try_cast("int"), F.lit(of[1]))

    def iso(day: Column) -> Column:
        return F.date_format(day, "yyyy-MM-dd")

    def units(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("unit"), v.alias("value")))

    def listed(name: str) -> Column:
        return F.coalesce(F.from_json(F.try_element_at("filters", F.lit(name)), "array<string>"),
                          F.array().cast("array<string>"))

    terms = units("term", F.col("terms"))
    place = F.concat(F.try_element_at("filters", F.lit("lat")), F.lit(","),
                     F.try_element_at("filters", F.lit("lon")))
    wanted = (F.when(src.isin("rss", "substack") & (F.size(listed("feeds")) > 0),
                     units("feed", listed("feeds")))
              .when(src == "camelcamelcamel", units("asin", listed("asins")))
              .when(src == "reddit", F.concat(units("subreddit", F.col("subreddits")), terms))
              .when(src == "bluesky", F.concat(units("profile", F.col("profiles")), terms))
              .when(src == "weather", units("place", F.filter(
                  F.array(place), lambda p: p.isNotNull())))
              .when(src.isin(*BY_NAME) | (src.isin(*NAME_WITHOUT_TERMS) & (F.size("terms") == 0)),
                    units("topic", F.array("name")))
              .when((src == "tmdb") & (F.size("terms") == 0), units("discover", F.filter(
                  F.array(*map(F.lit, UPCOMING)), lambda kind: F.coalesce(
                      F.try_element_at("filters", F.lit("media_type")), F.lit("both")).isin("both")
                  | (kind == F.try_element_at("filters", F.lit("media_type"))))))
              .when(src.isin("biorxiv", "medrxiv"), units("interval", F.array(F.concat(
                  iso(F.date_sub(today, window(BACK_DAYS))), F.lit("/"), iso(today)))))
              .when(src == "email", units("mailbox", F.array(F.lit("unseen"))))
              .otherwise(terms))
    empty = F.create_map().cast("map<string,string>")
    names = F.coalesce(F.try_element_at(_nested(REQUEST_FILTERS), src), empty)
    given = F.map_from_entries(F.transform(
        F.filter(F.map_entries("filters"), lambda e: F.map_contains_key(names, e["key"])),
        lambda e: F.struct(F.try_element_at(names, e["key"]), e["value"])))
    defaults = F.map_filter(F.coalesce(F.try_element_at(_nested(REQUEST_DEFAULTS), src), empty),
                            lambda k, _: ~F.map_contains_key(given, k))
    caps = F.create_map(*(c for (s, p), n in REQUEST_CAPS.items()
                          for c in (F.lit(f"{s} {p}"), F.lit(n))))

    def capped(e: Column) -> Column:
        most = F.try_element_at(caps, F.concat(src, F.lit(" "), e["key"]))
        return F.when(most < e["value"].try_cast("int"), most.cast("string")).otherwise(e["value"])

    params = F.transform(F.map_entries(F.map_concat(defaults, given)),
                         lambda e: F.concat(e["key"], F.lit("="), capped(e)))

    def upcoming(kind: str, field: str) -> Column:
        until = iso(F.date_add(today, window(AHEAD_DAYS)))
        found = [F.concat(F.lit(f"{field}.gte="), iso(today)), F.concat(F.lit(f"{field}.lte="), until),
                 F.lit(f"sort_by={field}.asc")]
        if kind == "movie":  # broadcasts have no region
            found.append(F.concat(F.lit("region="), F.coalesce(
                F.try_element_at("filters", F.lit(REGION[0])), F.lit(REGION[1]))))
        return F.array(*found)

    unit, value = F.col("r.unit"), F.col("r.value")
    own = F.array().cast("array<string>")
    for kind, field in UPCOMING.items():
        own = F.when((unit == "discover") & (value == kind), upcoming(kind, field)).otherwise(own)
    return (sources.withColumn("_params", params)
            .select("*", F.posexplode(wanted).alias("request_pos", "r"))
            .select(key, "tier", "source_pos", "source", "request_pos", unit.alias("unit"),
                    value.alias("value"),
                    F.array_join(F.array_sort(F.concat("_params", own)), "&").alias("params")))


# S35
def union_results(*results: DataFrame) -> DataFrame:
    """Union of normalised results in list order (``source_rank`` = position)."""
    tagged = [r.withColumn("source_rank", F.lit(i)) for i, r in enumerate(results)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
