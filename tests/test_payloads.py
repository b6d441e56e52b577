"""Normalisers on hand-written payloads in the forms that real sources send."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vigil.functions.dates import parse_feed_date
from vigil.functions.price import fixed2
from vigil.functions.text import strip_ws
from vigil.operators import budget, scoring, suggest
from vigil.operators.relational import new_items
from vigil.sources import adapters, feeds, json_api

SCHEMA = ("payload_id long, run_id string, topic_name string, source_ord int, source string, "
          "term string, filters map<string,string>, fetched_ts timestamp, status string, body string")
NOW = dt.datetime(2024, 1, 31)


def land(spark, body, source="x", filters=None, payload_id=1):
    text = body if isinstance(body, str) else json.dumps(body)
    return spark.createDataFrame([(payload_id, "r", "t", 0, source, "term", filters or {}, NOW,
                                   "ok", text)], SCHEMA)


def test_pubmed_reply_with_list_of_ids(spark):
    body = {"search": {"esearchresult": {"idlist": ["11", "12", "13"]}},
            "summary": {"result": {"uids": ["11", "12"], "11": {
                "title": "A", "source": "J", "pubdate": "2024 Jan 5", "authors": [{"name": "X Y"}]},
                "12": {"title": "B", "source": "K", "pubdate": "", "authors": []}}}}
    got = adapters.normalise("pubmed", land(spark, body, "pubmed")).orderBy("item_pos").collect()
    assert [(r.title, r.snippet) for r in got] == [("A", "X Y — J"), ("B", "K")]
    assert got[0].fetched_at == dt.datetime(2024, 1, 5)


def test_weather_stops_at_the_shortest_array(spark):
    body = {"daily": {"time": ["d1", "d2", "d3"], "weathercode": [95, 95], "precipitation_sum":
                      [1.0, 2.0, 3.0], "temperature_2m_max": [5.0, 6.0, 7.0]}}
    got = json_api.normalise_weather(land(spark, body, "weather", {"lat": "1", "lon": "2"})).collect()
    assert len(got) == 2 and all(r.title is not None for r in got)


def test_atom_in_rss_and_links_of_reddit(spark):
    atom = ("<feed><entry><title>T</title><link rel='self' href='https://s'/>"
            "<link rel='alternate' href='https://a'/><link rel='enclosure' href='https://e'/>"
            "<content>C</content><updated>2024-01-02T03:04:05Z</updated></entry></feed>")
    rss = feeds.normalise_rss(land(spark, atom)).collect()
    assert [(r.url, r.title, r.snippet, r.published_at) for r in rss] == [
        ("https://a", "T", "C", dt.datetime(2024, 1, 2, 3, 4, 5))]
    reddit = feeds.normalise_reddit(land(spark, atom)).collect()
    assert [(r.url, r.snippet, r.fetched_at) for r in reddit] == [
        ("https://a", "C", dt.datetime(2024, 1, 2, 3, 4, 5))]


def test_feed_dates(spark):
    cases = {"Tue, 02 Jan 2024 15:04:05 GMT": (15, 4, 5), "02 Jan 2024 15:04:05 +0200": (13, 4, 5),
             "2 Jan 24 10:04:05 EST": (15, 4, 5), "Tue, 2 Jan 2024 15:04 UT": (15, 4, 0),
             "Tue, 02 Jan 2024 15:04:05 Z": (15, 4, 5), "2024-01-02T15:04:05Z": (15, 4, 5),
             "Tuesday, 02 January 2024 15:04:05": (15, 4, 5)}
    df = spark.createDataFrame([(k,) for k in [*cases, "soon", "", "32 Jan 2024 10:00:00 GMT"]], "s string")
    got = {r.s: r.d for r in df.select("s", parse_feed_date("s").alias("d")).collect()}
    for k, (h, m, s) in cases.items():
        assert got[k] == dt.datetime(2024, 1, 2, h, m, s), k
    assert got["soon"] is None and got[""] is None and got["32 Jan 2024 10:00:00 GMT"] is None


def test_substack_search_forms_and_filters(spark):
    pubs = [{"subdomain": f"p{i}"} for i in range(9)]
    as_list = land(spark, pubs, "substack", {"max_pubs": "7"})
    assert feeds.substack_discovery(as_list).count() == 7
    as_object = land(spark, {"publications": pubs}, "substack")
    assert feeds.substack_discovery(as_object).count() == 5
    direct = land(spark, pubs, "substack", {"feeds": '["https://b", "https://a"]'})
    assert feeds.substack_discovery(direct).count() == 0
    assert [(r.feed_pos, r.feed_url) for r in feeds.substack_direct(direct).orderBy(
        "feed_pos").collect()] == [(0, "https://b"), (1, "https://a")]
    items = "".join(f"<item><title>t{i}</title><link>https://l/{i}</link></item>" for i in range(30))
    body = f"<rss><channel>{items}</channel></rss>"
    assert feeds.normalise_substack(land(spark, body, "substack")).count() == 10
    assert feeds.normalise_substack(land(spark, body, "substack", {"max_per_feed": "20"})).count() == 20


def test_preprints_honour_max_results(spark):
    papers = [{"doi": f"d{i}", "title": "the t", "abstract": "a", "authors": "A", "date": "2024-01-01"}
              for i in range(60)]
    for filters, n in (({}, 30), ({"max_results": "50"}, 50)):
        for server in ("biorxiv", "medrxiv"):
            got = adapters.normalise(server, land(spark, {"collection": papers}, server, filters))
            assert got.count() == n and got.first().url.startswith(f"https://www.{server}.org/")


def test_strip_and_two_decimals(spark):
    df = spark.createDataFrame([(" 　 a b \x1f\n", 0.125), ("x", 0.375), ("", 2.675)],
                               "s string, v double")
    got = df.select(strip_ws("s").alias("s"), fixed2("v").alias("v")).collect()
    assert [r.s for r in got] == ["a b", "x", ""]
    assert [r.v for r in got] == ["%.2f" % v for v in (0.125, 0.375, 2.675)]


def test_attempts_know_their_number_and_kind(spark):
    rows = [(1, "429 retry in 5s", "api", "wait"), (3, "429 retry in 5s", "api", "abort"),
            (1, "bad", "parse", "retry"), (3, "bad", "parse", "skip"),
            (1, "429 quota, JSON body", "api", "abort"), (1, "json service down", "api", "skip"),
            (1, "quota: retry in 400s", "api", "abort"), (2, None, None, "ok")]
    df = spark.createDataFrame(rows, "attempt int, error_text string, error_class string, want string")
    assert all(r["class"] == r.want for r in scoring.classify_attempts(df).collect())


def test_quota_order_is_the_run_order(spark):
    big = 2_000_000_000
    rows = [("r", 0, 0, 0, big, False), ("r", 0, 1, 0, 5, True), ("r", 1, 0, 0, 1, False)]
    df = spark.createDataFrame(rows, "run_id string, topic_ord long, source_ord long, term_ord long, "
                                     "item_pos long, abort boolean")
    df = df.withColumn("call_ord", F.struct("topic_ord", "source_ord", "term_ord", "item_pos"))
    assert sorted(r.item_pos for r in budget.quota_prefix(df).collect()) == [5, big]


def test_run_cap_override_order(monkeypatch):
    assert budget.run_cap() == 20
    monkeypatch.setenv("VIGIL_RUN_CAP", "7")
    assert budget.run_cap() == 7 and budget.run_cap(3) == 3


def test_seen_marks_count_from_their_time_on(spark):
    day = dt.datetime
    seen = spark.createDataFrame([("u", day(2024, 1, 10), "weather"), ("v", day(2024, 1, 1), None)],
                                 "url string, seen_at timestamp, source_type string")
    items = spark.createDataFrame([("u", day(2024, 1, 9)), ("u", day(2024, 1, 11)),
                                   ("u", day(2024, 1, 18)), ("v", day(2024, 3, 31, 23)),
                                   ("v", day(2024, 4, 1))], "url string, run_at timestamp")
    got = new_items(items, seen, run_at="run_at").collect()
    assert sorted((r.url, r.run_at) for r in got) == [
        ("u", day(2024, 1, 9)), ("u", day(2024, 1, 18)), ("v", day(2024, 4, 1))]


def test_overlap_counts_categories_not_rows(spark):
    topics = spark.createDataFrame([(0, ["a", "b"])], "topic_ord long, source_categories array<string>")
    library = spark.createDataFrame([("x", ["a"]), ("x", ["a"]), ("x", ["a"]), ("y", ["a", "b"])],
                                    "adapter string, categories array<string>")
    got = {r.adapter: (r["rank"], r.overlap) for r in suggest.suggest_sources(topics, library).collect()}
    assert got == {"y": (1, 2), "x": (2, 1)}


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A query with Python workers, started elsewhere without PYTHONPATH."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as e\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
            "print('ROWS', e.queries()['norm_playbill_jobs'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
