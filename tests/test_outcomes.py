"""Attempt outcomes: feeds by their body, replies that never came."""

import datetime as dt

import pytest

from vigil.sources import outcomes as OC
from vigil.sources.feeds import indeed_failed

NOW = dt.datetime(2024, 1, 31)
PLAN = "run_id string, topic_name string, source_ord int, source string, value string"
LANDED = ("run_id string, topic_name string, source_ord int, source string, term string, "
          "kind string, fetched_ts timestamp, status string, body string")

BODIES = [
    ('<?xml version="1.0"?><rss><channel><title>x</title></channel></rss>', False),  # empty
    ("<feed><title>x</title></feed>", False),
    ("<feed><entry><title>a</title></entry></feed>", False),  # Atom
    ("<rss><channel><item><title>a</title></item></channel></rss>", False),
    ("<rss><channel><item><title>a</ti", False),  # breaks off, but has an entry
    ("<feed><entry", True),
    ('<?xml version="1.0"?><rss><chan', True),
    ("<rss><items>", True),
    ("", True), (None, True), ("no feed", True),
]


def test_feeds_fail_only_if_malformed_and_without_entries(spark):
    rows = [(i, b) for i, (b, _) in enumerate(BODIES)]
    got = indeed_failed(spark.createDataFrame(rows, "payload_id int, body string")).collect()
    assert {r.payload_id: r.failed for r in got} == {i: f for i, (_, f) in enumerate(BODIES)}


def outcomes(spark, plan, landed):
    got = OC.attempt_outcomes(spark.createDataFrame(plan, PLAN), spark.createDataFrame(landed, LANDED))
    return {(r.source, r.source_ord): (r.failed, r.n_requests, r.n_missing, r.n_payloads)
            for r in got.collect()}


def reply(source, status="ok", term="t", kind=None, body="{}", ord_=0):
    return ("r", "topic", ord_, source, term, kind, NOW, status, body)


@pytest.mark.parametrize("source,status,failed", [
    ("gdelt", "ok", False), ("gdelt", "malformed", True), ("gdelt", "error", True),
    ("guardian", "no_credentials", True), ("rss", "malformed", False), ("rss", "error", False),
    ("weather", "exception", True), ("hacker_news", "error", False), ("tmdb", "exception", True),
    ("gdelt", None, False)])
def test_status(spark, source, status, failed):
    got = outcomes(spark, [("r", "topic", 0, source, "t")], [reply(source, status)])
    assert got == {(source, 0): (failed, 1, 0, 1)}


def test_missing_replies(spark):
    plan = [("r", "topic", 0, s, v) for s in ("gdelt", "rss", "newsapi", "nytimes") for v in ("a", "b")]
    plan += [("r", "topic", 1, "gdelt", None), ("r", "topic", 0, "gdelt", "a")]  # repeated, no value
    landed = [reply("gdelt", term="a"), reply("rss", term="a"), reply("newsapi", term="a"),
              reply("newsapi", term="b"), reply("newsapi", term="b"),  # two pages
              reply("gdelt", term=None, ord_=1), reply("etsy", term="unplanned")]
    assert outcomes(spark, plan, landed) == {
        ("gdelt", 0): (True, 2, 1, 1), ("rss", 0): (False, 2, 1, 1),
        ("newsapi", 0): (False, 2, 0, 3), ("nytimes", 0): (True, 2, 2, 0),  # no credentials, say
        ("gdelt", 1): (False, 1, 0, 1), ("etsy", 0): (False, 0, 0, 1)}


def test_feeds_that_a_search_found(spark):
    plan = [("r", "topic", i, "substack", "t") for i in range(3)]
    landed = [reply("substack", "malformed", kind="feed", body="<"), reply("substack"),
              reply("substack", "malformed", ord_=1),
              reply("substack", "error", kind="feed", ord_=2)]
    got = outcomes(spark, plan, landed)
    assert [got["substack", i][0] for i in range(3)] == [False, True, True]


def test_nothing(spark):
    assert outcomes(spark, [], []) == {}
