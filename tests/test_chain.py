"""Chained poll runs against a sequential replay in plain Python."""

import datetime as dt
import json
import math
import re
from collections import defaultdict

from tests.conftest import SF_SMALL
from vigil.conventions import (BREAKER_COOLDOWN_HOURS, RETENTION_DAYS, RETENTION_DEFAULT_DAYS,
                               RUN_CAP, STALE_CUTOFF_DAYS)
from vigil.operators.breaker import BreakerMachine
from vigil.plans import registry
from vigil.sources import fixtures as fx

WEEK = dt.timedelta(days=7)


def monday(t):
    d = t.replace(hour=0, minute=0, second=0, microsecond=0)
    return d - dt.timedelta(days=d.weekday())


def outcome(r):
    """(class, score) of a reply row."""
    text = r.error_text
    if text is None:
        kind = "ok"
    elif r.error_class == "parse":
        kind = "retry" if r.attempt < 3 else "skip"
    elif "429" in text or "quota" in text.lower():
        hint = re.search(r"(?i)retry in (\d+(?:\.\d+)?)s", text)
        wait = hint and float(hint[1]) + 2
        kind = "wait" if hint and wait <= 300 and r.attempt < 3 else "abort"
    else:
        kind = "skip"
    try:
        score = json.loads(r.response).get("novelty_score")
    except ValueError:
        score = None
    return kind, score


def replay(spark):
    items = fx.fx_items(spark, SF_SMALL).collect()
    topics = {r.topic_ord: r for r in fx.fx_topics(spark).collect()}
    seen = defaultdict(list)
    for r in fx.fx_seen(spark, SF_SMALL).collect():
        seen[r.url].append((r.seen_at, r.source_type))
    reply = {r.event_id: outcome(r) for r in fx.fx_scores(spark, SF_SMALL).collect()}
    attempts = sorted(fx.fx_attempts(spark, SF_SMALL).collect(), key=lambda r: (r.ts, r.seq))
    machine, state, out = BreakerMachine(), {}, []
    epoch = dt.datetime(1970, 1, 1)
    us = lambda t: (t - epoch) // dt.timedelta(microseconds=1)
    for run in sorted({monday(r.fetched_at) for r in items}):
        now = run + WEEK
        closed = {k for k, s in state.items() if s[1] and (
            s[2] is None or us(now) - s[2] < BREAKER_COOLDOWN_HOURS * 3600 * 10 ** 6)}
        order = lambda r: (r.topic_ord, r.source_ord, r.term_ord, r.item_pos)
        taken, fresh = set(), defaultdict(list)
        for r in sorted((r for r in items if monday(r.fetched_at) == run), key=order):
            if (r.topic_name, r.source) in closed or r.url in taken:
                continue
            taken.add(r.url)
            if any(at < now < at + dt.timedelta(days=RETENTION_DAYS.get(
                    kind or "news", RETENTION_DEFAULT_DAYS) + 1) for at, kind in seen[r.url]):
                continue
            cutoff = STALE_CUTOFF_DAYS.get(r.source_type)
            if cutoff is not None and r.published_at is not None and \
                    now - r.published_at > dt.timedelta(days=cutoff):
                continue
            fresh[r.topic_ord].append(r)
        used, sent = 0, []
        for t in range(fx.N_TOPICS):
            budget = math.ceil((RUN_CAP - used) / (fx.N_TOPICS - t))
            sent += fresh[t][:budget]
            used += len(fresh[t][:budget])
        for r in sent:
            kind, score = reply[r.event_id]
            if kind == "abort":
                break
            if kind in ("ok", "wait", "retry") and score is not None and \
                    score >= topics[r.topic_ord].novelty_threshold:
                out.append((run, r.event_id))
                seen[r.url] = [(now, r.source_type)]
        for a in attempts:
            if run <= a.ts < now:
                k = (a.topic_name, a.adapter)
                state[k] = machine.step(state.get(k, machine.initial()), "attempt", us(a.ts),
                                        a.failed, None)[0]
    return out


def test_chain_equals_replay(spark):
    registry.load_all()
    got = registry.QUERIES["poll_chain"](spark, SF_SMALL).collect()
    expected = replay(spark)
    assert expected
    assert sorted((r.run_day[:10], r.event_id) for r in got) == sorted(
        (str(d)[:10], e) for d, e in expected)
