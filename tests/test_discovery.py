"""Feed discovery equals the sequential rule, also for one very large entry."""

import json
import random

import pytest

from vigil.sources.feeds import substack_discovery

LANDED = ("payload_id long, run_id string, topic_name string, source_ord int, "
          "filters map<string,string>, body string")


def sequential(rows):
    out = {}
    for pid, run, topic, ord_, filters, body in sorted(rows, key=lambda r: r[0]):
        if "feeds" in filters:
            continue
        taken = out.setdefault((run, topic, ord_), [])
        new = 0
        for handle in body:
            if handle and handle not in {h for _, h in taken} and new < int(filters.get("max_pubs", 5)):
                taken.append((pid, handle))
                new += 1
    return sorted((*k, i, t, h) for k, v in out.items() for i, (t, h) in enumerate(v))


def frame(spark, rows):
    def reply(i, handles):
        pubs = [{("subdomain", "handle", "slug")[(i + j) % 3]: h} for j, h in enumerate(handles)]
        return json.dumps(pubs if i % 2 else {"publications": pubs})
    return spark.createDataFrame([(p, r, t, o, f, reply(p, b)) for p, r, t, o, f, b in rows], LANDED)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        filters = rng.choice([{}, {"max_pubs": "1"}, {"max_pubs": "2"}, {"feeds": "[]"}])
        body = [rng.choice(["", *[f"h{x}" for x in range(25)]]) for _ in range(rng.randrange(12))]
        rows.append((i, rng.choice(["r1", "r2"]), rng.choice(["a", "b"]), 0, filters, body))
    got = sorted((r.run_id, r.topic_name, r.source_ord, r.feed_pos, r.term_ord, r.handle)
                 for r in substack_discovery(frame(spark, rows)).collect())
    assert got == sequential(rows)


def test_a_chain_of_claims(spark):
    """Each term's cap leaves a handle to the next one."""
    rows = [(i, "r", "t", 0, {"max_pubs": "1"}, [f"h{i}", f"h{i + 1}"]) for i in range(0, 12)]
    rows += [(i + 20, "r", "t", 0, {"max_pubs": "1"}, ["h0", f"h{11 - i}", f"z{i}"]) for i in range(4)]
    got = sorted((r.run_id, r.topic_name, r.source_ord, r.feed_pos, r.term_ord, r.handle)
                 for r in substack_discovery(frame(spark, rows)).collect())
    assert got == sequential(rows)


def test_an_entry_of_100000_publications(spark):
    rng = random.Random(9)
    rows = [(i, "r", "t", 0, {}, [f"h{rng.randrange(60_000)}" for _ in range(20)]) for i in range(5000)]
    got = sorted((r.run_id, r.topic_name, r.source_ord, r.feed_pos, r.term_ord, r.handle)
                 for r in substack_discovery(frame(spark, rows)).collect())
    taken, expected = set(), []
    for pid, *_, body in rows:
        new = 0
        for h in body:
            if h not in taken and new < 5:
                taken.add(h)
                expected.append(("r", "t", 0, len(expected), pid, h))
                new += 1
    assert got == sorted(expected)
