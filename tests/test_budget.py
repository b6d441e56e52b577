"""Fair-share budget: the blocked transfer-vector composition equals the
sequential recurrence, also when topics span many blocks."""

import math
import random

import pytest

from vigil.operators.budget import allocate_budget


def _sequential(counts, n_topics, cap):
    used, out = 0, {}
    for i in range(n_topics):
        left = n_topics - i
        budget = math.ceil((cap - used) / left) if left > 0 else 0
        n = counts.get(i, 0)
        sent = min(n, budget)
        if n:
            out[i] = (budget, used, sent)
        used += sent
    return out


@pytest.mark.parametrize("block", [1, 3, 5, 1024])
@pytest.mark.parametrize("cap", [7, 20])
def test_blocked_budget_equals_recurrence(spark, block, cap):
    rng = random.Random(block * 31 + cap)
    n_topics = 23
    runs = {}
    rows = []
    for run in ("a", "b", "c"):
        counts = {i: rng.choice([0, 0, 1, 2, 5, 40]) for i in range(n_topics)}
        counts = {k: v for k, v in counts.items() if v}
        runs[run] = counts
        rows += [(run, k, v) for k, v in counts.items()]
    df = spark.createDataFrame(rows, "run_id string, topic_ord long, n long")
    got = {(r.run_id, r.topic_ord): (r.budget, r.used_before, r.sent)
           for r in allocate_budget(df, n_topics, cap, run="run_id", block=block).collect()}
    want = {(run, k): v for run, c in runs.items() for k, v in _sequential(c, n_topics, cap).items()}
    assert got == want
