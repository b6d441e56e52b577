"""Clock, order and dimension constants shared by all operators.

Every operator takes an explicit ``as_of`` instant and an explicit row
order; nothing depends on wall-clock time or partition order.
"""

from __future__ import annotations

import datetime as _dt

# Default clock of the fixture views: all driver events are before it.
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

# Row order of a run: topic, then source, then term, then item position.
ORD_COLS = ("topic_ord", "source_ord", "term_ord", "item_pos")

# ---------------------------------------------------------------------------
# Fixed values that must equal the monitored behaviour for right results.
# ---------------------------------------------------------------------------

# Seen-set retention in days by source type; any other type keeps 90 days.
RETENTION_DAYS = {
    "news": 90,
    "social": 90,
    "shopping": 365,
    "video": 90,
    "feeds": 90,
    "weather": 7,
    "science": 365,
    "jobs": 30,
    "entertainment": 180,
}
RETENTION_DEFAULT_DAYS = 90

# Staleness cutoffs in days; other types are never stale.
STALE_CUTOFF_DAYS = {"news": 7, "feeds": 7, "social": 7, "science": 30}

# Urgency ranking (unknown levels rank 0).
URGENCY_RANK = {"low": 0, "medium": 1, "high": 2, "urgent": 3}

# Tier names by urgency, indexed by tier_index; unknown urgency uses
# the single "discovery" tier.
TIER_MAP = {
    "urgent": ["frequent", "discovery", "broad", "broad"],
    "high": ["frequent", "discovery", "broad", "broad"],
    "medium": ["discovery", "broad", "broad"],
    "low": ["broad", "broad"],
}
TIER_DEFAULT = ["discovery"]

# Push priority by urgency (unknown → 4).
PUSH_PRIORITY = {"urgent": 5, "high": 4, "medium": 3, "low": 2}
PUSH_PRIORITY_DEFAULT = 4

# Breaker: failures that open the circuit, and the cooldown before retry.
BREAKER_THRESHOLD = 5
BREAKER_COOLDOWN_HOURS = 6

# Index size per topic and default per-run scoring cap.
INDEX_MAX = 100
RUN_CAP = 20

# Defaults of a topic record.
NOVELTY_THRESHOLD_DEFAULT = 0.65
PUSH_THRESHOLD_DEFAULT = 0.7
TRIGGER_DURATION_HOURS_DEFAULT = 24.0
