"""vigil — a Spark-native topic-monitoring engine.

Landed source payloads become one results table; the monitoring workload
(seen-set anti-joins, within-run dedup, freshness, fair-share budgets,
state folds, capped indexes, digests and push queues) runs as DataFrame,
Spark SQL and Structured Streaming operators over it.
"""

__version__ = "0.1.0"
