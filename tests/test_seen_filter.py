"""The stored filter never loses a hit and clears nearly all new URLs."""

import datetime as dt

from pyspark.sql import functions as F

from vigil.operators import seen_filter as SF
from vigil.operators.relational import new_items

NOW = dt.datetime(2024, 1, 31)


def tables(spark, n):
    seen = spark.range(n).select(F.concat(F.lit("u"), (F.col("id") * 3).cast("string")).alias("url"),
                                 F.lit(NOW - dt.timedelta(days=3)).alias("seen_at"),
                                 F.when(F.col("id") % 2 == 0, "news").alias("source_type"))
    items = spark.range(3 * n).select("id", F.when(F.col("id") % 50 != 7, F.concat(
        F.lit("u"), F.col("id").cast("string"))).alias("url"), F.lit(NOW).alias("run_at"))
    hot = spark.range(n).select((F.col("id") + 10 ** 6).alias("id"), F.lit("u3").alias("url"),
                                F.lit(NOW).alias("run_at"))  # a third of all rows
    return items.unionByName(hot), seen


def ids(df):
    return sorted(r.id for r in df.collect())


def test_same_rows_as_the_plain_join(spark):
    items, seen = tables(spark, 2000)
    for bits in (1 << 15, 1 << 18, SF.BITS):  # overfull, fitting, production
        held = SF.extend(SF.build(seen.where("url < 'u3'"), bits=bits), seen.where("url >= 'u3'"),
                         bits=bits)
        for at in (None, "run_at"):
            assert ids(SF.unseen(items, seen, held, run_at=at, bits=bits)) == ids(
                new_items(items, seen, run_at=at))


def test_only_possible_hits_reach_the_join(spark):
    items, seen = tables(spark, 2000)
    held = SF.build(seen)
    marked = SF.with_possible(items, held)
    true = items.join(seen.select("url"), "url", "left_semi").count()
    possible = marked.where("possible").count()
    assert true <= possible <= true + 0.001 * marked.count()
    assert held.count() <= SF.BITS // 32768
    plan = marked.where("possible")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(url" not in plan


def test_empty_tables(spark):
    items, seen = tables(spark, 10)
    none = seen.limit(0)
    assert ids(SF.unseen(items, none, SF.build(none))) == ids(items)
    assert ids(SF.unseen(items.limit(0), seen, SF.build(seen))) == []
    grown = SF.extend(SF.build(none), seen)
    assert ids(SF.unseen(items, seen, grown)) == ids(new_items(items, seen))
