"""A stored Bloom filter beside the seen set.

Most fetched URLs are new, and yet an anti-join ships every one of them to meet
the seen set.  The filter says which URLs are surely unseen before any shuffle;
only the possible hits go on to the exact anti-join, so the rows are the same.

The filter is a table of bitmaps, one row per hash bucket of 32,768 bits, built
and merged by aggregates.  A run extends it with the URLs that it marks; a
pruned URL stays until the filter is built anew and costs a needless exact check
at most.  Its size is fixed by ``bits`` (2^26 bits: 2,048 rows, 8 MB), which is
what makes the broadcast safe; a seen set that fills it only lets more URLs
through to the exact check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.relational import new_items

BITS = 1 << 26
#: Seeds of the hash functions; each sets one bit per URL.
SEEDS = (11, 23)


def _place(key: str, seed: int, bits: int) -> Column:
    """A bit number from 1 on, as the bitmap functions count."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits)) + 1


def _bitmaps(keys: DataFrame, key: str, bits: int) -> DataFrame:
    place = F.explode(F.array(*[_place(key, s, bits) for s in SEEDS])).alias("place")
    places = keys.where(F.col(key).isNotNull()).select(place)
    return places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


def build(seen: DataFrame, key: str = "url", bits: int = BITS) -> DataFrame:
    """``bucket, bitmap`` of all keys."""
    return _bitmaps(seen, key, bits)


def extend(held: DataFrame, marked: DataFrame, key: str = "url", bits: int = BITS) -> DataFrame:
    """The filter after a run that marked more keys (same ``bits``)."""
    both = held.select("bucket", "bitmap").unionByName(_bitmaps(marked, key, bits))
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def with_possible(items: DataFrame, held: DataFrame, key: str = "url", bits: int = BITS,
                  name: str = "possible") -> DataFrame:
    """Adds whether the key may be in the filter (never false for one that is).
    A null key is in no set."""
    out, tests = items, []
    for i, seed in enumerate(SEEDS):
        place = _place(key, seed, bits)
        at = F.bitmap_bit_position(place)
        side = held.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}"))
        # at most bits / 32768 rows of 4 KB
        out = out.join(F.broadcast(side), F.bitmap_bucket_number(place) == F.col(f"_b{i}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(f"_m{i}"), F.floor(at / 8).cast("int") + 1, F.lit(1))),
                      16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    hit = reduce(lambda a, b: a & b, tests)
    return out.select(*[F.col(c) for c in items.columns], hit.alias(name))


def unseen(items: DataFrame, seen: DataFrame, held: DataFrame, key: str = "url",
           run_at: str | None = None, bits: int = BITS) -> DataFrame:
    """The rows of ``new_items(items, seen)``: those that the filter clears at
    once, and of the possible hits those that the seen set does not hold."""
    marked = with_possible(items, held, key, bits)
    clear = marked.where(~F.col("possible")).drop("possible")
    return clear.unionByName(new_items(marked.where("possible").drop("possible"), seen, key, run_at))
