"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the 13-word windows of the benchmark items (an item of fewer
words is one pattern).  The alphabet is the word: per pattern length a shift
table over blocks of two words says how far the scan may jump, a block that
ends some pattern selects a bucket of patterns, and these are compared word by
word.  A document that shares no word pair with the benchmark is read in steps
of twelve words.

Null and empty texts have no words and no hits; a benchmark row without words
is no pattern; repeated items count once, under each of their ids; a null
item_id is written ``null``.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import claim, id_col, keyed, public_id, schema_of, uid_col

#: Words per benchmark window.
WINDOW = 13
#: Benchmark bytes held in one search structure; more go into further passes.
BLOCK_BYTES = 8 << 20

#: ASCII bytes that are no letter and no digit separate words; A-Z become a-z.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else
    0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """Shift tables and suffix buckets for patterns of one word length."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]) -> None:
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                key = p[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(p[length - self.block:], []).append(p)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence, by start."""
        size, jump, length = self.block, self.jump, self.length
        shift, at, end = self.shift.get, length, len(text)
        while at <= end:
            key = tuple(text[at - size:at])
            step = shift(key, jump)
            if step:
                at += step
                continue
            window = tuple(text[at - length:at])
            for p in self.bucket[key]:
                if p == window:
                    yield at - length, p
            at += 1


def searchers(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One search structure per pattern length for (item_id, text) rows."""
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(w[i:i + n]), set()).add(item)
    return [WuManber(n, p) for n, p in sorted(by_length.items())]


def search(text: str | None, found: list[WuManber]) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, hit word ranges (merged, end exclusive) and item ids."""
    w = words(text)
    spans: list[list[int]] = []
    items: set[str] = set()
    for s in found:
        for start, p in s.find(w):
            items |= s.patterns[p]
            spans.append([start, start + s.length])
    return len(w), merge(spans), items


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES
                     ) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's distinct (item_id, text) rows in blocks of a bounded
    size.  Only one block is held on the driver at a time."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.length("text") > 0).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r.item, r.text) for r in rows.where(F.col("block") == b).collect()]


_FOUND = ("__doc long, __uid long, n_words long, spans array<array<int>>, items array<string>")


def _search_block(docs: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES
    schema = schema_of(docs.sparkSession, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        found = searchers(held.value)
        for batch in batches:
            got = [search(t, found) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"__doc": batch.column("__doc"), "__uid": batch.column("__uid"),
                 "n_words": [g[0] for g in got], "spans": [g[1] for g in got],
                 "items": [sorted(g[2]) for g in got]}, schema=schema)

    return docs.mapInArrow(run, _FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: ``n_words, spans, items`` (merged hit word ranges
    and the items found), keyed by ``__doc``/``__uid``."""
    texts = keyed(docs, "text")
    parts = [_search_block(texts, block) for block in benchmark_blocks(benchmark)]
    if len(parts) == 1:
        return parts[0]
    everything = parts[0]
    for p in parts[1:]:  # only rows with hits matter beyond the first block
        everything = everything.unionByName(p.where(F.size("spans") > 0).withColumn(
            "n_words", F.lit(None).cast("long")))
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        spans, F.expr("cast(array() as array<array<int>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s[0] <= F.element_at(acc, -1)[1]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(
                F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1])))),
        ).otherwise(F.concat(acc, F.array(s))))
    per = everything.groupBy("__doc", "__uid").agg(
        F.max("n_words").alias("n_words"), merged.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = texts.select("__doc", "__uid")  # a repeated row stays repeated
    return rows.join(per, ["__doc", "__uid"])


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    f = with_verdict(found)
    return f.select(
        public_id(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns kept.

    Repeated rows share a verdict; a shuffle is needed only when the benchmark
    takes several blocks.
    """
    blocks = list_if_single(benchmark)
    if blocks is None:
        bad = with_verdict(contamination(docs, benchmark)).where("contaminated").select(
            F.col("__doc").alias("__c_doc"), F.col("__uid").alias("__c_uid")).distinct()
        return docs.join(bad, (id_col() == F.col("__c_doc")) & (uid_col() == F.col("__c_uid")),
                         "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        found = searchers(held.value)
        for batch in batches:
            keep = []
            for t in batch.column("text").to_pylist():
                n, spans, _ = search(t, found)
                hit = sum(e - s for s, e in spans)
                keep.append(not (hit and 20 * hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def list_if_single(benchmark: DataFrame) -> list[tuple[str, str]] | None:
    """The whole benchmark if it fits one block, else None."""
    blocks = benchmark_blocks(benchmark)
    first = next(blocks)
    return first if next(blocks, None) is None else None
