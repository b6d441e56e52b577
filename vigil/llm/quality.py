"""Quality classifier: hierarchical empirical Bayes over sites.

A logistic classifier (numpy, trained on a bounded sample of the labelled
documents) turns each document's statistics into evidence, the log likelihood
ratio of good against bad.  Sites add what their other documents say: the good
share of a path is shrunk toward that of its host, and a host's toward the
global share,

    host = (good_host + k_host * global) / (n_host + k_host)
    path = (good_path + k_path * host)   / (n_path + k_path)

where a document counts with its label if that may be learned from, else with
the classifier's probability, and never for itself.  The prior strengths k are
empirical Bayes estimates (method of moments) from the spread between sites
beyond what sampling explains.  Everything about sites is a grouped aggregate
over all documents, combined before the shuffle; a host may hold any share of
the rows.

The posterior is logit(path) + evidence.  The threshold is calibrated: the
highest at which the required share of good labelled documents is kept.
Labels of documents in the held-out fold (crc32 of the doc_id as text, mod 3
equal to 1) are never used.

Null and empty texts have no evidence, quality 0 and are not kept.  A null
host or path is a value of its own.  Several labels of one doc_id count as
their mean, rounded up at one half; null labels do not count.  Without both
kinds of label nothing can be learned: quality is the global share (one half
without any label) and every document with words is kept.  Rows equal in
doc_id and text are separate documents of their site.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import ID, arrow_map, id_col, public_id, written

#: Bound of the labelled sample.
SAMPLE = 20_000
#: Share of good labelled documents that the threshold keeps.
KEEP = 0.998
#: Prior strengths stay in this range.
K_RANGE = (1.0, 1e4)
FEATURES = ("log_words", "word_length", "symbols", "capitals", "digits", "distinct_words",
            "adjacent_repeats", "distinct_lines", "line_words", "punctuation")

_SYMBOLS = b"#*$%&|<>"
_PUNCT = b"!?;:,."
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))


def features(text: str | None) -> list[float] | None:
    """Statistics of a whole text; null without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return None
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (size - len(data.translate(None, chars))) / size

    return [float(np.log1p(n)), float(np.log(sum(map(len, words)) / n)), share(_SYMBOLS) ** 0.5,
            share(_CAPITALS) ** 0.5, share(_DIGITS) ** 0.5, len(set(words)) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, len(set(lines)) / len(lines),
            float(np.log1p(n / len(lines))), share(_PUNCT) ** 0.5]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first is the constant
    share: float  # good share of the sample

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -30, 30)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Classifier:
    """Ridge-penalised logistic regression on the statistics and their
    squares, by Newton steps."""
    c = Classifier(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), np.zeros(0), float(y.mean()))
    d = c.design(x)
    c.weights = np.zeros(d.shape[1])
    penalty = np.eye(d.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ c.weights, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(d.T @ (d * w[:, None]) + penalty,
                               d.T @ (y - p) - penalty @ c.weights)
        c.weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return c


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(public_id().cast("string").cast("binary")),
                             F.lit(3)) == 1, F.lit(False))


def statistics(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    schema = f"{ID} long, host string, path string, x array<double>"

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {**{c: batch.column(c) for c in (ID, "host", "path")},
               "x": [features(t) for t in batch.column("text").to_pylist()]}

    rows = docs.select(id_col().alias(ID), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), "text")
    return arrow_map(rows, run, schema)


def with_labels(rows: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """Adds ``label`` (null if unknown or held out) and ``held_out``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias(ID)).agg(
        (F.avg(target) >= 0.5).cast("int").alias("label"))
    return rows.withColumn("held_out", held_out()).join(known, ID, "left").withColumn(
        "label", F.when(~F.col("held_out"), F.col("label")))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    got = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).select(
        ID, "x", "label").orderBy(F.xxhash64(ID), "x").limit(sample).collect()
    y = np.array([r.label for r in got], float)
    if len(set(y)) < 2:
        return None
    return train(np.array([r.x for r in got]), y)


def logits(rows: DataFrame, model: Classifier) -> DataFrame:
    """Adds ``z``, the classifier's logit (null without words), as SQL over
    the few weights."""
    n = len(FEATURES)
    z = F.lit(float(model.weights[0]))
    for i in range(n):
        v = (F.get("x", F.lit(i)) - F.lit(float(model.mean[i]))) / F.lit(float(model.scale[i]))
        z = z + F.lit(float(model.weights[1 + i])) * v + F.lit(
            float(model.weights[1 + n + i])) * v * v
    return rows.withColumn("z", F.when(F.col("x").isNotNull(), F.greatest(
        F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _strength(groups: DataFrame) -> float:
    """Moment estimate of the prior strength from groups with (n, good, m): m
    is the mean that each group is shrunk toward."""
    r = groups.where(F.col("n") >= 2).agg(
        F.sum("n").alias("n"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), F.lit(2))).alias("ss"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("noise"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("v")).first()
    if not r["groups"]:
        return K_RANGE[1]
    between = (r["ss"] - r["noise"]) / r["n"]  # spread beyond sampling
    within = r["v"] / r["n"]
    k = within / between - 1 if between > 0 else K_RANGE[1]
    return float(min(max(k, K_RANGE[0]), K_RANGE[1]))


def posteriors(rows: DataFrame) -> DataFrame:
    """Adds ``prior`` (the shrunken good share of the document's path without
    the document itself) to rows with ``z`` and ``label``."""
    p = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-F.col("z"))))
    rows = rows.withColumn("good", p)
    seen = rows.where(F.col("good").isNotNull())
    paths = written(seen.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("good").alias("good")), "site-paths")
    hosts = written(paths.groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")), "site-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    m = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    k_host = _strength(hosts.withColumn("m", F.lit(float(m))))
    shrunk = hosts.select(F.col("host").alias("h"), (
        (F.col("good") + k_host * m) / (F.col("n") + k_host)).alias("m"))
    k_path = _strength(paths.join(shrunk, F.col("host").eqNullSafe(F.col("h"))))
    sites = written(paths.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"),
                                 F.col("n").alias("n_path"), F.col("good").alias("g_path")).join(
        hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"),
                     F.col("good").alias("g_host")), F.col("s_host").eqNullSafe(F.col("h"))
    ).drop("h"), "sites")
    own = F.coalesce(F.col("good"), F.lit(0.0))
    one = F.when(F.col("good").isNotNull(), 1).otherwise(0)

    def shrink(good: str, n: str, k: float, toward: Column) -> Column:
        return (F.greatest(F.col(good) - own, F.lit(0.0)) + F.lit(k) * toward) / (
            F.col(n) - one + F.lit(k))

    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("s_host"))
                       & F.col("path").eqNullSafe(F.col("s_path")), "left")
    host = F.coalesce(shrink("g_host", "n_host", k_host, F.lit(float(m))), F.lit(float(m)))
    prior = F.coalesce(shrink("g_path", "n_path", k_path, host), host)
    return joined.withColumn("prior", F.greatest(F.least(prior, F.lit(1 - 1e-6)), F.lit(1e-6)))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None,
             path: Column | None = None, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """``doc_id, held_out, score`` (classifier), ``prior``, ``quality``
    (posterior) and ``kept``.  By default the host is ``source`` and the path
    below it ``lang``."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = written(with_labels(statistics(docs, host, path), labels), "quality-stats")
    model = fit(rows, sample)
    if model is None:
        share = rows.agg(F.avg("label")).first()[0]
        words = F.col("x").isNotNull()
        flat = F.when(words, F.lit(float(0.5 if share is None else share))).otherwise(0.0)
        return rows.select(public_id(), "held_out", flat.alias("score"),
                           flat.alias("prior"), flat.alias("quality"), words.alias("kept"))
    offset = float(np.log(model.share / (1 - model.share)))
    full = posteriors(logits(rows, model)).withColumn(
        "logit", F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("z") - F.lit(offset))
    full = written(full.select(ID, "held_out", "label", "z", "prior", "logit"), "quality-logits")
    cut = full.where((F.col("label") == 1) & F.col("logit").isNotNull()).agg(
        F.percentile_approx("logit", 1 - keep, 100_000)).first()[0]
    cut = min(0.0, cut) if cut is not None else 0.0

    def sigmoid(c: str) -> Column:
        return F.coalesce(1 / (1 + F.exp(-F.col(c))), F.lit(0.0))

    return full.select(public_id(), "held_out", sigmoid("z").alias("score"), "prior",
                       sigmoid("logit").alias("quality"),
                       F.coalesce(F.col("logit") >= F.lit(float(cut)), F.lit(False)).alias("kept"))
