"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics.  Every group gets a
minimum-covariance-determinant estimate: starting from coordinate medians and
quartile ranges, concentration steps keep the 75 % of the group's rows nearest
in Mahalanobis distance and re-estimate mean and covariance from them; a
reweighting step and a scale correction follow.  Each step never raises the
covariance determinant.  All steps are grouped aggregates over all documents
(sums, products, quantile sketches), so a group of any size is combined before
it is shuffled and never gathered.

Most groups have no symbols, digits or repeats at all in most documents, so the
estimate alone would reject any document that has one.  A statistic's variance
therefore counts, in a document, as at least the variance that counting gives
to a share of that many words or lines; for long documents that vanishes.

Every (lang, source) pair has an estimate of its own, and so has every language
and the whole table.  From ``MIN_GROUP`` documents on, the pair's estimate counts
alone; with n documents below that it weighs n / ``MIN_GROUP``, and the rest is
its language's (which leans on the whole table's in the same way).  A table that
is too small for an estimate rejects nothing.

Null and empty texts have no words: all counts 0, base rules failed, not kept.
Null lang or source is a value of its own.  Repeated rows count as often as
they occur and get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vigil.llm.common import arrow_map, settled, written

#: Share of a group that the concentration steps keep.
SUBSET = 0.75
STEPS = 4
#: A document is an outlier beyond this quantile of the chi-square law, as a
#: normal score: the 0.999 quantile.
CUTOFF_Z = 3.0902

DIMS = ("size", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits")
P = len(DIMS)
#: Variance added to every statistic, so that a covariance has an inverse.
RIDGE = 0.02 ** 2
#: Documents from which a group's own estimate counts alone.
MIN_GROUP = 10 * P
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))


def text_statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    (with a word), n_capitals, n_digits (ASCII)."""
    if not text:
        return (0,) * 8
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # exactly the ASCII white space that separates words
    if not words:
        return (0,) * 8
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    capitals = len(joined) - len(joined.translate(None, _CAPITALS))
    digits = len(joined) - len(joined.translate(None, _DIGITS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), chars, symbols, dup, _repeated(words), lines, capitals, digits)


def _repeated(words: list[bytes]) -> int:
    """Words inside some 3-word window that occurs at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    k = len(number)
    if k < 1 << 20:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # three ids do not fit 63 bits: number the pairs first
        _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * k + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 2, bool)
    for d in range(3):
        cover[d:d + n] |= twice
    return int(cover.sum())


_STATS = ("doc_id long, lang string, source string, n_words long, word_chars long, "
          "n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
          "n_capitals long, n_digits long")


def statistics(docs: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in _STATS.split(", ")]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        got = [text_statistics(t) for t in batch.column("text").to_pylist()]
        columns = zip(*got)
        yield {**{c: batch.column(c) for c in names[:3]},
               **{c: list(v) for c, v in zip(names[3:], columns)}}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"),
                                 F.col("source").cast("string"), "text"), run, _STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words")
                                      > F.lit(50) * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds ``x``, the transformed statistics (null without words)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    x = F.array(F.log1p("n_words"), F.log(chars / n), F.sqrt(F.col("n_symbols") / n),
                F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
                F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_capitals") / chars),
                F.sqrt(F.col("n_digits") / chars))
    return stats.withColumn("x", F.when(F.col("n_words") > 0, x))


def grouped(stats: DataFrame) -> DataFrame:
    """Adds ``g``, the (lang, source) pair, and the groups around it: ``g1``, its
    language, and ``g0``, the whole table."""
    def label(level: str, *cols: str) -> Column:
        return F.concat(F.lit(level), *(F.concat(F.lit("\x00"), F.coalesce(F.concat(
            F.lit("="), F.col(c)), F.lit(""))) for c in cols))

    return stats.withColumns({"g": label("pair", "lang", "source"), "g1": label("lang", "lang"),
                              "g0": F.lit("all")})


def chi2_quantile(z: float, p: float | Column = P) -> float | Column:
    """Wilson-Hilferty quantile of the chi-square law at normal score z."""
    a = 2 / (9 * p)
    return p * (1 - a + z * a ** 0.5) ** 3


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``mu`` under ``inv``."""
    d = [F.get("x", F.lit(i)) - F.get("mu", F.lit(i)) for i in range(P)]
    terms = [F.get("inv", F.lit(i * P + j)) * d[i] * d[j] * F.lit(1.0 if i == j else 2.0)
             for i in range(P) for j in range(i, P)]
    return reduce(lambda a, b: a + b, terms)


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and regularised inverse covariance per group, one row each."""
    x = [F.get("x", F.lit(i)) for i in range(P)]
    sums = rows.groupBy("g").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(v) for v in x)).alias("s"),
        F.array(*(F.sum(x[i] * x[j]) for i in range(P) for j in range(P))).alias("ss"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ridge = RIDGE * np.eye(P)
        for f in frames:
            mu, inv, dof = [], [], []
            for n, s, ss in zip(f["n"], f["s"], f["ss"]):
                m = np.asarray(s, float) / n
                cov = np.asarray(ss, float).reshape(P, P) / n - np.outer(m, m)
                mu.append(m)
                cov = (cov + cov.T) / 2
                inv.append(np.linalg.inv(cov + ridge).ravel())
                # statistics that vary: a constant one adds nothing to the distance
                dof.append(max(1.0, float(np.trace(cov @ inv[-1].reshape(P, P)))))
            yield pd.DataFrame({"g": f["g"], "n": f["n"], "mu": mu, "inv": inv, "dof": dof})

    return sums.mapInPandas(
        solve, "g string, n long, mu array<double>, inv array<double>, dof double")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges as first location and (diagonal) scatter."""
    q = rows.groupBy("g").agg(F.count("*").alias("n"), F.array(*(
        F.percentile_approx(F.get("x", F.lit(i)), [0.25, 0.5, 0.75], 1000)
        for i in range(P))).alias("q"))
    mu = F.transform("q", lambda v: v[1])
    inv = [F.lit(0.0)] * (P * P)
    for i in range(P):
        spread = (F.get(F.get("q", F.lit(i)), F.lit(2)) - F.get(F.get("q", F.lit(i)), F.lit(0)))
        inv[i * P + i] = F.lit(1.0) / (F.pow(spread / 1.349, F.lit(2)) + F.lit(RIDGE))
    return q.select("g", "n", mu.alias("mu"), F.array(*inv).alias("inv"))


def estimates(rows: DataFrame) -> DataFrame:
    """MCD location, inverse scatter and scale per group from ``g``, ``x``."""
    params = written(_start(rows), "mcd-0")
    for step in range(STEPS):
        near = rows.join(params.select("g", "mu", "inv"), "g").withColumn("d", _distance())
        # cut: the distance that SUBSET of the group stays below
        cut = written(near.groupBy("g").agg(
            F.percentile_approx("d", SUBSET, 2000).alias("cut")), f"mcd-cut{step}")
        inner = near.join(cut, "g").where(F.col("d") <= F.col("cut")).select("g", "x")
        params = written(_moments(inner), f"mcd-{step + 1}")
    params = written(_scaled(rows, params), "mcd-scaled")
    near = rows.join(params, "g").where(
        _distance() <= F.col("scale") * chi2_quantile(1.96)).select("g", "x")
    return written(_scaled(rows, written(_moments(near), "mcd-last")), "mcd")


def _scaled(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``scale`` brings the group's median distance to the chi-square median of
    the statistics that vary in it."""
    d = rows.join(params.select("g", "mu", "inv"), "g").groupBy("g").agg(
        F.count("*").alias("n"), F.percentile_approx(_distance(), 0.5, 2000).alias("m"))
    return params.drop("n").join(d, "g").select(
        "g", "n", "mu", "inv", (F.col("m") / chi2_quantile(0.0, F.col("dof"))).alias("scale"))


def _shrunk(names: DataFrame, params: DataFrame, min_group: int) -> DataFrame:
    """Location and scaled scatter per pair, leaning on its language and on the
    whole table as far as documents are missing."""
    def level(g: str, tag: str) -> DataFrame:
        return params.select(F.col("g").alias(g), *(
            F.col(c).alias(c + tag) for c in ("n", "mu", "inv", "scale")))

    every = names.join(level("g", "2"), "g").join(level("g1", "1"), "g1").join(
        F.broadcast(level("g0", "0")), "g0")

    def lean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mus, covs = [], []
            for r in f.itertuples(index=False):
                mu = cov = 0.0
                for tag in "012":
                    n = getattr(r, "n" + tag)
                    share = 1.0 if tag == "0" else min(1.0, n / min_group)
                    own = np.linalg.inv(np.reshape(getattr(r, "inv" + tag), (P, P)).astype(float))
                    own -= RIDGE * np.eye(P)
                    mu = (1 - share) * mu + share * np.asarray(getattr(r, "mu" + tag), float)
                    cov = (1 - share) * cov + share * getattr(r, "scale" + tag) * own
                mus.append(mu)
                covs.append((cov + RIDGE * np.eye(P)).ravel())
            yield pd.DataFrame({"g": f["g"], "n": f["n0"], "mu": mus, "cov": covs})

    return every.mapInPandas(lean, "g string, n long, mu array<double>, cov array<double>")


@F.pandas_udf(DoubleType())
def _judged(x: pd.Series, mu: pd.Series, cov: pd.Series, n_words: pd.Series,
            n_lines: pd.Series) -> pd.Series:
    """Squared distances, each statistic's variance counting as its share's own
    sampling variance at least (a square root's is 1 / 4n; a repeat is six words)."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero((x.notna() & mu.notna()).to_numpy())
    if len(at):
        gap = np.stack(x.iloc[at].to_list()) - np.stack(mu.iloc[at].to_list())
        c = np.stack(cov.iloc[at].to_list()).reshape(-1, P, P).copy()
        words, lines = n_words.to_numpy(float)[at], n_lines.to_numpy(float)[at]
        least = np.outer(0.25 / words, (0, 1, 1, 0, 6, 1, 1))
        least[:, DIMS.index("dup_lines")] = 0.25 / lines
        i = np.arange(P)
        c[:, i, i] += np.maximum(least - c[:, i, i], 0)
        out[at] = (gap * np.linalg.solve(c, gap[:, :, None])[:, :, 0]).sum(axis=1)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def verdicts(docs: DataFrame, min_group: int = MIN_GROUP, cutoff_z: float = CUTOFF_Z) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (squared, scaled) and ``kept``."""
    full = written(grouped(vectors(statistics(docs))), "text-stats")
    rows = full.where(F.col("x").isNotNull())

    def build() -> DataFrame:
        params = estimates(rows.select(F.explode(F.array("g", "g1", "g0")).alias("g"), "x"))
        return _shrunk(rows.select("g", "g1", "g0").distinct(), params, min_group)

    params = settled(docs.sparkSession, "mcd-final", build)
    judged = full.join(params, "g", "left").withColumn(
        "distance", _judged("x", "mu", "cov", "n_words", "n_lines"))
    far = (F.col("distance") > chi2_quantile(cutoff_z)) & (F.col("n") >= 10 * P)
    failed = base_failed()
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "n_lines", "n_capitals", "n_digits", failed.alias("base_failed"),
        "distance", (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")
