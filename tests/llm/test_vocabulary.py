"""Spelling variants, collocations and embedding links, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import cap_filters, collocations, spelling

DOCS = ("doc_id long, text string, lang string, word string, n long, key string, w1 string, k int, "
        "phrase string")


def documents(spark, rows):
    return spark.createDataFrame([(d, t, la, "x", 1, "y", "z", 2, "p") for d, t, la in rows], DOCS)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- spelling -------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_spelling(rows):
    total = Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= 3}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n.get(form[w])))
    return sorted(out, key=repr)


def spelling_rows(seed):
    rng = random.Random(seed)
    base = ["aaaaa", "aaaaaa", "abcabc", "résumé", "letters", "Ünique", "mississippi"]
    words = []
    for w in base:
        words += [w] * rng.randint(3, 40)
        for _ in range(25):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcsié")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]])
            words += [v] * rng.randint(1, 12)
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "1", "Ā"]).join(words[i * 20:i * 20 + 20]), "en")
            for i in range(len(words) // 20 + 1)]
    rows += [(None, "letters LETTERS Lettérs letter$letter Kelvin", None), (7, None, "en"),
             (8, "", None), (3, rows[3][1], "en"), (-9, "mississippi " * 500, "en")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_equals_brute_force(spark, seed):
    rows = spelling_rows(seed)
    got = as_rows(spelling.variants(documents(spark, rows).repartition(5)))
    assert got == brute_spelling(rows)
    assert sum(r[1] is not None for r in got) > 20


def test_spelling_across_scan_batches(spark, monkeypatch):
    """Groups cut by a batch, tasks that flush their words early."""
    rows = spelling_rows(3)
    monkeypatch.setattr(spelling, "ROWS", 64)
    monkeypatch.setattr(spelling, "HELD", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert as_rows(spelling.variants(documents(spark, rows))) == brute_spelling(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_spelling_without_words(spark):
    assert spelling.variants(documents(spark, [])).collect() == []
    assert spelling.variants(documents(spark, [(1, None, None), (2, "a bc", "x")])).collect() == []


# --- collocations -----------------------------------------------------------------

def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            ws = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    found = []
    for (lang, ph), a in f.items():
        if len(ph) < 2 or a < least:
            continue
        cuts = [(1000000 * a * a // (f[lang, ph[:k]] * f[lang, ph[k:]]), k) for k in range(1, len(ph))]
        score, k = min(cuts)
        found.append((lang, ph, a, f[lang, ph[:k]], f[lang, ph[k:]], score))
    longer = defaultdict(int)
    for lang, ph, a, *_ in found:
        if len(ph) == 3:
            for part in (ph[:2], ph[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    found = [x for x in found if len(x[1]) == 3 or 100 * longer[x[0], x[1]] < 50 * x[2]]
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang),
                      key=lambda x: (-x[5], -x[2], " ".join(x[1]).encode()))
        out += [(lang, i + 1, " ".join(ph), a, left, right, n[lang], score)
                for i, (_, ph, a, left, right, score) in enumerate(mine[:top])]
    return sorted(out, key=repr)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "a\u0085b", "x-y", "1", "\U0001f642", "Ä"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", ";\x0c"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "de", None, "und"])) for i in range(120)]
    rows += [(200 + i, "hot pair " * 40 + "of new york", "en") for i in range(60)]
    rows += [(500, None, "en"), (501, "", None), (502, ".,;\n", "fr"), (None, "only once here", "fr"),
             (3, rows[3][1], "en"), (503, "a b\nc " * 3000, "long")]
    return rows


@pytest.mark.parametrize("least,top", [(10, 2000), (2, 9), (3, 2000)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = phrase_rows(least)
    got = collocations.collocations(documents(spark, rows).repartition(6), least, top)
    assert as_rows(got) == brute_phrases(rows, least, top)


def test_phrases_across_borders(spark, monkeypatch):
    """Many partitions, small batches and early counts: sums cut everywhere."""
    rows = phrase_rows(7)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = as_rows(collocations.collocations(documents(spark, rows), 5, 2000))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_phrases(rows, 5, 2000)


def test_phrase_scores_are_exact(spark):
    a, left, right = 10 ** 13 - 7, 10 ** 14 + 3, 10 ** 13 + 1
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        collocations._score("a", "l", "r")).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None)])).collect() == []


# --- embeddings ---------------------------------------------------------------------

VECS = "vec_id long, embedding array<double>, label int, id long, node string, copies long, f long"


def vectors(spark, rows):
    plain = [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 0, 1, "n", 2, 3) for i, v in plain], VECS)


def brute_links(rows):
    good = [k for k, (_, v) in enumerate(rows) if v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for d in {len(rows[k][1]) for k in good}:
        at = [k for k in good if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in at])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= 0.9)):
            if i != j:
                links[at[i]].add(at[j])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        part, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        least = min((rows[j][0] for j in part), key=lambda i: (i is not None, i or 0))
        for j in part:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return sorted(out, key=repr)


def cloud(rng, centre, n, cosine):
    """n vectors at the cosine to the centre."""
    z = rng.standard_normal((n, len(centre)))
    c = centre / np.linalg.norm(centre)
    z -= (z @ c)[:, None] * c
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return cosine * c + np.sqrt(1 - cosine ** 2) * z


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), list(v)) for i, v in enumerate(rng.standard_normal((300, 32)))]
    for n, cosine in ((40, 0.99), (90, 0.985), (700, 0.99), (5, 0.98)):
        rows += [(len(rows) + i, list(v * rng.uniform(0.1, 9))) for i, v in enumerate(
            cloud(rng, rng.standard_normal(32), n, cosine))]
    rows += [(5000 + i, rows[7][1]) for i in range(120)] + [(7, rows[7][1])]  # copies, a repeated row
    rows += [(None, rows[9][1]), (9, rows[400][1]), (6001, None), (6002, []), (6003, [0.0] * 32),
             (6004, [1.0, None] * 16), (6005, [float("nan")] * 32), (6006, [float("inf")] + [1.0] * 31),
             (None, None), (6007, [1e200] * 32), (6008, [1e-200] * 32), (6009, [1.0] * 3),
             (6010, [2.0] * 3), (6011, [5.0]), (6012, [0.1]), (6013, [-1.0])]
    got = as_rows(cap_filters.dedup(vectors(spark, rows).repartition(5)))
    assert got == brute_links(rows)


def test_wide_clouds_and_small_blocks(spark, monkeypatch):
    """Clouds wider than a clique, blocks of a few rows, chains of links."""
    monkeypatch.setattr(cap_filters, "BLOCK", 16)
    monkeypatch.setattr(cap_filters, "SMALL", 4)
    monkeypatch.setattr(cap_filters, "ROWS", 50)
    rng = np.random.default_rng(4)
    rows = []
    for n, cosine in ((150, 0.965), (100, 0.975), (60, 0.972)):
        rows += [(len(rows) + i, list(v)) for i, v in enumerate(
            cloud(rng, rng.standard_normal(64), n, cosine))]
    expected = brute_links(rows)
    got = as_rows(cap_filters.dedup(vectors(spark, rows)))
    links, found = (sum(r[1] for r in x) for x in (expected, got))
    assert 0.97 * links <= found <= links
    assert {r[0]: r[2] for r in got} == {r[0]: r[2] for r in expected}


def test_recall_at_the_threshold():
    """Share of pairs at cosine 0.9 to 0.91 with a common filter."""
    rng = np.random.default_rng(5)
    for d in (8, 16, 64, 200):
        x = rng.standard_normal((300, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.concatenate([cloud(rng, v, 1, 0.905) for v in x])
        shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(
            cap_filters.decode(x), cap_filters.decode(y))]
        assert np.mean(shared) >= 0.95, d


def test_filters_are_all_that_a_vector_exceeds():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every, cut = cap_filters.codes(16)
    for v, got in zip(x, cap_filters.decode(x)):
        expected = []
        for t, (turn, halves) in enumerate(every):
            y = v.astype(np.float32) @ turn
            left, right = halves[0] @ y[:8], halves[1] @ y[8:]
            a, b = np.nonzero(left[:, None] + right[None, :] >= cut)
            expected += list((((16 * cap_filters.CODES + t) * cap_filters.WORDS) + a)
                             * cap_filters.WORDS + b)
        assert len(set(expected) ^ set(got.tolist())) <= 0.01 * len(expected) + 1
    assert all(np.all(np.diff(g) > 0) for g in cap_filters.decode(x))


def test_no_vectors(spark):
    assert cap_filters.dedup(vectors(spark, [])).collect() == []
    got = cap_filters.dedup(vectors(spark, [(3, None)])).collect()
    assert [tuple(r) for r in got] == [(3, 0, 3, True)]


def test_first_common():
    a = np.array([[1, 5, 9], [2, -1, -1], [4, 6, -1]])
    b = np.array([[0, 5, 9], [3, -1, -1], [6, -1, -1]])
    assert cap_filters._first_common(a, b).tolist() == [5, -1, 6]
