"""The operators that compare documents, against plain versions."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm import cases
from vigil.llm import line_dedup, near_dup, quality, queries, suffix_dedup
from vigil.llm.common import read_table


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- line dedup ---------------------------------------------------------------

def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    expected = con.sql(queries.ORACLE["op1_line_dedup"]).fetchall()
    got = queries.QUERIES["op1_line_dedup"](spark, SF_SMALL).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def brute_lines(rows, min_lines, min_words):
    """Kept text by doc_id; the ids are distinct and not null."""
    rows = sorted(rows)
    split = {d: (t.split("\n") if t is not None else []) for d, t in rows}
    size = {d: [len([w for w in x.replace("\t", " ").split(" ") if w]) for x in v]
            for d, v in split.items()}
    gone, seen = defaultdict(set), set()
    for d, _ in rows:
        v = split[d]
        for i in range(len(v)):
            for n in {1, min_lines}:
                run = tuple(v[i:i + n])
                if len(run) < n:
                    continue
                counts = n >= min_lines and sum(size[d][i:i + n]) > 0 or (
                    n == 1 and size[d][i] >= min_words)
                if counts and run in seen:
                    gone[d] |= set(range(i, i + n))
                seen.add(run)
    return {d: [x for i, x in enumerate(split[d]) if i not in gone[d]] for d, _ in rows}


@pytest.mark.parametrize("min_lines,min_words", [(3, 5), (2, 3), (4, 2), (1, 9)])
def test_line_dedup_equals_brute_force(spark, min_lines, min_words):
    rng = random.Random(min_lines)
    pool = ["", "a", "b", "one two", "x y z", "five words are in here", "a b c d e f g"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, "\n" * 6), (102, "a\nb\n" * 30)]
    expected = brute_lines(rows, min_lines, min_words)
    docs = cases.documents(spark, rows)
    got = {r.doc_id: r for r in line_dedup.report(docs, min_lines, min_words).collect()}
    for d, t in rows:
        n = 0 if t is None else len(t.split("\n"))
        assert (got[d].n_lines, got[d].n_removed) == (n, n - len(expected[d]))
        assert got[d].kept_sha256 == sha("\n".join(expected[d]).encode())
    kept = line_dedup.dedup(docs, min_lines, min_words)
    assert kept.columns == docs.columns
    left = {r.doc_id: r for r in kept.collect()}
    for d, t in rows:
        changed = t is not None and "\n".join(expected[d]) != t
        if changed and not expected[d]:
            assert d not in left
        else:
            assert left[d].text == (None if t is None else "\n".join(expected[d]))
            assert left[d].n_chars == len(left[d].text or "")


def test_line_dedup_awkward_rows(spark):
    rows = cases.texts(random.Random(5))
    got = line_dedup.report(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.doc_id == 4 and r.n_lines == 1]
    assert len(same) == 2 and len({r.kept_sha256 for r in same}) == 1
    assert [r.n_removed for r in got if r.doc_id == 5] == [1]
    assert line_dedup.report(cases.empty(spark)).count() == 0
    assert line_dedup.dedup(cases.empty(spark)).count() == 0


# --- suffix dedup -------------------------------------------------------------

def brute_suffixes(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                cover[s:s + length] = b"\x01" * length
            seen.add(w)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out[d] = (len(b), sum(cover), spans, sha(bytes(c for c, m in zip(b, cover) if not m)))
    return out


def suffix_rows():
    rng = random.Random(11)
    passage = cases.sentence(rng, 60)
    rows = [(i, cases.sentence(rng, rng.randint(0, 120))) for i in range(30)]
    rows += [(100 + i, cases.sentence(rng, rng.randint(0, 60)) + passage[i % 7:]
              + cases.sentence(rng, rng.randint(0, 60))) for i in range(40)]
    rows += [(200, "ab" * 400), (201, "b" + "ab" * 300), (202, "x" * 5000), (203, None), (204, ""),
             (205, "é" * 49 + "ab"), (206, "é" * 49 + "ab" + "é" * 60), (207, passage), (208, passage),
             (209, passage[:100]), (210, passage[1:100]), (-3, passage + "!" + passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,sort_block,bucket", [(1 << 20, 3 << 20, 16 << 20), (3000, 2500, 900)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, block, sort_block, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    rows = suffix_rows()
    expected = brute_suffixes(rows)
    if block < 1 << 20:  # small blocks inside the tasks, too
        for part in (17, 250, 1 << 30):
            for size in (100, sort_block, 20000):
                check_blocks(rows, size, part)
    got = suffix_dedup.digest(cases.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected


def check_blocks(rows, sort_block, part):
    """Sorting in small blocks and comparing across them finds the same."""
    stretches = []
    for d, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        at, lead, h = suffix_dedup.leading_tokens(data, np.array([0, len(data)]))
        cut = np.flatnonzero(np.diff(lead)) + 1
        for g in np.split(np.arange(len(at)), cut) if len(at) else []:
            a, b, p = int(at[g[0]]), int(at[g[-1]]) + 100, int(lead[g[0]])
            stretches.append((0, int(h[p].astype(np.int64)), d, 0, a, p - a, data[a:b].tobytes()))
    stretches.sort()
    cover, open_ = defaultdict(set), defaultdict(list)
    blocks = []
    for at in range(0, len(stretches), part):  # partitions may cut a token as well
        blocks += suffix_dedup.token_blocks(iter(stretches[at:at + part]), sort_block)
    assert [r for some, _ in blocks for r in some] == stretches
    longest = max(len(r[6]) for r in stretches)
    assert max(sum(len(r[6]) for r in some) for some, _ in blocks) <= 2 * sort_block + longest
    for some, edges in blocks:
        out = suffix_dedup.sort_block(some, edges)
        for kind, d, _, s, e, w1, w2 in zip(*out.values()):
            if kind == 0:
                cover[d] |= set(range(s, e))
            else:
                open_[w1, w2].append((d, s))
    for places in open_.values():
        for d, s in sorted(places)[1:]:
            cover[d] |= set(range(s, s + 100))
    expected = brute_suffixes(rows)
    assert {d: len(cover[d]) for d, _ in rows} == {d: v[1] for d, v in expected.items()}


def test_equal_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 600, dtype=np.uint8)
    data[300:450] = data[100:250]
    at = np.arange(0, 500)
    kind = at % 2
    cls = suffix_dedup.equal_suffixes(data, at, kind)
    first = {}
    for i, a in enumerate(at):
        key = (kind[i], data[a:a + 100].tobytes())
        assert cls[i] == first.setdefault(key, i)


def test_suffix_dedup_awkward_rows(spark):
    rows = cases.texts(random.Random(5))
    got = suffix_dedup.digest(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.doc_id == 4 and r.n_bytes == len(rows[5][1].encode())]
    assert len(same) == 2 and {r.n_removed for r in same} == {0}  # one document
    assert [r.n_removed == r.n_bytes for r in got if r.doc_id == 5] == [True]
    assert suffix_dedup.digest(cases.empty(spark)).count() == 0


# --- near duplicates ----------------------------------------------------------

def brute_classes(docs, idf):
    """Smallest doc_id by class, from all pairs of texts."""
    texts = defaultdict(list)
    for d, t in docs:
        texts[t or ""].append(d)
    keys = [t for t in texts if t.split()]
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if max(near_dup.similarities([(keys[i], keys[j])], idf)[0]) >= 0.8:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, t in enumerate(keys):
        groups[root(i)] += texts[t]
    out = {d: min(v) for v in groups.values() for d in v}
    return {**out, **{d: d for t, v in texts.items() if not t.split() for d in v}}


def near_rows(seed=13):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, d = [], 0
    for _ in range(12):  # families whose members drift apart
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9)):
            text = base[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((d, " ".join(text)))
            d += 1
            if rng.random() < 0.3:
                base = text
    rows += [(d, None), (d + 1, ""), (d + 2, "a b"), (d + 3, "a  B"), (d + 4, "a c"), (d + 5, " \n")]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows()
    docs = cases.documents(spark, rows)
    expected = brute_classes(rows, near_dup.word_idf(docs))
    got = near_dup.report(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == expected
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = near_dup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(expected.values())


def test_later_step_finds_links_the_stars_miss(spark, monkeypatch):
    """A bucket whose first member is far from two linked others."""
    rng = random.Random(1)
    a = [f"x{i}" for i in range(60)]
    b, c = a[:], None
    for i in (3, 20, 40):
        b[i] = f"y{i}"
    c = b[:]
    c[41] = "z"
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(c))]
    docs = cases.documents(spark, rows)
    idf = near_dup.word_idf(docs)
    node = [dict(__doc=i, __uid=0) for i in range(3)]
    members = spark.createDataFrame(
        [(0, 7, n, node[0]) for n in node],
        f"band int, key long, node {near_dup._NODE}, first {near_dup._NODE}")
    nodes = spark.createDataFrame([(n, [7, i]) for i, n in enumerate(node)],
                                  f"node {near_dup._NODE}, bands array<long>")
    texts = spark.createDataFrame([(n, t) for n, (_, t) in zip(node, rows)],
                                  f"node {near_dup._NODE}, text string")
    star = members.where("node != first").selectExpr("node as a", "first as b")
    links = near_dup.verified(star, texts, idf)
    assert links.where(near_dup.linked()).count() == 0
    rest = near_dup.remaining(members, nodes, texts, links,
                              near_dup.components(links.where("false")), idf)
    assert [(r.a["__doc"], r.b["__doc"]) for r in rest.collect()] == [(2, 1)]
    assert near_dup.verified(rest, texts, idf).where(near_dup.linked()).count() == 1
    assert rng is not None


def test_sampling_agrees_with_similarity():
    """Bands of one row estimate the weighted Jaccard similarity."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    idf = np.ones(near_dup.SLOTS) * 2
    one, other = words[:300], words[60:360]
    h, w, _, off = near_dup.shingles([one, other], idf)
    a, b = set(h[:off[1]].tolist()), set(h[off[1]:].tolist())
    truth = len(a & b) / len(a | b)
    same = []
    draws = near_dup._DRAW
    try:
        for seed in range(12):
            r = np.random.default_rng(seed)
            near_dup._DRAW = [np.uint64(int(v) | 1) for v in r.integers(1 << 60, 1 << 62, 16)]
            rows, near_dup.ROWS = near_dup.ROWS, 1
            keys = near_dup.bands(h, w, off)
            near_dup.ROWS = rows
            same.append((keys[0] == keys[1]).mean())
    finally:
        near_dup._DRAW = draws
    assert abs(np.mean(same) - truth) < 0.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 301)]
    edges = spark.createDataFrame([(dict(__doc=a, __uid=0), dict(__doc=b, __uid=0))
                                   for a, b in chain], f"a {near_dup._NODE}, b {near_dup._NODE}")
    got = {r.node["__doc"]: r["class"]["__doc"] for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100, 300: 300, 301: 300}


def test_near_duplicates_awkward_rows(spark):
    rows = cases.texts(random.Random(5))
    docs = cases.documents(spark, rows)
    got = near_dup.report(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[5] == {4} and by[6] == {4} and by[10] == {9} and by[11] == {11} and by[1] == {1}
    kept = near_dup.dedup(docs).collect()
    assert len([r for r in kept if r.text == rows[5][1]]) == 1
    assert near_dup.report(cases.empty(spark)).count() == 0
    assert near_dup.dedup(cases.empty(spark)).count() == 0


# --- quality ------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    docs, labels = (read_table(spark, SF_SMALL, t) for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    fold = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in fold]) >= 0.9


def test_site_posteriors_equal_plain_version(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        host = rng.choice(["a", "a", "a", "b", None])
        path = rng.choice(["x", "y", None])
        z = rng.gauss(2 if host == "a" else -1, 1)
        label = rng.choice([None, None, int(z > 0)])
        rows.append((i, host, path, None if i % 50 == 0 else z, label))
    df = spark.createDataFrame(rows, "__doc long, host string, path string, z double, label int")
    got = {r["__doc"]: r for r in quality.posteriors(df).collect()}
    good = {i: (label if label is not None else None if z is None else 1 / (1 + np.exp(-z)))
            for i, _, _, z, label in rows}
    host_n, path_n = defaultdict(list), defaultdict(list)
    for i, h, p, *_ in rows:
        if good[i] is not None:
            host_n[h].append(good[i])
            path_n[h, p].append(good[i])
    n = sum(map(len, host_n.values()))
    m = (sum(map(sum, host_n.values())) + 0.5) / (n + 1)

    def strength(groups):
        groups = [(len(v), sum(v), t) for v, t in groups if len(v) >= 2]
        total = sum(g[0] for g in groups)
        ss = sum(k * (s / k - t) ** 2 for k, s, t in groups)
        noise = sum(t * (1 - t) for _, _, t in groups)
        within = sum(k * t * (1 - t) for k, _, t in groups) / total
        between = (ss - noise) / total
        k = within / between - 1 if between > 0 else quality.K_RANGE[1]
        return min(max(k, quality.K_RANGE[0]), quality.K_RANGE[1])

    kh = strength([(v, m) for v in host_n.values()])
    shrunk = {h: (sum(v) + kh * m) / (len(v) + kh) for h, v in host_n.items()}
    kp = strength([(v, shrunk[h]) for (h, _), v in path_n.items()])
    for i, h, p, *_ in rows:
        own, one = (0.0, 0) if good[i] is None else (good[i], 1)
        host = (max(sum(host_n[h]) - own, 0) + kh * m) / (len(host_n[h]) - one + kh)
        path = (max(sum(path_n[h, p]) - own, 0) + kp * host) / (len(path_n[h, p]) - one + kp)
        assert abs(got[i]["prior"] - path) < 1e-6


def test_quality_awkward_rows(spark):
    rows = cases.texts(random.Random(5))
    docs = cases.documents(spark, rows)
    marks = [(d, i % 2, 0) for i, (d, _) in enumerate(rows)] + [(3, None, 0), (None, 1, 0)]
    for lab in (marks, [], [(3, 1, 0)]):
        got = quality.classify(docs, cases.labels(spark, lab)).collect()
        assert len(got) == len(rows)
        assert all(not r.kept and r.quality == 0 for r in got if r.doc_id in (1, 2, 11, 14))
    none = quality.classify(cases.empty(spark), cases.labels(spark, marks))
    assert none.count() == 0
