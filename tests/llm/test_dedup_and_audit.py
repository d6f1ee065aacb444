"""Ball trees, substring dedup and the filter audit against brute force, and their defined results at the edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolvent.llm import _copies, ball_tree, filter_audit, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- substring dedup -----------------------------------------------------------------------------


def brute_dedup(rows, window):
    """(doc_id, words, removed, digest) per row, straight from the definition."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1 if d is not None else 0):
            if least[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def dedup_rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["été", "Ab", "ab"]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for d in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            i, n = rng.randint(0, 50), rng.randint(3, 40)
            at = rng.randint(0, len(own))
            own[at:at] = passage[i : i + n]
        rows.append((d, rng.choice([" ", "  ", "\t", "\n"]).join(own)))
    rows += [(100 + k, rows[3][1]) for k in range(30)] + [(3, rows[3][1]), (3, rows[7][1]), (None, rows[5][1]), (None, None), (50, None), (51, ""), (52, " \n "), (53, "a b c"), (54, "a b c")]
    rows.append((60, " ".join(f"x{k % 5000}" for k in range(12_000))))
    rows.append((61, " ".join(f"x{k % 5000}" for k in range(3000, 9000))))
    return rows


@pytest.mark.parametrize("window, filtered", [(13, 1 << 23), (13, 0), (5, 1 << 23), (1, 1 << 23), (30, 1 << 23), (30, 0)])
def test_substring_dedup_equals_brute_force(spark, window, filtered):
    rows = dedup_rows(window)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame, window, filtered).collect()), key=repr)
    assert got == [x[:4] for x in brute_dedup(rows, window)]


def test_substring_dedup_keeps_columns_and_untouched_texts(spark):
    rows = dedup_rows(13)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h1": F.lit("own"), "later": F.lit(1), "starts": F.lit(2), "key": F.lit(3)})
    out = substring_dedup.clean(frame, 13)
    assert out.columns == frame.columns and out.count() == len(rows)
    got, touched = {(r.doc_id, r.text) for r in out.collect()}, set()
    for d, _, gone, _, kept in brute_dedup(rows, 13):
        if gone:
            touched.add(d)
            assert (d, kept) in got
    assert all((d, t) in got for d, t in rows if d not in touched)
    assert substring_dedup.report(frame.limit(0)).collect() == [] and substring_dedup.clean(frame.limit(0)).collect() == []


def test_levels_halve_down_to_the_shortest():
    assert substring_dedup.sizes_of(13) == [7, 13] and substring_dedup.sizes_of(50) == [7, 13, 25, 50] and substring_dedup.sizes_of(4) == [4]


def test_first_rows_pass_the_two_filters(spark):
    marked = spark.range(20_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 3 == 0).alias("later"))
    held = _copies.first_filter(marked)
    rows = marked.toPandas()
    ok = _copies.maybe_first(held, rows["key"].to_numpy())
    assert ok[~rows["later"].to_numpy()].all() and ok[rows["later"].to_numpy()].mean() < 0.1


# -- ball trees ----------------------------------------------------------------------------------


def brute_clusters(rows, dims, k, rounds):
    """Lloyd's rounds in Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept))
    c = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        c = [[sum(col) // len(m) for col in zip(*m)] if (m := [q for (_, q), o in zip(kept, own) if o == n]) else x for n, x in enumerate(c)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    most = (1 << 63) - 1
    inertia = {n: sum(d for _, o, d in out if o == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, o, min(d, most), min(inertia[o], most), min(sum(inertia.values()), most), sha[o]) for i, o, d in out), key=repr)


def run_clusters(spark, rows, dims, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("own"), "ids": F.lit(1)}).repartition(3)
    got = ball_tree.clusters(frame, dims=dims, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(seed, dims, n, wide=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=dims) * (0.01 if i % 3 else 1.0)]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(n // 2)]  # one very common vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (2000, None), (2001, rows[1][1][:-1]), (2002, [None, *rows[1][1][1:]]), (2003, [math.nan, *rows[1][1][1:]]), (2004, [math.inf, *rows[1][1][1:]]), (2005, []), (2006, [0.0] * dims), (2007, [-0.001] * dims)]
    if wide:
        rows += [(3000, [float(np.float32(3e38))] * dims), (3001, [float(np.float32(-3e38)), *[1.0] * (dims - 1)]), (3002, [1e6] * dims), (3003, [70000.0] * dims)]
    return rows


@pytest.mark.parametrize("dims, wide", [(4, False), (4, True), (64, False)])
def test_clusters_equal_brute_force(spark, dims, wide):
    rows = vectors(dims, dims, 300, wide)
    assert run_clusters(spark, rows, dims, k=16, rounds=3) == brute_clusters(rows, dims, 16, 3)


def test_clusters_of_little(spark):
    rows = vectors(1, 3, 12)
    assert run_clusters(spark, rows[:3], 3, k=16, rounds=2) == brute_clusters(rows[:3], 3, 16, 2)
    assert run_clusters(spark, [(1, None), (2, [1.0])], 3) == [] and run_clusters(spark, [], 3) == []
    same = [(k, [1.0, 2.0, 3.0]) for k in range(50)]  # ties: all to the first centroid, the others stay empty
    assert {r[1] for r in run_clusters(spark, same, 3, k=4)} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_trees_assign_as_all_pairs_do(seed):
    rng = np.random.default_rng(seed)
    q = np.round(rng.normal(size=(700, 5)) * 40 + rng.integers(0, 4, size=(700, 1)) * 300).astype(np.int32)
    q[:200] = q[0]
    order, *parts = ball_tree.build(q)
    tree = ball_tree.Tree(q[order], *parts)
    assert sorted(order.tolist()) == list(range(700)) and (tree.sums[0] == q.sum(axis=0)).all()
    c = np.round(rng.normal(size=(9, 5)) * 300).astype(np.int64)
    c[4] = c[2]  # a tie
    want = ((q[order][:, None, :].astype(np.int64) - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.assign(c) == want).all()
    n, s = tree.totals(c)
    assert n.tolist() == np.bincount(want, minlength=9).tolist()
    assert all((s[k] == q[order][want == k].sum(axis=0)).all() for k in range(9))
    whole, _, _ = tree.filtered(c)
    assert tree.count[whole].sum() > 100  # balls are really assigned whole


# -- filter audit --------------------------------------------------------------------------------


def test_polynomials_give_corners_and_shapley_values():
    rng = random.Random(2)
    for n in (1, 3, 5):
        counts = {m: rng.randint(0, 9) for m in range(1 << n)}
        p = filter_audit.Removals(counts, n)
        removed = lambda s: sum(c for m, c in counts.items() if m & s)
        assert all(p.at_corner(s) == removed(s) for s in range(1 << n))
        for i in range(n):
            others = [k for k in range(n) if k != i]
            want = sum((Fraction(math.factorial(r) * math.factorial(n - r - 1), math.factorial(n)) * (removed(sum(1 << k for k in s) | 1 << i) - removed(sum(1 << k for k in s))) for r in range(n) for s in combinations(others, r)), Fraction(0))
            assert p.shapley(i) == want


def brute_audit(docs, labels):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {c for c, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= x <= "Z" for x in t) > 3 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))), ("E", d is not None and d > least[t])) if bad}
        rows.append((lang or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, total = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                fail = sum(f in r[1] for r in own)
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), fail - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(8)
    docs = [(None, None, None), (0, None, "en"), (1, "", None), (2, "", ""), (3, " \n", "en"), (4, "ÄÖ ÉÉ" * 40, "de"), (5, "Ab|c", "de"), (5, "Ab|c", "de"), (6, "Ab|c", "fr"), (None, "Ab|c", "fr")]
    for k in range(60):
        words = [rng.choice(["alpha", "beta", "Gamma", "x$", "delta", f"u{rng.random()}"]) for _ in range(rng.choice([3, 199, 200, 201, 400]))]
        docs.append((rng.randint(7, 60), " ".join(words), rng.choice(["en", "de", None])))
    docs += [(100 + k, docs[20][1], rng.choice(["en", "de"])) for k in range(20)] + [(999, "A" * 500_000, "long")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 120)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"mask": F.lit("own"), "part": F.lit(1), "n": F.lit(2), "good": F.lit(3)}).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = filter_audit.interaction_audit(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert filter_audit.interaction_audit(frame.limit(0), marks).collect() == []
    assert len(filter_audit.interaction_audit(frame.limit(3), marks.limit(0)).collect()) % 600 == 0
