"""Decontamination, near duplicates and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from resolvent.llm import _arrow, components, decontam, line_dedup, near_copies, simhash

from .conftest import PHRASE

#: Similarity 0.75, fingerprints (5-word shingles) 3 bits apart.
PAIR = "w5625 b c d e f g", "w5625 b c d e f g h5625"

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute_contamination(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    found |= own
                    hit.update(range(k, k + m))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [23, 6])  # a filter that lets everything pass must change nothing
def test_decontamination(spark, edge_docs, bits):
    items = [(1, PHRASE), (2, "word1 word2"), (3, None), (4, ""), (5, PHRASE), (6, "漢字"), (None, "word3"), (7, PHRASE[20:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(edge_docs, bench, 10, filter_bits=bits).collect()), key=repr)
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert got == brute_contamination(docs, [x for x in items if x[0] is not None], 10)


def test_fingerprints_are_fewer_than_windows_and_lose_no_span(spark):
    """Winnowing keeps some positions, and every span of 10 words or more that a document shares is hit, wherever it lies."""
    rng = random.Random(12)
    item = [f"i{k}" for k in range(200)]
    docs = []
    for d in range(60):
        a, n = rng.randrange(190), rng.randint(9, 40)
        own = item[a : a + n]
        if d % 5 == 0:  # one changed word in the middle
            own[len(own) // 2] = "changed"
        docs.append((d, " ".join([f"o{rng.random()}" for _ in range(rng.randint(0, 30))] + own + [f"p{rng.random()}" for _ in range(rng.randint(0, 30))])))
    items = [(1, " ".join(item)), (2, " ".join(item[50:90])), (3, " ".join(item[:9])), (4, " ".join(["a"] * 30))]
    docs.append((100, " ".join(["a"] * 50)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()), key=repr)
    assert got == brute_contamination(docs, items, 10)
    prints = decontam.benchmark_fingerprints(bench.where("item_id = 1"), 10, 5).count()
    assert prints < 0.5 * 191


def test_near_copies_of_one_large_group(spark):
    """A third of all rows are near copies of one text, and a chain that only some pairs link; blocks are small."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    docs = [(k, " ".join([*base[: (p := rng.randrange(200))], f"x{k}", *base[p:]])) for k in range(150)] + [(1000 + k, " ".join(f"u{rng.random()}" for _ in range(50))) for k in range(200)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        docs.append((2000 + k, " ".join(chain)))
        chain = [*chain[4:], *(f"d{k}{j}" for j in range(4))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    base_rows = simhash.keyed_texts(frame)
    sets = near_copies._sets_of(base_rows.select(F.col("doc_id").alias("node"), "text"), 5)
    keyed = base_rows.select(F.col("doc_id").alias("node"), F.explode(F.array(F.lit(1).cast("long"), F.pmod("doc_id", F.lit(7)) + 2)).alias("key"))
    roots = {r.node: r.root for r in components.components(near_copies.node_links(keyed, sets, 0.8, block=16)).collect()}
    assert {roots.get(k) for k in range(150)} == {0} and not any(roots.get(1000 + k) for k in range(200))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    near = [(a, b) for a, x in docs[-12:] for b, y in docs[-12:] if a < b and len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))]
    assert near and all(roots[a] == roots[b] for a, b in near)
    kept = near_copies.representatives(frame).where("doc_id < 150").collect()
    assert [r.doc_id for r in kept] == [0]


def test_fingerprints_propose_near_copies(spark):
    """SimHash alone, without MinHash bands: pairs of a component of fingerprints within 3 bits link if their sets are similar."""
    rng = random.Random(3)
    docs = [(1, PAIR[0]), (2, PAIR[1]), (3, None), (4, " ")]
    for family in range(40):
        base = [f"f{family}-{k}" for k in range(rng.randint(150, 600))]
        for k in range(4):
            docs.append((100 + 10 * family + k, " ".join("changed" if j in (17 * k, 23 * k) and k else w for j, w in enumerate(base))))
    text = pa.array([t or "" for _, t in docs])
    h, first = near_copies.shingle_sets(*_arrow.utf8(text), 5)
    prints, sets = simhash.majority(h, first), [set(h[i:j].tolist()) for i, j in zip(first, first[1:])]
    near = np.bitwise_count(prints[:, None] ^ prints) <= 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for similarity in (0.8, 0.7):
        comp = list(range(len(docs)))

        def join(pairs):
            for i, j in pairs:
                comp[:] = [comp[j] if c == comp[i] else c for c in comp]

        join(np.argwhere(near))
        linked = [(i, j) for i in range(len(docs)) for j in range(i) if comp[i] == comp[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
        comp = list(range(len(docs)))
        join(linked)
        want = {}
        for c, (d, _) in zip(comp, docs):
            want.setdefault(c, []).append(d)
        got = {}
        for r in near_copies.classes(frame, similarity=similarity, bands=0).collect():
            got.setdefault(r.root, []).append(r.doc_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert ([1, 2] in [sorted(x) for x in got.values()]) == (similarity < 0.75) and 44 < len(got) < 162


def test_one_unlike_node_costs_no_square_of_its_bucket(spark):
    n = 20_000
    placed = spark.range(n + 3).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.greatest(F.col("id") - (n - 1), F.lit(0)).alias("root"))
    open_ = spark.createDataFrame([(7, 0, n, 3)], "key long, home long, n_home long, n_away long")
    rows = near_copies.paired_blocks(placed, open_, block=64).collect()
    assert len(rows) == n + 3 * (1 + -(-n // 64))
    groups = {}
    for r in rows:
        groups.setdefault((r.i, r.j), set()).add(r.node)
    for away in (n, n + 1, n + 2):  # each of the others meets every node
        assert set().union(*(g for g in groups.values() if away in g)) == set(range(n + 3))
    assert max(map(len, groups.values())) < 200


def test_decontamination_of_nothing(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontam.report(edge_docs, bench).collect()} == {False}
    assert decontam.report(no_docs, spark.createDataFrame([(1, PHRASE)], "item_id long, text string")).collect() == []
    clean = decontam.clean(edge_docs, spark.createDataFrame([(1, PHRASE)], "item_id long, text string"))
    assert clean.columns == edge_docs.columns and {5, 6, 7, 13}.isdisjoint({r.doc_id for r in clean.collect()}) and clean.count() == edge_docs.count() - 4


def test_xxh64_is_the_published_one():
    rng = random.Random(2)
    data = rng.randbytes(4000)
    s = np.array([rng.randrange(3000) for _ in range(800)])
    e = s + np.array([rng.randrange(150) for _ in range(800)])
    got = _arrow.xxh64(_arrow.padded(np.frombuffer(data, np.uint8)), s, e)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in zip(s, e)]


def brute_fingerprint(text, size=3):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        least.setdefault(find(k), []).append(d)
    want = sorted(((d, f"{fps[k]:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(docs)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.representatives(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len({find(k) for k in range(len(docs))})


@pytest.mark.parametrize("split", [4, 8192])
def test_covering_tables_lose_no_pair(spark, split):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        seed = rng.getrandbits(64)
        for _ in range(12):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, split)).collect()}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                assert roots[signed[i]] == roots[signed[j]]


@pytest.mark.parametrize("finish", [0, 1_000_000])
def test_components_of_chains_and_hubs(spark, finish):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (1, 0), (None, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), finish).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 1000 for k in range(1000, 1100)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(docs, least):
    split = lambda t: [x for x in re.split(r"\n|\r", t or "") if x.split()]
    first, out = {}, {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, gone = split(t), set()
        for s in range(len(lines)):
            n = 0
            for e in range(s, len(lines)):
                n += len(lines[e].split())
                if n >= least:
                    key = tuple(lines[s : e + 1])
                    if first.setdefault(key, (d, s)) != (d, s):
                        gone.update(range(s, e + 1))
        out[(d, t)] = [x for i, x in enumerate(lines) if i not in gone]
    return out, split


def test_line_dedup(spark, edge_docs, no_docs):
    rng = random.Random(9)
    pool = [" ".join(f"w{i}_{k}" for k in range(rng.randint(1, 14))) for i in range(40)]
    docs = []
    for d in range(80):
        out = []
        for _ in range(rng.randint(0, 10)):
            a = rng.randrange(36)
            out += pool[a : a + rng.randint(1, 5)] if rng.random() < 0.5 else [f"own {rng.random()}", "", "short"]
        docs.append((d, "\n".join(out) if d % 2 else "\r\n".join(out)))
    docs += [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").where("doc_id is null or doc_id not in (11)").collect() if r.doc_id is None or r.doc_id > 13 or r.doc_id == 13]
    docs += [(500, None), (501, ""), (7, docs[7][1])]
    want, split = brute_lines(docs, 25)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 25).collect()
    have = sorted(((r.doc_id, tuple(split(r.text)), r.n_deleted) for r in got), key=repr)
    assert have == sorted(((d, tuple(want[(d, t)]), len(split(t)) - len(want[(d, t)])) for d, t in docs), key=repr)
    assert any(x[2] for x in have)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    named = line_dedup._hashed(frame)
    spans = lambda n: sorted((r.key, sorted(r.spans)) for r in line_dedup.repeated_lines(named, 25, filtered=n).collect())
    assert spans(1 << 23) == spans(0)  # by filter and by join
    assert sorted((r.doc_id is None, r.doc_id, r.n_deleted, r.text_sha256) for r in line_dedup.report(frame, 25).collect()) == sorted((r.doc_id is None, r.doc_id, r.n_deleted, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got)
    assert line_dedup.report(no_docs).collect() == []
    clash = edge_docs.withColumns({c: F.lit(1) for c in ("_lines", "spans", "key", "n_lines", "words_deleted", "h")})
    same = line_dedup.clean(clash, length="n_chars")
    assert same.columns == clash.columns and same.count() == clash.count()
    assert {r.doc_id for r in same.where("n_chars <> length(text)").collect()} <= {10, 1, 2, 3, 4, 7}
    kept = line_dedup.dedup_lines(edge_docs)
    assert kept.columns == [*edge_docs.columns, "n_lines", "n_deleted", "words_deleted"] and kept.count() == edge_docs.count()


def test_line_dedup_finds_passages_inside_lines(spark):
    """A passage without line ends of its own goes wherever it begins and ends, and so does what a changed word leaves."""
    rng = random.Random(4)
    text = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    sentence = " ".join(text(30)) + "."
    long, changed = text(120), text(120)
    docs = [(1, " ".join(text(9)) + ". " + sentence + " Then more."), (2, "Other words. " + sentence + "\nLast."), (3, " ".join(text(7) + long + text(5))), (4, " ".join(text(11) + long + text(3))), (5, " ".join(changed)), (6, " ".join([*changed[:60], "x", *changed[61:]])),
            (7, "Mine. " + sentence + " " + sentence)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 25).collect()}
    assert all(got[i].text == dict(docs)[i] for i in (1, 3, 5))
    assert got[2].text == "Other words. \nLast." and got[2].words_deleted == 30 and got[7].text.strip() == "Mine."
    assert got[4].words_deleted > 80 and got[6].words_deleted > 80 and "x" in got[6].text.split()
    assert line_dedup._without(b"a.\nb. c.\r\nd.", [0, 3, 6, 10], [2, 5, 8, 12], [0, 2, 3]) == b"b. \r\n"


def test_near_copies_equal_brute_force(spark, edge_docs, no_docs):
    """The pipeline's stage links every pair with a Jaccard similarity of 0.8 over 5-word shingles, and no other."""
    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").where("doc_id not in (11, 12)").collect()]
    for family in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for k in range(4):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"z{rng.random()}"
            docs.append((100 + 10 * family + k, " ".join(text)))

    def shingles(text):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets, comp = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    want = {}
    for k, (d, _) in enumerate(docs):
        want.setdefault(find(k), []).append(d)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, frame, "").collect())
    assert kept == sorted(min(x) for x in want.values())
    assert simhash.representatives(frame).count() > len(kept)
    assert near_copies.representatives(no_docs).collect() == []
