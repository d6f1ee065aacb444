"""Classifiers: held-out accuracy, folds, restored words, and defined results at the edges."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from resolvent.llm import _labels, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_fold_is_crc32_of_the_id(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", _labels.fold(F.col("doc_id"), 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 3 for r in got)


def test_isotonic_is_monotone_and_pools():
    x, y = _labels.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(y) >= 0).all() and y.tolist() == [0, 0, 0.5, 0.5, 1, 1]


def test_quality_on_held_out_rows(spark):
    got = queries.op2_quality(spark, SF).join(table(spark, "labels"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() / got.count() >= 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark):
    got = queries.op3_toxicity(spark, SF).join(table(spark, "labels"), "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() >= 0.9


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_without_labels_or_documents(spark, edge_docs, no_docs, which):
    run = quality.quality_scores if which == "quality" else toxicity.toxicity_scores
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, 0), (7, 1), (8, 0), (9, 1), (10, 0), (None, 1), (3, None)], f"doc_id long, {which} int")
    assert run(edge_docs, labels.limit(0)).count() == edge_docs.count()
    assert run(no_docs, labels).collect() == []
    rows = run(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_disguised_words_are_restored(spark):
    cost = toxicity.costs(toxicity.trigram_counts(table(spark, "documents")))
    for given, wanted in (("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("$tupid", "stupid"), ("tr@sh", "trash"), ("idiiiiot", "idiot"), ("pathet1c", "pathetic")):
        assert toxicity.restore(given, cost) == wanted


def all_paths(token, cost):
    """The cost and the text of every path of a token's lattice."""
    alone = not any(a.isalpha() and b.isalpha() for a, b in zip(token, token[1:]))
    paths, before, drawn = [(0.0, (0, 0), "")], "", 1
    for ch in token:
        drawn = drawn + 1 if ch == before else 1
        new = []
        for total, (a, b), text in paths:
            for symbol, c, channel in toxicity._options(ch, drawn, toxicity.ALONE if alone else toxicity.INSIDE):
                if symbol < 0:
                    new.append((total + channel, (a, b), text))
                elif symbol or b:
                    new.append((total + channel + cost[a, b, symbol], (b, symbol) if symbol else (0, 0), text + c))
        paths, before = new, ch
    return min((total + cost[a, b, 0], text.strip()) for total, (a, b), text in paths)


def test_viterbi_equals_enumeration(spark):
    cost = toxicity.costs(toxicity.trigram_counts(table(spark, "documents")))
    rng = random.Random(6)
    tokens = ["a$$", "@$$", "h*ll", "b**t", "i-d.i0t", "а$$", "m00n!e", "aa.bb", "ééa", "i d i", "a**", "id**", "idi**", "bb**", "b.**"] + ["".join(rng.choice("aabeeilost013$@!.-é") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    for token in tokens:
        assert toxicity.restore(token, cost) == all_paths(token, cost)[1], token


@pytest.mark.parametrize("token, wanted", [("i" + "d" * 60 + "iot", "idiot"), ("idiiot", "idiot"), ("a s s", "ass"), ("\u0456diot", "idiot"), ("idi0t.trash" * 6, "idiot trash" * 6), ("i" * 5000, "i"), ("a" + "*" * 40 + "b", None)])
def test_no_length_hides_a_word(spark, token, wanted):
    cost = toxicity.costs(toxicity.trigram_counts(table(spark, "documents")))
    raw = np.frombuffer(f"Plain {token} text".encode(), np.uint8)
    pad, s, e, _ = toxicity.Restorer(cost).words(raw, np.array([0, len(raw)]))
    words = [bytes(pad[a:b]).decode() for a, b in zip(s, e)]
    assert words[:2] == ["plain", "text"] and (wanted is None or " ".join(words[2:]) == wanted)


def test_words_of_plain_text_stay(spark):
    cost = toxicity.costs(np.ones((28, 28, 28), np.int64))
    text = "Plain Wörds, and it's l'été: *** x\nNew"
    raw = np.frombuffer(text.encode(), np.uint8)
    pad, s, e, doc = toxicity.Restorer(cost).words(raw, np.array([0, 6, len(raw)]))
    assert sorted(bytes(pad[a:b]).decode() for a, b in zip(s, e)) == sorted(["plain", "wörds", "and", "it", "s", "l", "été", "x", "new"])
    assert doc.tolist() == [0, 1, 1, 1, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("token, core, more", [("**iot", "iot", "**iot"), ("!!diot", "diot", "!!diot"), ("++upid", "upid", "++upid"), ("idio*", "idio", "idio*"), ("a**", "a", "a**"), ("idio|", "idio", "idio|"), ("(dull!)", "dull", "(dull!")])
def test_signs_around_a_core_reach_the_lattice(spark, token, core, more):
    cost = toxicity.costs(toxicity.trigram_counts(table(spark, "documents")))
    raw = np.frombuffer(f"Plain {token} text".encode(), np.uint8)
    pad, s, e, _ = toxicity.Restorer(cost).words(raw, np.array([0, len(raw)]))
    words = sorted(bytes(pad[a:b]).decode() for a, b in zip(s, e))
    assert words == sorted(["plain", "text", toxicity.restore(core, cost) if core == "dull" else core, *(all_paths(more, cost)[1].split() if more.count("*") < 2 else toxicity.restore(more, cost).split())])


def test_a_word_spelled_in_two_letters_and_a_rest_is_joined(spark):
    cost = toxicity.costs(toxicity.trigram_counts(table(spark, "documents")))
    for text, wanted in (("go f u ck now", {"fu", "fuck", "gofu", "gofuck"}), ("plain f u", {"fu"}), ("a\nplain b c longer", {"bc"})):
        raw = np.frombuffer(text.encode(), np.uint8)
        pad, s, e, _ = toxicity.Restorer(cost).words(raw, np.array([0, len(raw)]))
        assert {bytes(pad[a:b]).decode() for a, b in zip(s, e)} == wanted | set(text.split())


def test_accepted_keeps_columns_and_clean_rows(spark):
    docs = table(spark, "documents").withColumn("__toxicity_score", F.lit("own"))
    kept = toxicity.accepted(docs, table(spark, "labels"))
    assert kept.columns == docs.columns
    clean = kept.join(table(spark, "labels").where("toxic = 0"), "doc_id", "left_semi").count()
    assert clean >= 0.95 * table(spark, "labels").where("toxic = 0").count()


def test_url_rules_equal_brute_force(spark):
    urls = [(1, None), (2, "abc"), (3, "http://NET"), (4, "x://A.net/"), (5, "x://fnet/"), (6, "s://a.Example.NET/en/x?y"), (7, "s://a.org/fr/"), (7, "s://a.org/fr/"), (8, ""), (9, "h://b.example.com/de/#q"), (10, "h://x.org/a://b.net/"), (11, "h://"), (12, "h://a.net?x/")]
    pages = spark.createDataFrame([(i, u, "c") for i, u in urls], "page_id long, url string, verdict string")

    def brute(u):
        at = (u or "").find("://")
        rest = u[at + 3 :] if at >= 0 else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best and best.verdict

    got = url_filter.url_verdicts(pages, queries.RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute(dict(urls)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0), queries.RULES).collect() == []


def test_url_model_tells_its_classes_apart(spark):
    rows = [(i, f"http://good{i % 7}.example.net/en/{i}") for i in range(300)] + [(1000 + i, f"http://bad-pills{i % 7}.net/x{i}") for i in range(300)] + [(5000, "http://bad-pills3.biz/x7"), (5001, "http://good3.example.biz/en/4")]
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).where("page_id >= 5000").collect()}
    assert got == {5000: "block", 5001: "allow"}


def plain_ratio(url, counts, order, backoff):
    """The ratio of one URL by dictionaries of context counts: (order, context) -> {byte: [rejected, accepted]}."""
    data = url.encode()
    total = 0.0
    for c, sign in ((1, 1.0), (0, -1.0)):
        for i in range(len(data)):
            p = 1 / 256
            for k in range(order + 1):
                seen = counts.get((k, (b"\0" * order + data)[i + order - k : i + order]), {})
                p = (seen.get(data[i], [0, 0])[c] + backoff * p) / (sum(v[c] for v in seen.values()) + backoff)
            total += sign * np.log(p)
    return total / max(1, len(data))


def test_ratio_equals_plain_counting(spark):
    rng = random.Random(2)
    urls = ["http://" + "".join(rng.choice("abcé.-/") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    labelled = [(u, k % 3 == 0) for k, u in enumerate(urls)]
    counts: dict = {}
    for u, good in labelled:
        data = u.encode()
        for i in range(len(data)):
            for k in range(4):
                own = counts.setdefault((k, (b"\0" * 3 + data)[i + 3 - k : i + 3]), {})
                own.setdefault(data[i], [0, 0])[int(good)] += 1
    counted = url_filter.count_models(spark.createDataFrame(labelled, "url string, accepted boolean"), 3)
    asked = [*urls[:20], "", "x", "http://zzz/" + "ab" * 3000]
    raw = [u.encode() for u in asked]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = url_filter.log_ratio(np.frombuffer(b"".join(raw), np.uint8), off, url_filter.gathered(counted), 3, 2.0)
    want = [plain_ratio(u, counts, 3, 2.0) for u in asked]
    assert np.allclose(got, want)
    joined = {r.row: r.z for r in url_filter.joined_ratios(spark.createDataFrame(list(enumerate(asked)), "row long, url string"), counted, 3, 2.0).collect()}
    assert np.allclose([joined.get(k, 0.0) for k in range(len(asked))], want)


def test_url_verdicts_are_the_same_by_broadcast_and_join(spark):
    pages = table(spark, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(None, "http://a.org/fr/x"), (7, None), (8, "x://" + "q" * 50_000)], "page_id long, url string"))
    a, b = (sorted(map(tuple, url_filter.url_verdicts(pages, queries.RULES, most_keys=n).collect()), key=repr) for n in (1 << 23, 0))
    assert a == b


def test_quality_equals_a_direct_solve(spark):
    """The distributed normal equations and their solution, against numpy on all rows at once."""
    rng = np.random.default_rng(8)
    k = len(quality.NAMES)
    f, y, w = rng.normal(size=(300, k)), (rng.random(300) < 0.4).astype(float), rng.random(300) + 0.5
    phi = quality.Fourier(f.mean(0), f.std(0))
    rows = spark.createDataFrame([(x.tolist(), float(a), float(b)) for x, a, b in zip(f, y, w)], "f array<double>, y double, w double").repartition(5)
    a, b = quality.normal_equations(rows, phi)
    z = phi(f)
    assert np.allclose(a, (z * w[:, None]).T @ z) and np.allclose(b, (z * w[:, None]).T @ y)
    beta = quality.ridge_solution(a, b)
    lam = quality.RIDGE * max(1.0, w.sum())
    direct = np.linalg.lstsq(np.vstack([z * np.sqrt(w)[:, None], np.sqrt(lam) * np.eye(z.shape[1])]), np.concatenate([y * np.sqrt(w), np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ beta, z @ direct, atol=1e-6)


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(quality.NAMES)))
    phi = quality.Fourier(np.zeros(x.shape[1]), np.ones(x.shape[1]), features=20_000, width=4.0)
    z = phi(x)[:, :20_000]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 4.0**2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_isotonic_equals_brute_force():
    """The pooled fit has the least weighted squares of all non-decreasing step functions on a small grid."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(20):
        y, w = rng.integers(0, 4, 5) / 3, rng.integers(1, 4, 5).astype(float)
        x, fit = _labels.isotonic(np.arange(5.0), y, w)
        got = np.interp(np.arange(5), x, fit)
        best = min(((w * (np.array(v) - y) ** 2).sum() for v in itertools.combinations_with_replacement(np.linspace(0, 1, 31), 5)))
        assert (np.diff(got) >= -1e-12).all() and (w * (got - y) ** 2).sum() <= best + 1e-9


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_ties_repeats_and_very_long_texts(spark, which):
    run = quality.quality_scores if which == "quality" else toxicity.toxicity_scores
    long = "Plain words of a long text. " * 20_000
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in [(k, ("good plain text " if k % 2 else "stupid trash idiot ") * 5) for k in range(40)] + [(100, long), (100, long), (101, None), (None, ""), (102, "x" * 200_000)]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2 if which == "quality" else 1 - k % 2) for k in range(40)] * 2 + [(0, None), (None, 1)], f"doc_id long, {which} int")
    rows = run(docs, labels).collect()
    assert len(rows) == 45 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[100]) == 1 and len({s for k in range(0, 40, 2) for s in by[k]}) == 1
    assert max(by[1]) != max(by[0])


def test_url_counts_are_exact(spark):
    """Every n-gram has its own count, however many there are: 2 million keys, more than the former tables had slots."""
    rng = np.random.default_rng(3)
    urls = ["".join(map(chr, rng.integers(33, 127, 80))) for _ in range(4000)]
    key, counts = url_filter.gathered(url_filter.count_models(spark.createDataFrame([(u, k % 2 == 0) for k, u in enumerate(urls)], "url string, accepted boolean"), 5))
    want = set()
    for u in urls:
        for k in range(6):
            padded = "\0" * 5 + u
            for i in range(5, len(padded)):
                want |= {(k, padded[i - k : i]), (k, padded[i - k : i + 1], 1)}
    assert len(key) == len(want) > 1 << 20 and counts.sum() == 4000 * 80 * 12
