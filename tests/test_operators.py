import json
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resolvent.operators import audit, backbone, graph, index, limiter, resolve
from resolvent.sources import adapters, readers, sinks

SCHEMA = "rec_ord int, canonical_id string, accepted_name string, original_parsed_names array<string>, scientific_synonyms array<string>, trade_synonyms array<string>, common_names array<string>"


@pytest.fixture(scope="module")
def identities(spark):
    return spark.createDataFrame(
        [
            (1, "solaria-vulga", "Solaria vulga", ["solaria v"], ["Solaria alba"], [], ["Sunleaf", "Sun Root", "Glow Seed"]),
            (2, "solaria-alta", "Solaria alta", [], [], ["Solaria vulga"], ["Sunleaf", "Tall Root", "Glow Bark"]),
            (3, "lunaria-mar-alta", "Lunaria mar-alta", [], [], [], ["Moon Seed"]),
            (4, "amb", None, [], [], [], []),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def indices(spark, identities):
    return index.exact_index(identities), index.serving_common(identities, spark.createDataFrame([("glow", "solaria-alta")], "key string, pin string"))


def test_exact_index_prefers_the_lowest_rank(indices):
    r = {x.key: (x["rank"], x.canonical_id) for x in indices[0].collect()}
    assert r["solaria vulga"] == (0, "solaria-vulga") and r["solaria alba"] == (2, "solaria-vulga")


def test_derived_keys_are_guarded(spark, identities):
    r = {x.key: x.origin for x in index.guarded_common_index(identities, spark.createDataFrame([("glow", "solaria-alta")], "key string, pin string")).collect()}
    assert r["moon"] == "derived" and r["glow"] == "pinned" and r["sunleaf"] == "raw" and r["tall"] == "derived"
    held = {x.key: x.origin for x in index.guarded_common_index(identities, spark.createDataFrame([], "key string, pin string")).collect()}
    assert held["glow"] == "quarantined"


def test_the_four_resolvers_differ(spark, indices):
    labels = spark.createDataFrame([(None, "Sunleaf Moon"), (None, "Lunaria mar-alta"), ("Solaria alta", "x"), (None, None), (None, "nothing here")], "latin string, label string")
    got = {(x.latin, x.label): (x.canonical_id, x.match_method) for x in resolve.resolve_serving(labels, *indices).collect()}
    assert got[(None, "Sunleaf Moon")] == (None, "ambiguous")
    assert got[(None, "Lunaria mar-alta")] == ("lunaria-mar-alta", "accepted_name_exact")
    assert got[("Solaria alta", "x")] == ("solaria-alta", "accepted_name_exact")
    assert got[(None, None)] == (None, "unresolved") and got[(None, "nothing here")] == (None, "unresolved")
    titles = spark.createDataFrame([("Moon (Sunleaf)",), ("Moon Seed",), ("Glow (Moon)",)], "title string")
    cat = {x.title: (x.canonical_id, x.match_method) for x in resolve.resolve_catalogue(titles, *indices).collect()}
    assert cat["Moon (Sunleaf)"] == ("lunaria-mar-alta", "common_name_exact_unique") and cat["Glow (Moon)"] == (None, "ambiguous_exact")
    far = {x.title: x.canonical_id for x in resolve.resolve_longest(titles, *indices).collect()}
    assert far["Moon Seed"] == "lunaria-mar-alta"
    ing = {x.label: x.match_method for x in resolve.resolve_ingest(labels, *indices).collect()}
    assert ing["Sunleaf Moon"] == "ambiguous"


def test_empty_inputs(spark, indices):
    assert resolve.resolve_serving(spark.createDataFrame([], "latin string, label string"), *indices).collect() == []
    assert graph.near_duplicates(spark.createDataFrame([], "genus string, species string")).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    words = ["abc", "abd", "ab", "abcd", "xbc", "abc", "", "a", "zzzz", "bac"]
    got = {(x.a, x.b) for x in graph.near_duplicates(spark.createDataFrame([("g", w) for w in words], "genus string, species string")).collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    assert got == {(a, b) for a in set(words) for b in set(words) if a < b and near(a, b)}


def test_gate_keeps_metrics_of_failing_suppliers(spark):
    rows = spark.createDataFrame([("a", "mapped", "x")] * 9 + [("a", "mapped", None)] + [("b", "mapped", None)] * 2 + [("b", "mapped", "x")] + [("c", "out_of_scope", None)], "supplier_id string, scope string, canonical_id string")
    m = {x.supplier_id: (x.passes, x.identity_rate, x.taxonomy_rate) for x in graph.supplier_metrics(rows).collect()}
    assert m == {"a": (True, 0.9, 1.0), "b": (False, 0.333, 1.0), "c": (False, 0.0, 1.0)}


def test_families_count_once(spark):
    o = spark.createDataFrame([("e1", "f"), ("e1", "f"), ("e2", "f"), ("e3", "e3")], "entity_id string, fam string").withColumns({"canonical_id": F.lit("i"), "part": F.lit("p"), "base": F.lit("MP"), "overlays": F.lit("")})
    r = graph.form_graph(o, "fam").first()
    assert (r.n_observations, r.n_entities, r.n_families) == (4, 3, 2)


def test_merges_follow_chains(spark, identities):
    edges = spark.createDataFrame([("solaria-alta", "solaria-vulga"), ("solaria-vulga", "lunaria-mar-alta"), ("gone", "amb")], "absorb_id string, keep_id string")
    r = {x.canonical_id: x for x in backbone.merge_records(identities, edges).collect()}
    assert set(r) == {"lunaria-mar-alta", "amb"} and r["lunaria-mar-alta"].n_absorbed == 2
    assert "Solaria alta" in r["lunaria-mar-alta"].scientific_synonyms
    dropped = backbone.merge_records(identities, spark.createDataFrame([("solaria-alta", "lunaria-mar-alta", True)], "absorb_id string, keep_id string, drop_name boolean"))
    assert dropped.where("canonical_id = 'lunaria-mar-alta'").first().scientific_synonyms == []


@pytest.mark.parametrize("edges", [[("solaria-alta", "solaria-vulga"), ("solaria-vulga", "solaria-alta")], [("amb", "amb")], [("amb", "solaria-alta"), ("amb", "solaria-vulga")], [("solaria-alta", "solaria-vulga"), ("solaria-vulga", "lunaria-mar-alta"), ("lunaria-mar-alta", "solaria-alta")]])
def test_merges_refuse_cycles(spark, identities, edges):
    with pytest.raises(ValueError):
        backbone.merge_records(identities, spark.createDataFrame(edges, "absorb_id string, keep_id string")).collect()


def test_patches_fold_in_order_and_report(spark, identities):
    log = [
        (1, "adopt", "name", "solaria ALTA", "Solaria nova", None, None, "d1"), (2, "note", "name", "Solaria nova", None, None, "seen", None), (3, "remove_common", "id", "solaria-alta", None, ["Sunleaf", "zz"], None, None),
        (4, "add_common", "name", "Nova absens", None, ["New"], "why", "d2"), (5, "note", "name", "nova absens", None, None, "later", None), (6, "note", "name", "nobody", None, None, "n", None),
        (7, "keep_synonym", "name", "Solaria nova", "Solaria vera", None, None, None), (8, "remove_common", "id", "solaria-alta", None, ["zz"], None, None), (9, "ambiguous", "id", "solaria-vulga", None, ["A b"], None, None), (10, "adopt", "name", "Nova absens", "Stella × nova var. alba", None, None, None),
    ]
    flagged = identities.withColumn("ambiguity_flag", F.col("canonical_id") == "amb")
    done, report = backbone.patch(flagged, spark.createDataFrame(log, backbone.PATCH_SCHEMA))
    by = {r.canonical_id: r for r in done.collect()}
    r = by["solaria-alta"]
    assert (r.accepted_name, r.species, r.note, r.review_date, r.authority_synonym) == ("Solaria nova", "nova", "seen", "d1", "Solaria vera") and {"Solaria alta", "Solaria vera"} <= set(r.scientific_synonyms) and "Sunleaf" not in r.common_names
    assert by["amb"].ambiguity_flag and by["solaria-vulga"].ambiguity_flag and by["solaria-vulga"].accepted_name is None and not r.ambiguity_flag  # a flag without a patch stays
    n = by["nova-absens"]
    assert (n.accepted_name, n.genus, n.species, n.infra, n.note, n.common_names, n.scientific_synonyms) == ("Stella × nova var. alba", "Stella", "nova", "alba", "later", ["New"], ["Nova absens"])
    assert len(by) == identities.count() + 1
    assert [(x.place, x.outcome) for x in report.orderBy("place").collect()] == [(1, "applied"), (2, "applied"), (3, "applied"), (4, "created"), (5, "applied"), (6, "not_found"), (7, "applied"), (8, "skipped"), (9, "applied"), (10, "applied")]


def test_ids_pass_over_what_is_taken(spark):
    ids = lambda names, used: {r.name: r.canonical_id for r in backbone.allot_ids(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in used], "canonical_id string")).collect()}
    assert ids(["a", "A", "a-2"], []) == {"A": "a", "a": "a-3", "a-2": "a-2"}
    assert ids(["a", "A", "A!", "a?", "b", "B", "z"], ["a-3", "b", "b-2", "b-4", "b-x"]) == {"A": "a", "A!": "a-2", "a": "a-4", "a?": "a-5", "B": "b-3", "b": "b-5", "z": "z"}


def test_three_upserts_give_no_id_twice(spark, identities):
    now, ledger = identities, spark.createDataFrame([("solaria-alta-3",)], "canonical_id string")
    for k in range(3):
        d = spark.createDataFrame([("Solaria-alta" + "!" * k, ["Sola pura", "x"], ["c"]), (f"Nova {'abc'[k]}", None, None), ("SOLARIA ALTA", ["Solaria altissima"], ["Star"])], "accepted_name string, parsed_names array<string>, common_names array<string>")
        now = backbone.upsert(now, d, ledger)
        now = spark.createDataFrame(now.collect(), now.schema)
    ids = [r.canonical_id for r in now.collect()]
    assert len(ids) == len(set(ids)) == identities.count() + 6 and "solaria-alta-3" not in ids
    by = {r.accepted_name: r for r in now.collect()}
    assert by["Solaria-alta"].canonical_id == "solaria-alta-2" and by["Solaria-alta!"].canonical_id == "solaria-alta-4" and by["Solaria-alta"].scientific_synonyms == ["Sola pura"]
    assert "Solaria altissima" in by["Solaria alta"].scientific_synonyms and "Star" in by["Solaria alta"].common_names


def test_closed_checks_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    backbone.check_subset(b, a, "k")
    for bad in (lambda: backbone.check_same_set(a, b, "k"), lambda: backbone.check_subset(a, b, "k"), lambda: backbone.check_accounting(1, 1, 3)):
        with pytest.raises(ValueError):
            bad()
    meta = {"x": spark.createDataFrame([("v1",)], "version string")}
    audit.check_versions(meta, {"x": "v1"})
    for expected in ({"x": "v2"}, {"y": "v1"}):
        with pytest.raises(ValueError):
            audit.check_versions(meta, expected)


def test_leaks_are_found_at_any_depth(spark):
    kind = "m map<string, array<struct<key: string, value: struct<supplier_id: string, note: string>>>>, a array<struct<inner: struct<Supplier_ID: string, ok: string>>>, deep array<array<map<string, array<string>>>>, p map<string, string>"
    rows = [({"k": [("x", ("s", "an azure one"))]}, [(("s", "fine"),)], [[{"z": ["no", "AZURE"]}]], {"margin": "1"}), ({}, [None], None, {"azure": "2"}), (None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = {(r.path, r.what): r.n for r in audit.leaks(df, {"supplier_id", "margin"}, "(?i)azure").collect()}
    assert got == {("m.*[].value.supplier_id", "key"): 1, ("m.*[].value.note", "value"): 1, ("a[].inner.Supplier_ID", "key"): 1, ("deep[][].*[]", "value"): 1, ("p.margin", "key"): 1, ("p.*key", "value"): 1}
    assert audit.leaks(df.limit(0), {"supplier_id"}, "azure").count() == 0
    assert audit.leaks(df.select(F.lit(1).alias("Margin")), {"margin"}, "x").collect()[0].n == 3
    audit.check_no_leaks(df.select("p"), {"other"}, "never")
    with pytest.raises(ValueError, match="p.margin"):
        audit.check_no_leaks(df, {"margin"}, "never")


def test_rejected_events_still_count(spark):
    e = spark.createDataFrame([(i, "u", "2024-01-01 00:00:%02d" % i, "c", f) for i, f in enumerate(["MP", "MP", "RE", "OE", "SD", "MP"])], "event_id long, k string, ts string, cell string, code string").withColumn("ts", F.to_timestamp("ts"))
    limits = limiter.Limits(counters=(("per_minute", limiter.MINUTE, 10),), members=None, cells=None)
    r = {x.event_id: x.reason for x in limiter.limiter_chain(e, limits, "k", None, None, "cell", "code").collect()}
    assert [r[i] for i in range(6)] == [None, None, None, None, "candidate_enumeration", "candidate_enumeration"]


def test_transport_rejection_leaves_keys_untouched(spark):
    e = spark.createDataFrame([(i, f"k{i % 2}", "t", "2024-01-01 00:00:%02d" % i) for i in range(6)], "event_id long, k string, t string, ts string").withColumn("ts", F.to_timestamp("ts"))
    limits = limiter.Limits(transport=(("tm", limiter.MINUTE, 3),), counters=(("m", limiter.MINUTE, 1),), members=None, cells=None, formats=None)
    r = {x.event_id: x.reason for x in limiter.limiter_chain(e, limits, "k", "t", None, None, None).collect()}
    assert [r[i] for i in range(6)] == [None, None, "m", "tm", "tm", "tm"]


def fold(events, checks):
    """The chain as it is defined, event by event: (key, time, member, cell, code) -> reasons."""
    state, out = {}, []
    for key, now, *values in events:
        reason = None
        for i, (name, width, most, member, by) in enumerate(checks):
            value = None if member is None else values[member - 2]
            group = None if by is None else values[by - 2]
            if (member is not None and value is None) or (by is not None and group is None):
                continue
            held = state.get((i, key, group))
            if held is None or now - held[0] >= width:
                held = state[i, key, group] = [now, 0 if member is None else set()]
            if member is None:
                held[1] += 1
            else:
                held[1].add(value)
            if (held[1] if member is None else len(held[1])) > most:
                reason = name
                break
        out.append(reason)
    return out


@given(st.integers(0, 10**9))
@settings(max_examples=60, deadline=None)
def test_vectorised_checks_equal_the_fold(seed):
    rng = random.Random(seed)
    limits = limiter.Limits(transport=(), counters=(("a", 5, rng.randint(1, 4)), ("b", 20, rng.randint(2, 8)), ("c", 60, rng.randint(4, 20))), members=("m", rng.randint(5, 30), rng.randint(1, 4)), cells=("cells", rng.randint(5, 30), rng.randint(1, 3)), formats=("f", rng.randint(5, 50), rng.randint(1, 2)))
    events = []
    for k in range(rng.randint(1, 5)):
        now = rng.randint(-50, 50)
        for _ in range(rng.randint(1, 60)):
            now += rng.choice([0, 0, 1, 2, 3, 10])
            events.append((f"k{k}", now, *(rng.choice([*"xyzw", None]) for _ in range(3))))
    checks, state, got, i = limiter.keyed_checks(limits), {}, [], 0
    while i < len(events):  # batches that end anywhere
        part = events[i : i + rng.randint(1, 40)]
        i += len(part)
        columns = [pa.array([e[q] for e in part], pa.int64() if q == 1 else pa.string()) for q in range(5)]
        got += limiter.check_batch(state, pa.RecordBatch.from_arrays(columns, ["_key", "_t", "_m", "_c", "_f"]), checks).to_pylist()
    assert got == fold(events, checks)


def test_one_hot_key_streams_through(spark):
    """A third of the events is one key's, far more than a batch holds."""
    n = 30_000
    e = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
    got = limiter.anchored_counter(e, "k", 1000 * 1_000_000).where("k = 'hot'").orderBy("event_id").collect()
    assert [r.n for r in got] == [i % 334 + 1 for i in range(len(got))]


def test_fan_out_of_a_busy_transport(spark):
    e = spark.range(3000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 < 2, "busy").otherwise("other").alias("tr"), (F.col("id") * 7 % 501).alias("k"), F.timestamp_micros(F.floor(F.col("id") / 2) * 30_000_000).alias("ts"))
    got = {r.event_id: r.n_keys for r in limiter.fan_out(e, "tr", "k").collect()}
    seen, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r.ts, r.event_id)):
        seen.setdefault(r.tr, set()).add(r.k)
        want[r.event_id] = len(seen[r.tr])
    assert got == want


@pytest.mark.parametrize("values", [list(range(1000)), [5] * 1000, [1, 2], [7], [0] * 990 + [10**9] * 10, [i * i % 97 for i in range(5000)]])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("n", None), ("z", 3.0)], "k string, v double").repartition(4)
    r = {x.k: x for x in graph.percentile_floor(df, "k", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, accuracy=200).collect()}
    order = sorted(values)
    assert set(r) == {"k", "z"} and r["k"].n == len(values)
    assert [r["k"][c] for c in ("p0", "p50", "p95", "p100")] == [order[min(len(order) - 1, int(p * len(order)))] for p in (0.0, 0.5, 0.95, 1.0)]


def test_index_artifacts_are_published_whole(spark, identities, tmp_path):
    pins = spark.createDataFrame([], "key string, pin string")
    store = index.IndexStore(spark, str(tmp_path / "indices"))
    version = index.version_of(identities, pins)
    failing = identities.withColumn("common_names", F.array(F.raise_error(F.lit("no")).cast("string")))
    with pytest.raises(Exception, match="no"):
        store.build(failing, pins, version)
    assert store.published(version) is None  # the failed build left nothing to read
    exact, common = store.open(identities, pins)
    folder, _ = store.published(version)
    same = lambda a, b: a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()
    assert same(index.exact_index(identities), exact) and same(index.serving_common(identities, pins), common)
    store.open(identities.orderBy("rec_ord"), pins)
    store.build(identities, pins, version)  # the first to publish stays
    assert store.published(version)[0] == folder
    changed = identities.withColumn("accepted_name", F.concat("accepted_name", F.lit("x")))
    assert index.version_of(changed, pins) != version and same(index.exact_index(changed), store.open(changed, pins)[0])


def test_resolvers_do_not_shuffle_the_index(spark, identities, tmp_path):
    exact, common = index.IndexStore(spark, str(tmp_path / "indices")).open(identities, spark.createDataFrame([], "key string, pin string"))
    inputs = spark.createDataFrame([(None, "Sunleaf"), ("Solaria alta", "x")], "latin string, label string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resolve.resolve_serving(inputs, exact, common)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning(key") == 1


def test_counted_windows_drop_what_is_too_late(spark, tmp_path):
    from resolvent.streaming.limiter import counted_windows

    # What is late is judged by the watermark that the batch before began with.
    rows = [[(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00")], [(3, "2024-01-01 05:00:00")], [(7, "2024-01-01 05:05:00")], [(4, "2024-01-01 00:20:00"), (5, "2024-01-01 05:10:00")], [(6, "2024-01-01 09:00:00")]]
    for part in rows:
        time.sleep(1.1)  # files are taken in order of their times
        spark.createDataFrame([(i, t, "a") for i, t in part], "event_id long, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counted_windows(source).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    q.stop()
    assert sorted((str(r.start), r.n) for r in spark.table("counted").collect())[:2] == [("2024-01-01 00:00:00", 2), ("2024-01-01 05:00:00", 3)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿TYPE,Title\n Fine Meal ,Sunleaf\n,none\nGadget,\n".encode())
    assert [(r.type, r.title) for r in readers.read_catalogue(spark, str(tmp_path / "c.csv")).collect()] == [("Fine Meal", "Sunleaf")]
    with pytest.raises(ValueError):
        readers.read_catalogue(spark, str(tmp_path / "c.csv"), {"x": "absent"})
    (tmp_path / "m.txt").write_text("sun -> Solaria vulga\n\nno arrow\na -> b -> c\n")
    assert [tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "m.txt")).collect()] == [("sun", "Solaria vulga"), ("a", "b -> c")]
    (tmp_path / "w.js").write_text("window.X = " + json.dumps({"n": 3, "rows": [{"a": 1}, {"a": 2}]}) + ";\n")
    assert readers.read_wrapped_literal(spark, str(tmp_path / "w.js"), "n INT, rows ARRAY<STRUCT<a: INT>>").first().n == 3
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    assert readers.read_json_document(spark, str(tmp_path / "d.json"), "rows ARRAY<STRUCT<a: INT>>", "rows").count() == 2
    assert len(readers.file_digests(spark, str(tmp_path / "d.json")).first().sha256) == 64
    sinks.write_artifact(spark.range(3), str(tmp_path / "art"), "x", "v1")
    (tmp_path / "art" / "manifest.json").write_text(json.dumps({"artifact": "x", "version": "v1"}))
    assert readers.read_versioned(spark, str(tmp_path / "art"))["x"].count() == 3
    df = spark.createDataFrame([(1, None, ["a"], False), (2, "s", [], True)], "a int, b string, c array<string>, d boolean")
    assert [r.payload for r in sinks.minimal_payload(df, ["a", "b", "c", "d"]).collect()] == ['{"a":1,"c":["a"]}', '{"a":2,"b":"s","d":true}']
    assert "| 1 |" in sinks.markdown_report(spark, "T", spark.createDataFrame([(1,)], "n int"))
    from resolvent.plans.source_queries import _workbook

    (tmp_path / "b.xlsx").write_bytes(_workbook([("Name", 0), ("Sun & Moon", 7)]))
    got = readers.read_sheet_cells(spark, str(tmp_path / "b.xlsx")).orderBy("row_no").collect()
    assert [r.cells for r in got] == [["Name", "", "0", "a <b>", "False", "2024-01-01 00:00:00"], ["Sun & Moon", "", "7", "a <b>", "True", "2024-01-08 00:00:00"]]
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_sheet_cells(spark, str(tmp_path / "none.xlsx"))


def test_ragged_sheets(spark):
    sheet = spark.createDataFrame(
        [("f", 0, ["x"]), ("f", 1, ["No", "Name", "BOTANICAL"]), ("f", 2, ["1", "Sun", "Solaria"]), ("f", 3, ["BOTANICAL", "", "Name"]), ("f", 4, ["Lunaria", "", "Moon"]), ("f", 5, ["total", "q", "r"])],
        "file string, row_no long, cells array<string>",
    )
    r = adapters.under_headers(sheet, "botanical", {"label": "name", "latin": "botanical"}).orderBy("row_no").collect()
    assert [(x.label, x.latin) for x in r] == [("Sun", "Solaria"), ("Moon", "Lunaria"), ("r", "total")]
    r = adapters.fixed_offsets(sheet, 1, {"label": 1, "latin": 2}, serial=0).collect()
    assert [(x.label, x.latin) for x in r] == [("Sun", "Solaria")]
    r = adapters.side_by_side(sheet, [{"label": 0}, {"label": 2}], "total", start=2).collect()
    assert sorted(x.label for x in r) == ["1", "BOTANICAL", "Lunaria", "Moon", "Name", "Solaria"]
    odd = spark.createDataFrame([("f", 0, ["9", "Sun (Solaria)", "root", "20% x", "Solarin"])], "file string, row_no long, cells array<string>")
    x = adapters.by_pattern(odd).first()
    assert (x.label, x.assay_raw, x.marker, x.part_text) == ("Sun (Solaria)", "20% x", "Solarin", "root")
    reg = readers.Adapters()
    reg.register("s")(lambda spark, path: adapters.by_pattern(odd))
    assert reg.all(spark, {"s": ""}).select("supplier_id", "label").first()[:] == ("s", "Sun (Solaria)")
