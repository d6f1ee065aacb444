"""Queries of supplier ingest and of the backbone's curation, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import backbone, decide, graph, ingest, scan
from ..session import table
from . import catalogue as c
from . import sql as q
from .decision_queries import _CELLS
from .graph_queries import _LONG
from .resolution import _LONGEST, _grouped


def supplier_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as raw supplier rows: the brand is the supplier, names come whole, glued, in joined case or not at all."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.split("p_name", " ")[0].alias("adj"), F.split("p_name", " ")[1].alias("noun"))
    k = F.pmod("p_partkey", F.lit(5))
    cap = F.initcap("noun")
    label = (
        F.when(k == 0, F.col("p_name")).when(k == 1, F.col("noun")).when(k == 2, F.concat("p_name", F.lit(" ("), cap, F.lit(" "), "adj", F.lit(") extract freeze dried")))
        .when(k == 3, F.concat(F.lit("zz "), "p_type", F.lit(" seed"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" root spray dried")))
    )
    latin = F.when((k == 3) & (F.col("p_size") > 25), F.concat(cap, "adj")).when((k == 4) & (F.col("p_size") > 25), F.concat(cap, F.initcap("adj")))
    assay = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size"), F.lit(":1"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size"), F.lit("%")))
    return p.select(F.col("p_brand").alias("supplier_id"), F.col("p_partkey").alias("row_no"), F.when(F.col("p_size") == 50, " ").otherwise(label).alias("label"), latin.alias("latin"), F.lit("").alias("part_text"), assay.alias("assay_raw"))


def _ingest(spark: SparkSession, sf: str) -> ingest.Ingest:
    genera = c.names(spark, sf).select(F.initcap("noun").alias("genus")).distinct()
    return ingest.ingest(supplier_rows(spark, sf), *c.indices(spark, sf), genera)


def ingest_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = _ingest(spark, sf).rows
    return r.select("row_no", "label", "name", "canonical_id", "match_method", "part", "base", F.array_join("review_flags", ",").alias("flags"), "ratio", "percent", "repair")


def ingest_queues(spark: SparkSession, sf: str) -> DataFrame:
    """Review and unresolved entries together: a row may be in several queues."""
    got = _ingest(spark, sf)
    review = got.review.select("row_no", "type", F.array_join("detail", ",").alias("detail"))
    return review.unionByName(got.unresolved.select("row_no", F.concat(F.lit("unresolved_"), "type").alias("type"), F.col("candidate").alias("detail")))


def ingest_supplier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _ingest(spark, sf).metrics


def ingest_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.distribution(_ingest(spark, sf).rows, ingest.signature())


def _titles_beside(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of suppliers, a third of which no index knows."""
    k = F.pmod("p_partkey", F.lit(3))
    strange = F.when(k == 0, F.col("title")).when((k == 1) & (F.col("p_size") > 25), F.concat(F.lit("Zinnia "), F.split("p_name", " ")[1], F.lit(" - fresh"))).when(k == 1, F.concat(F.lit("zinnia "), F.split("p_name", " ")[1], F.lit(" seed"))).otherwise(F.concat(F.lit("Zz "), F.lower("p_type"), F.lit(" 500gm")))
    return c.titles(spark, sf).select(F.col("p_brand").alias("supplier_id"), F.col("p_partkey").alias("ord"), strange.alias("title"))


def delta_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = ingest.extract_delta(_titles_beside(spark, sf), *c.indices(spark, sf)).candidates
    return d.select("key", "candidate", "type", "n_listings", F.size("suppliers").cast("long").alias("n_suppliers"), F.array_join("examples", "|").alias("examples"))


def delta_recovered(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.extract_delta(_titles_beside(spark, sf), *c.indices(spark, sf)).recovered.select("ord", "canonical_id", "match_method", "tiebreak")


def worklist_keep(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(5))
    key = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.split("p_name", " ")[0], F.lit(" seed"))).when(k == 2, F.concat("p_name", F.lit(" salt"))).when(k == 3, F.substring("p_name", 1, 2)).otherwise(F.when(F.col("p_size") > 25, "egg shell").otherwise("organic powder"))
    return table(spark, sf, "part").select("p_partkey", key.alias("key")).withColumn("keep", ingest.keep_for_work("key"))


def family_difference(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("family"))
    return ingest.other_families(s, table(spark, sf, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("family"))).select("supplier_id", "family")


def review_cost(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n"))
    reason = F.when(F.col("p_size") > 40, "near_duplicate_latin").when(F.col("p_size") > 30, "multi_dash_latin_not_final").when(F.col("p_size") > 20, "no_latin")
    flags = table(spark, sf, "part").select(F.col("p_name").alias("key"), reason.alias("reason")).where("reason is not null")
    return ingest.review_cost(graph.top_cohort(t, 50), flags)


def ladder_observed(spark: SparkSession, sf: str) -> DataFrame:
    seen = c.cell_formats(spark, sf).where("tier <> 'avoid'").groupBy("product", "role").agg(F.collect_set("code").alias("seen"))
    j = c.cells(spark, sf).join(seen, ["product", "role"], "left")
    return j.select("product", "role", F.array_join(graph.observed_ladder(F.concat("preferred", "conditional"), F.col("seen")), ",").alias("observed"))


def storefront_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The nested graph without counts, unfolded again."""
    from .graph_queries import _graph

    slim = graph.storefront(graph.nested_graph(_graph(spark, sf)))
    rows = slim.select("canonical_id", F.explode("parts").alias("part", "forms")).select("canonical_id", "part", F.explode("forms").alias("f"))
    return rows.select("canonical_id", "part", F.col("f.key").alias("signature"), F.to_json("f.value").alias("payload"))


def alias_pools(spark: SparkSession, sf: str) -> DataFrame:
    n = c.names(spark, sf)
    cap = F.concat(F.initcap("noun"), F.lit(" "), "adj")
    keys = F.array("p_name", cap, F.concat(F.initcap("noun"), F.lit(" seed")), F.concat(F.initcap("adj"), F.lit(" "), "noun"))
    pool = backbone.alias_pool(keys, F.array(F.lit("Corrected name"), "noun"), F.when(F.col("adj") != "old", cap), F.array("p_name"))
    return n.select("p_name", pool.alias("a")).select("p_name", F.array_join("a.scientific", "|").alias("scientific"), F.array_join("a.common", "|").alias("common"))


def name_flip(spark: SparkSession, sf: str) -> DataFrame:
    i = c.identities(spark, sf).withColumn("authority_name", F.when(F.col("canonical_id").startswith("old-"), F.lit("Antiqua nova")).when(F.col("canonical_id").startswith("new-"), F.col("accepted_name")))
    i = i.withColumn("accepted_name", F.when(F.col("canonical_id").endswith("-ring"), F.concat("accepted_name", F.lit(" seed"))).otherwise(F.col("accepted_name")))
    return backbone.flip_names(i).select("canonical_id", "accepted_name", "trade_primary_name", "canonical_display_name", F.array_join("scientific_synonyms", "|").alias("synonyms"))


def _authority(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names, matches and usages of an authority: every kind of answer, by adjective."""
    n = c.names(spark, sf).select("adj", "noun", F.concat(F.initcap("noun"), F.lit(" "), "adj").alias("name"))
    a = F.col("adj")
    matches = n.where("adj <> 'large'").select(
        "name", F.when(a.isin("blue", "cold", "old"), "EXACT").when(a == "hot", "FUZZY").when(a == "red", "HIGHERRANK").otherwise("NONE").alias("match_type"),
        F.when(a == "blue", "ACCEPTED").when(a == "cold", "SYNONYM").when(a == "old", "DOUBTFUL").otherwise("ACCEPTED").alias("status"), F.when(a == "red", "GENUS").otherwise("SPECIES").alias("rank"),
        F.when(a != "new", F.lit(1)).cast("long").alias("usage_key"), F.when(a == "hot", F.concat("name", F.lit("ta"))).otherwise(F.col("name")).alias("canonical"), F.when((a == "cold") & (F.col("noun") != "rod"), "Frigida nova").alias("accepted_canonical"),
    )
    use = lambda where, status, accepted: n.where(where).select("name", F.upper("name").alias("canonical"), F.lit("SPECIES").alias("rank"), F.lit(status).alias("status"), accepted.alias("accepted"))
    to = lambda x: F.concat(F.lit(x), F.lit(" L."))
    usages = use("adj = 'new'", "SYNONYM", to("Alba prima")).unionByName(use("adj = 'new' and noun in ('rod', 'ring')", "SYNONYM", to("Alba altera"))).unionByName(use("adj = 'old'", "ACCEPTED", F.lit(None).cast("string"))).unionByName(use("adj = 'large'", "SYNONYM", to("Magna sola")))
    return n.select("name"), matches, usages.unionByName(n.where("adj = 'red'").select("name", F.concat("name", F.lit(" x")).alias("canonical"), F.lit("SPECIES").alias("rank"), F.lit("ACCEPTED").alias("status"), F.lit(None).cast("string").alias("accepted")))


def authority_classes(spark: SparkSession, sf: str) -> DataFrame:
    return backbone.classify_authority(*_authority(spark, sf)).select("name", "disposition", "accepted", "ambiguous", F.array_join("candidates", ",").alias("candidates"), "suggested", "distance", "match_type")


def authority_recheck(spark: SparkSession, sf: str) -> DataFrame:
    return backbone.recheck(*_authority(spark, sf)).select("name", "status", "accepted", F.array_join("candidates", ",").alias("candidates"), "suggested")


DECISIONS = [("Rod hot", "correct", None), ("Ring hot", "exclude", None), ("Rod new", "accept", "Alba prima"), ("Ring red", "genus", "Ring"), ("Rod red", "trade_ambiguous", None), ("Bolt small", "ambiguous", None), ("Gear hot", "correct", "Gear calida")]


def identity_groups(spark: SparkSession, sf: str) -> DataFrame:
    decisions = spark.createDataFrame(DECISIONS, "name string, action string, target string")
    g = backbone.group_records(backbone.dispose(backbone.classify_authority(*_authority(spark, sf)), decisions))
    return g.select("group_key", "accepted_name", "resolution_status", "ambiguity_flag", F.array_join("original_parsed_names", ",").alias("names"), "n_names", F.array_join("candidates", ",").alias("candidates"))


def triage_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown names under decisions; those on rings have two, of which the order of precedence picks one."""
    n = c.names(spark, sf)
    d = n.where("adj <> 'blue'").select(F.col("p_name").alias("name"), F.get(F.array(*[F.lit(x) for x in ("unresolvable", "non_botanical", "genus_level", "species_ambiguous", "common_resolved", "resolved")]), F.pmod(F.length("p_name"), F.lit(6))).alias("decision"), F.initcap("noun").alias("value"))
    d = d.unionByName(n.where("noun = 'ring' and adj <> 'blue'").select(F.col("p_name").alias("name"), F.lit("resolved").alias("decision"), F.lit("Ring sola").alias("value")))
    return backbone.triage(n.select(F.col("p_name").alias("name")), d)


def enrichment_set(spark: SparkSession, sf: str) -> DataFrame:
    r = backbone.classify_authority(*_authority(spark, sf)).withColumn("ord", F.col("name"))
    return backbone.enrichment(r).select("accepted_name", "via", F.array_join("parsed_names", ",").alias("parsed_names"))


def mapping_round(spark: SparkSession, sf: str) -> DataFrame:
    n = c.names(spark, sf)
    maps = n.select(F.concat(F.lit(" "), F.upper("p_name")).alias("common_name"), F.initcap("noun").alias("accepted")).unionByName(n.select(F.col("p_name").alias("common_name"), F.initcap("noun").alias("accepted")))
    fixed = n.where("adj = 'hot'").select(F.col("p_name").alias("common_name"), F.lit("Calida nova").alias("accepted"))
    out = n.where("adj = 'old'").select(F.initcap("p_name").alias("common_name"))
    kept, gone = backbone.mapping_round(maps, fixed, out)
    return kept.select("accepted", F.array_join("common_names", "|").alias("common_names"), "n_corrected").unionByName(gone.groupBy(F.lit("excluded").alias("accepted")).agg(F.array_join(F.array_sort(F.collect_set("common_name")), "|").alias("common_names"), F.lit(0).cast("long").alias("n_corrected")))


def adopted_names(spark: SparkSession, sf: str) -> DataFrame:
    n = c.names(spark, sf)
    new = n.where("adj = 'cold'").select(F.col("p_name").alias("name"), F.concat(F.initcap("noun"), F.lit(" frigida")).alias("accepted"))
    return backbone.adopt(n.select(F.col("p_name").alias("name"), F.initcap("p_name").alias("accepted_name")), new, new.count())


def _patch_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Identities and a log of patches in twelve steps; later ones aim at names that earlier ones gave."""
    i = c.identities(spark, sf).withColumns({"adj": F.split("canonical_id", "-")[0], "noun": F.split("canonical_id", "-")[1]})
    n = scan.numbered(i, ["canonical_id"], "nr")
    none = F.lit(None).cast("string")
    new_name = F.concat(F.initcap("noun"), F.lit(" antiqua"))

    def step(k: int, where: str, action: str, by: str, target, value=None, names=None, note=None, date=None) -> DataFrame:
        as_list = F.lit(None).cast("array<string>") if names is None else F.array(names if not isinstance(names, str) else F.lit(names))
        text_ = lambda x: none if x is None else F.lit(x) if isinstance(x, str) else x
        return n.where(where).select((F.col("nr") + k * 1_000_000).alias("place"), F.lit(action).alias("action"), F.lit(by).alias("by"), text_(target).alias("target"), text_(value).alias("value"), as_list.alias("names"), text_(note).alias("note"), text_(date).alias("date"))

    old = "adj = 'old'"
    name, ident = F.col("accepted_name"), F.col("canonical_id")
    steps = [
        step(1, old, "add_common", "name", F.upper("accepted_name"), names="new common", note="n1", date="2024-01-01"), step(2, f"{old} and noun in ('rod', 'bolt')", "adopt", "name", name, value=new_name),
        step(3, f"{old} and noun in ('rod', 'bolt')", "note", "name", new_name, note="renamed"), step(4, old, "remove_common", "id", ident, names=F.col("noun")), step(5, f"{old} and noun in ('ring', 'gear')", "ambiguous", "id", ident, names="A b"),
        step(6, f"{old} and noun = 'ring'", "note", "name", name, note="was a ring"), step(7, "adj = 'cold'", "keep_synonym", "name", name, value="Frigida nova"), step(8, "nr = 1", "add_common", "name", "Nova absens", names="New one"),
        step(9, "nr = 1", "note", "name", "nova ABSENS", note="later"), step(10, "nr = 1", "note", "name", "Nobody", note="x"), step(11, "adj = 'hot'", "remove_common", "id", ident, names="zz"), step(12, "canonical_id = 'cold-rod'", "adopt", "name", name, value=name),
    ]
    log = steps[0]
    for x in steps[1:]:
        log = log.unionByName(x)
    return i.drop("adj", "noun"), log


def adjudication_patches(spark: SparkSession, sf: str) -> DataFrame:
    done, _ = backbone.patch(*_patch_log(spark, sf))
    return done.select(
        "canonical_id", "accepted_name", "genus", "species", "accepted_rank", "ambiguity_flag", "resolution_status", "adjudication", "note", "review_date", F.array_join("candidates", "|").alias("candidates"),
        F.array_join("scientific_synonyms", "|").alias("synonyms"), F.array_join(F.array_sort("common_names"), "|").alias("commons"),
    )


def adjudication_report(spark: SparkSession, sf: str) -> DataFrame:
    return backbone.patch(*_patch_log(spark, sf))[1]


def set_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the fail-closed checks of sets and accounts hold on the driver's keys."""
    o, l, s = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), table(spark, sf, "supplier")

    def holds(check, *args) -> bool:
        try:
            check(*args)
        except ValueError:
            return False
        return True

    n, kept = s.count(), s.where("s_acctbal >= 0").count()
    rows = [("same", holds(backbone.check_same_set, l, o, "o_orderkey")), ("subset", holds(backbone.check_subset, l, o, "o_orderkey")), ("superset", holds(backbone.check_subset, o, l, "o_orderkey")), ("accounts", holds(backbone.check_accounting, kept, s.where("s_acctbal < 0").count(), n)), ("lost", holds(backbone.check_accounting, kept, 0, n))]
    return spark.createDataFrame(rows, "name string, holds boolean")


def truncation_report(spark: SparkSession, sf: str) -> DataFrame:
    r = graph.truncated(table(spark, sf, "nation"), F.col("n_name"), 5)
    return r.select("total", F.array_join("shown", ",").alias("shown"), "truncated")


def sentinel_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Records in order of accepted name, those without one last by id, with their place in the whole table."""
    i = c.identities(spark, sf).withColumn("accepted_name", F.when(~F.col("canonical_id").startswith("old-"), F.col("accepted_name")))
    key = F.coalesce("accepted_name", F.concat(F.lit("~"), "canonical_id"))
    return scan.numbered(i.select("canonical_id", key.alias("key")), ["key"], "place").select("canonical_id", "place")


def locale_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Names with accents and capitals in a locale's order, with their place: letters first, then accents, then case."""
    n = c.names(spark, sf)
    shown = F.when(F.col("adj") == "cold", F.translate("p_name", "o", "ö")).when(F.col("adj") == "large", F.initcap("p_name")).when(F.col("adj") == "hot", F.translate("p_name", "oe", "óé")).when(F.col("adj") == "new", F.upper("p_name")).otherwise(F.col("p_name"))
    return scan.numbered(n.select(shown.alias("name")), [F.collate("name", "UNICODE"), "name"], "place").select("name", "place")


def map_references(spark: SparkSession, sf: str) -> DataFrame:
    per = c.catalogue(spark, sf).groupBy("type", "part").agg(F.count("*").alias("n")).groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"))
    return per.select("type", graph.references(F.col("m")).alias("n"))


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """White space, trailing parentheses, country tags, cleaned names, canonical names, name parts and binomial shapes."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.split("p_name", " ")[0].alias("adj"), F.split("p_name", " ")[1].alias("noun"), "p_size")
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "[IN]  ").otherwise(" "), F.initcap("p_name"), F.lit("  powder"), F.when(F.col("p_size") % 3 == 0, " (a) ( b )").otherwise(" "))
    sci = F.concat(F.initcap("noun"), F.lit(" "), "adj", F.when(F.col("p_size") % 3 == 1, " var. alba (L.) Mill.").when(F.col("p_size") % 3 == 2, " L.").otherwise(""))
    bare, groups = text.strip_trailing_parens(raw)
    parts = text.name_parts(F.regexp_replace(sci, " \\(L\\.\\) Mill\\.| L\\.", ""))
    return p.select(
        "p_partkey", text.squeeze(raw).alias("squeezed"), text.squeeze(bare).alias("bare"), F.array_join(groups, ",").alias("groups"), text.country_tag(raw).alias("country"), text.clean_common(bare).alias("common"),
        text.canonical_of(sci).alias("canonical"), parts["genus"].alias("genus"), parts["infra"].alias("infra"), parts["rank"].alias("rank"), text.is_scientific(F.concat(F.initcap("noun"), F.lit(" "), F.when(F.col("p_size") > 25, "seed").otherwise(F.col("adj")))).alias("scientific"),
        text.plant_part_anywhere([F.concat("noun", F.lit("ring")), F.concat("adj", F.lit(" leaves"))]).alias("part"),
    )


def botanical_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of a botanical catalogue: its form and part words go, and its vernacular last words make no scientific name."""
    v, k = text.BOTANICAL, F.col("p_partkey")
    nth = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(k, F.lit(len(xs))).cast("int"))
    label = F.concat(F.initcap(nth(v.form)), F.lit(" "), "p_name", F.lit(" (x y) "), nth(v.parts), F.lit(" "), nth(v.noise))
    last = F.when(F.col("p_size") % 2 == 0, nth(v.vernacular)).otherwise(F.split("p_name", " ")[0])
    p = table(spark, sf, "part").select("p_partkey", label.alias("label"), F.concat(F.initcap(F.split("p_name", " ")[1]), F.lit(" "), last).alias("name"))
    return p.select("p_partkey", text.part_strip("label", v).alias("stripped"), text.clean_label("label", v).alias("cleaned"), text.is_scientific("name", v.vernacular).alias("scientific"), F.array_join(text.ngram_candidates("name", v), "|").alias("ngrams"))


def caveats(spark: SparkSession, sf: str) -> DataFrame:
    sel = decide.select_ladder(c.cells(spark, sf), c.cell_formats(spark, sf)).select("product", "role", "k", "selected")
    f = c.cell_formats(spark, sf).select("product", "role", F.col("code").alias("selected"), "note")
    status = F.when(F.col("k") % 5 == 0, "ambiguous").when(F.col("k") % 5 == 1, "unrecognised").otherwise("resolved")
    return sel.join(f, ["product", "role", "selected"], "left").select("product", "role", decide.one_caveat(status, F.col("selected"), F.col("note")).alias("caveat"))


QUERIES = {f.__name__: f for f in (ingest_rows, ingest_queues, ingest_supplier_metrics, ingest_distribution, delta_extract, delta_recovered, worklist_keep, family_difference, review_cost, ladder_observed, storefront_graph, alias_pools, name_flip, authority_classes, authority_recheck, identity_groups, triage_overlay, enrichment_set, mapping_round, adopted_names, adjudication_patches, adjudication_report, set_assertions, truncation_report, sentinel_sort, locale_sort, map_references, text_functions, botanical_titles, caveats)}


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_CAPN = "upper(noun[1]) || noun[2:]"
_CAPA = "upper(adj[1]) || adj[2:]"
_RAW = f"""sup AS (SELECT p_brand AS supplier_id, p_partkey AS row_no, p_size, adj, noun, p_partkey % 5 AS k, trim(CASE WHEN p_size = 50 THEN ' ' ELSE CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN noun WHEN 2 THEN p_name || ' (' || {_CAPN} || ' ' || adj || ') extract freeze dried' WHEN 3 THEN 'zz ' || p_type || ' seed' ELSE p_name || ' root spray dried' END END) AS label,
  CASE WHEN p_size > 25 AND p_partkey % 5 = 3 THEN {_CAPN} || adj WHEN p_size > 25 AND p_partkey % 5 = 4 THEN {_CAPN} || {_CAPA} END AS given, CASE p_size % 3 WHEN 0 THEN p_size || ':1' WHEN 1 THEN p_size || '%' END AS assay FROM (SELECT *, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part)),
fx AS (SELECT *, CASE WHEN given IS NULL THEN 'none' WHEN regexp_matches(given, '[a-z][A-Z]') THEN 'case_boundary_split' WHEN length(given) > 8 AND length(adj) >= 3 THEN 'glued_genus_split' ELSE 'none' END AS repair FROM sup WHERE label <> ''),
nm AS (SELECT *, CASE WHEN repair = 'case_boundary_split' THEN {_CAPN} || ' ' || {_CAPA} WHEN repair = 'glued_genus_split' THEN {_CAPN} || ' ' || adj WHEN given IS NOT NULL THEN given WHEN k = 2 AND NOT list_contains({_list(text.DEFAULT.form)}, noun) AND NOT list_contains({q.FORM_PART}, adj) THEN {_CAPN} || ' ' || adj END AS name FROM fx)"""
_INGEST = f"""{q.INDEX}, {_RAW}, lab AS (SELECT name AS latin, label FROM nm), {q.hits('lab', 'latin, label', q.serving_cands(False))}, {_grouped('latin, label', False, True)},
rows_ AS (SELECT n.*, r.canonical_id, r.match_method, r.candidates, CASE WHEN k = 2 THEN ['freeze_dried_extract'] ELSE [] END AS flags, CASE WHEN k = 4 THEN 'SD' ELSE 'RE' END AS base,
  CASE WHEN contains(n.label, 'ring') AND (NOT contains(n.label, 'seed') OR position('ring' IN n.label) < position('seed' IN n.label)) AND (NOT contains(n.label, 'root') OR position('ring' IN n.label) < position('root' IN n.label)) THEN 'ring' WHEN contains(n.label, 'seed') THEN 'seed' WHEN contains(n.label, 'root') THEN 'root' ELSE 'unspecified' END AS part
  FROM nm n JOIN res r ON r.label = n.label AND r.latin IS NOT DISTINCT FROM n.name)"""
_STRANGE = f"""{q.TITLES}, strange AS (SELECT p_brand AS supplier_id, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN title WHEN p_partkey % 3 = 1 AND p_size > 25 THEN 'Zinnia ' || split_part(p_name, ' ', 2) || ' - fresh' WHEN p_partkey % 3 = 1 THEN 'zinnia ' || split_part(p_name, ' ', 2) || ' seed' ELSE 'Zz ' || lower(p_type) || ' 500gm' END AS title FROM titled)"""
_DELTA = f"{q.INDEX}, {_STRANGE}, {_LONGEST.replace('FROM titled', 'FROM strange')}"
_BIN = f"list_transform(list_filter(regexp_extract_all(title, '\\b[A-Za-z][a-z]+\\s+[A-Za-z][a-z]{{2,}}(?:-[a-z]+)?\\b'), lambda m: NOT list_contains({q.STOPPED}, lower(split_part(m, ' ', 1))) AND NOT list_contains({q.STOPPED}, lower(split_part(m, ' ', 2)))), lambda m: upper(m[1]) || lower(split_part(m, ' ', 1)[2:]) || ' ' || lower(split_part(m, ' ', 2)))"
_NAUTH = f"n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part), nn AS (SELECT *, {_CAPN} || ' ' || adj AS name FROM n)"
_RANKS = "('SPECIES', 'SUBSPECIES', 'VARIETY', 'FORM')"
_USAGE = "SELECT name, upper(name) AS canonical, 'SPECIES' AS rank, '{status}' AS status, {to} AS accepted FROM nn WHERE {where}"
#: The authority's answers as tables, and its rules over them.
_CLASS = f"""{_NAUTH}, mt AS (SELECT name, CASE WHEN adj IN ('blue', 'cold', 'old') THEN 'EXACT' WHEN adj = 'hot' THEN 'FUZZY' WHEN adj = 'red' THEN 'HIGHERRANK' ELSE 'NONE' END AS match_type, CASE adj WHEN 'cold' THEN 'SYNONYM' WHEN 'old' THEN 'DOUBTFUL' ELSE 'ACCEPTED' END AS status,
  CASE WHEN adj = 'red' THEN 'GENUS' ELSE 'SPECIES' END AS rank, CASE WHEN adj <> 'new' THEN 1 END AS usage_key, CASE WHEN adj = 'hot' THEN name || 'ta' ELSE name END AS canonical, CASE WHEN adj = 'cold' AND noun <> 'rod' THEN 'Frigida nova' END AS accepted_canonical FROM nn WHERE adj <> 'large'),
us AS ({_USAGE.format(status='SYNONYM', to="'Alba prima L.'", where="adj = 'new'")} UNION ALL {_USAGE.format(status='SYNONYM', to="'Alba altera L.'", where="adj = 'new' AND noun IN ('rod', 'ring')")} UNION ALL {_USAGE.format(status='ACCEPTED', to='NULL', where="adj = 'old'")} UNION ALL {_USAGE.format(status='SYNONYM', to="'Magna sola L.'", where="adj = 'large'")}
  UNION ALL SELECT name, name || ' x', 'SPECIES', 'ACCEPTED', NULL FROM nn WHERE adj = 'red'),
uu AS (SELECT name, min(canonical) FILTER (WHERE status = 'ACCEPTED') AS own, list_sort(list_distinct(list(regexp_extract(accepted, '^[A-Z][a-zA-Z-]+ [a-z][a-zA-Z-]+')) FILTER (WHERE accepted IS NOT NULL))) AS targets FROM us WHERE lower(canonical) = lower(name) AND rank IN {_RANKS} GROUP BY name),
aj AS (SELECT nn.*, coalesce(match_type, 'NONE') AS kind, status, rank, usage_key, canonical, accepted_canonical, own, coalesce(targets, []) AS targets, coalesce(match_type, 'NONE') IN ('NONE', 'HIGHERRANK') OR usage_key IS NULL OR NOT coalesce(rank IN {_RANKS}, false) OR coalesce(status = 'DOUBTFUL', false) AS back FROM nn LEFT JOIN mt USING (name) LEFT JOIN uu USING (name)),
cl AS (SELECT *, CASE WHEN back THEN CASE WHEN own IS NOT NULL THEN 'accepted' WHEN len(targets) > 0 THEN 'synonym' ELSE 'unknown' END WHEN kind = 'FUZZY' THEN 'typo' WHEN status = 'SYNONYM' THEN 'synonym' ELSE 'accepted' END AS disposition,
  CASE WHEN back THEN coalesce(own, CASE WHEN len(targets) = 1 THEN targets[1] END) WHEN kind = 'FUZZY' THEN NULL WHEN status = 'SYNONYM' THEN coalesce(accepted_canonical, canonical) ELSE canonical END AS accepted, back AND own IS NULL AND len(targets) > 1 AS ambiguous FROM aj)"""
_DEC = "dec(name, action, target) AS (VALUES " + ", ".join(f"({q.quoted(a)}, {q.quoted(b)}, {q.quoted(d)})" for a, b, d in DECISIONS) + ")"
_PATCHED = f"{q.IDENTITIES}, i AS (SELECT ident.*, adj, noun, row_number() OVER (ORDER BY canonical_id) AS nr, adj = 'old' AS old, adj = 'old' AND noun IN ('ring', 'gear') AS unsure, {_CAPN} || ' antiqua' AS newname FROM ident JOIN names ON canonical_id = adj || '-' || noun)"
ORACLE_SQL = {
    "ingest_rows": f"""WITH {_INGEST} SELECT row_no, label, name, canonical_id, match_method, part, base, array_to_string(flags, ',') AS flags, CASE WHEN p_size % 3 = 0 THEN p_size || ':1' END AS ratio, CASE WHEN p_size % 3 = 1 THEN p_size::DOUBLE END AS percent, repair FROM rows_""",
    "ingest_queues": f"""WITH {_INGEST} SELECT row_no, 'ambiguous_common_name' AS type, candidates AS detail FROM rows_ WHERE match_method = 'ambiguous' UNION ALL SELECT row_no, 'form_normalization_disagreement', array_to_string(flags, ',') FROM rows_ WHERE len(flags) > 0
      UNION ALL SELECT row_no, CASE WHEN name IS NULL THEN 'unresolved_common_only' ELSE 'unresolved_latin' END, coalesce(name, array_to_string({q.tokens('label', q.FORM_PART)}, ' ')) FROM rows_ WHERE match_method = 'unresolved'""",
    "ingest_supplier_metrics": f"""WITH {_INGEST} SELECT supplier_id, count(*) AS n_rows, count(*) FILTER (WHERE canonical_id IS NOT NULL) AS n_resolved, count(*) FILTER (WHERE match_method = 'ambiguous') AS n_ambiguous, count(*) FILTER (WHERE match_method = 'unresolved') AS n_unresolved,
      round(count(*) FILTER (WHERE canonical_id IS NOT NULL) / count(*), 3) AS identity_rate FROM rows_ GROUP BY supplier_id""",
    "ingest_distribution": f"WITH {_INGEST} SELECT supplier_id, base AS value, count(*) AS n FROM rows_ GROUP BY ALL",
    "delta_extract": f"""WITH {_DELTA}, rest AS (SELECT s.*, {_BIN}[1] AS b, coalesce(nullif(array_to_string({q.NGRAM_WORDS}, ' '), ''), regexp_split_to_array(title, '[^A-Za-z]+')[1]) AS core FROM strange s JOIN res r USING (title) WHERE r.match_method = 'unresolved'),
      d AS (SELECT *, b IS NOT NULL AS l, coalesce(b, core) AS text, {q.norm('coalesce(b, core)')} AS key FROM rest), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS r FROM d WHERE length(key) >= 3)
      SELECT key, first(text ORDER BY NOT l, ord) AS candidate, CASE WHEN bool_or(l) THEN 'latin' ELSE 'common_only' END AS type, count(*) AS n_listings, count(DISTINCT supplier_id) AS n_suppliers, array_to_string(list(title ORDER BY ord) FILTER (WHERE r <= 3), '|') AS examples FROM k GROUP BY key""",
    "delta_recovered": f"WITH {_DELTA} SELECT ord, canonical_id, match_method, shortest <> canonical_id AS tiebreak FROM strange JOIN res USING (title) WHERE canonical_id IS NOT NULL",
    "worklist_keep": f"""WITH w AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) || ' seed' WHEN 2 THEN p_name || ' salt' WHEN 3 THEN p_name[:2] ELSE CASE WHEN p_size > 25 THEN 'egg shell' ELSE 'organic powder' END END AS key FROM part), t AS (SELECT *, string_split(key, ' ') AS t, list_filter(string_split(key, ' '), lambda x: NOT list_contains({_list((*ingest.WorkWords().descriptive, *text.DEFAULT.label_words))}, x)) AS c FROM w)
      SELECT p_partkey, key, key NOT IN ({', '.join(f"'{x}'" for x in ingest.WorkWords().dropped)}) AND NOT list_has_any(t, {_list(ingest.WorkWords().foreign)}) AND len(c) > 0 AND len(list_filter(c, lambda x: NOT list_contains({_list(ingest.WorkWords().generic)}, x))) > 0 AND length(key) > 2 AS keep FROM t""",
    "family_difference": "SELECT s_suppkey AS supplier_id, family FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS family FROM supplier) WHERE family IS NULL OR family NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)",
    "review_cost": """WITH t AS (SELECT p_name AS key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, key LIMIT 50), f AS (SELECT p_name AS key, CASE WHEN p_size > 40 THEN 'near_duplicate_latin' WHEN p_size > 30 THEN 'multi_dash_latin_not_final' ELSE 'no_latin' END AS reason FROM part WHERE p_size > 20)
      SELECT (SELECT count(*) FROM f JOIN t USING (key)) AS n_flags, (SELECT count(DISTINCT key) FROM f JOIN t USING (key) WHERE reason <> 'no_latin') / 50 AS review_rate, (SELECT count(DISTINCT key) FROM f JOIN t USING (key) WHERE reason = 'near_duplicate_latin') / 50 AS error_rate, ((SELECT count(*) FROM f JOIN t USING (key)) * 2.5 + 75.0)::DOUBLE AS minutes""",
    "ladder_observed": f"WITH {_CELLS}, seen AS (SELECT product, role, list(code) AS codes FROM fmt WHERE tier <> 'avoid' GROUP BY ALL) SELECT c.product, c.role, array_to_string(list_filter(list_concat(preferred, conditional), lambda x: list_contains(coalesce(codes, []), x)), ',') AS observed FROM cells c LEFT JOIN seen USING (product, role)",
    "storefront_graph": f"""WITH {_LONG} SELECT canonical_id, part, base || CASE WHEN overlays <> '' THEN '+' || overlays ELSE '' END AS signature, '{{"base":"' || base || '","overlays":"' || overlays || '"}}' AS payload FROM gl""",
    "alias_pools": f"""WITH {_NAUTH}, a AS (SELECT adj || ' ' || noun AS p_name, list_sort(list_distinct(list_filter([name, {_CAPN} || ' seed', {_CAPA} || ' ' || noun, 'Corrected name', noun], lambda x: x <> CASE WHEN adj <> 'old' THEN name ELSE '' END))) AS pool FROM nn)
      SELECT p_name, array_to_string(list_filter(pool, lambda x: regexp_matches(x, '^[A-Z][a-z]+(?:[- ][a-z]+)* [a-z]') AND NOT list_contains({_list(text.DEFAULT.vernacular)}, lower(split_part(x, ' ', 2)))), '|') AS scientific, array_to_string(list_filter(pool, lambda x: NOT (regexp_matches(x, '^[A-Z][a-z]+(?:[- ][a-z]+)* [a-z]') AND NOT list_contains({_list(text.DEFAULT.vernacular)}, lower(split_part(x, ' ', 2))))), '|') AS common FROM a""",
    "name_flip": f"""WITH {q.IDENTITIES}, i AS (SELECT ident.*, adj, noun, CASE WHEN noun = 'ring' THEN accepted_name || ' seed' ELSE accepted_name END AS an, CASE adj WHEN 'old' THEN 'Antiqua nova' WHEN 'new' THEN accepted_name END AS auth FROM ident JOIN names ON canonical_id = adj || '-' || noun), f AS (SELECT *, auth IS NOT NULL AND auth <> an AS flip FROM i)
      SELECT canonical_id, CASE WHEN flip THEN auth ELSE an END AS accepted_name, CASE WHEN flip THEN an END AS trade_primary_name, an AS canonical_display_name, array_to_string(CASE WHEN flip AND noun <> 'ring' THEN list_sort(list_append(scientific_synonyms, an)) ELSE scientific_synonyms END, '|') AS synonyms FROM f""",
    "authority_classes": f"""WITH {_CLASS} SELECT name, disposition, accepted, ambiguous, CASE WHEN ambiguous THEN array_to_string(targets, ',') END AS candidates, CASE WHEN disposition = 'typo' THEN canonical END AS suggested, CASE WHEN disposition = 'typo' THEN levenshtein(lower(name), lower(canonical))::INT END AS distance,
      kind || CASE WHEN back AND (own IS NOT NULL OR len(targets) > 0) THEN '+nameusage' ELSE '' END AS match_type FROM cl""",
    "authority_recheck": f"""WITH {_CLASS}, r AS (SELECT *, coalesce(kind = 'EXACT' AND status = 'ACCEPTED' AND rank IN {_RANKS} AND lower(canonical) = lower(name), false) AS sure, usage_key IS NOT NULL AND coalesce(status = 'SYNONYM', false) AS syn FROM cl),
      x AS (SELECT *, CASE WHEN sure THEN 'confirmed' WHEN syn THEN 'synonym' WHEN own IS NOT NULL THEN 'confirmed' WHEN len(targets) > 0 THEN 'synonym' ELSE 'not_found' END AS verdict FROM r)
      SELECT name, verdict AS status, CASE WHEN sure THEN canonical WHEN syn THEN coalesce(accepted_canonical, canonical) ELSE coalesce(own, CASE WHEN len(targets) = 1 THEN targets[1] END) END AS accepted,
      CASE WHEN NOT sure AND NOT syn AND own IS NULL AND len(targets) > 1 THEN array_to_string(targets, ',') END AS candidates, CASE WHEN verdict = 'not_found' AND kind IN ('FUZZY', 'HIGHERRANK') THEN canonical END AS suggested FROM x""",
    "identity_groups": f"""WITH {_CLASS}, {_DEC}, d AS (SELECT cl.*, action, CASE WHEN action = 'exclude' THEN NULL WHEN action IN ('ambiguous', 'trade_ambiguous') OR (action IS NULL AND ambiguous) THEN 'amb:' || cl.name ELSE coalesce(CASE WHEN action IN ('accept', 'genus') THEN target WHEN action = 'correct' THEN coalesce(target, cl.name || 'ta') ELSE accepted END, 'unk:' || cl.name) END AS gk,
      CASE WHEN action = 'accept' THEN 'owner-resolved' WHEN action = 'genus' THEN 'genus_level' WHEN action = 'correct' THEN 'typo-corrected' WHEN action = 'trade_ambiguous' THEN 'trade_ambiguous' WHEN action = 'ambiguous' OR ambiguous THEN 'species_ambiguous' WHEN accepted IS NULL THEN 'trade_ambiguous' WHEN disposition = 'accepted' THEN 'accepted' ELSE 'synonym-resolved' END AS st FROM cl LEFT JOIN dec USING (name)),
      g AS (SELECT *, list_position({_list(backbone.STATUS_ORDER)}, st) AS rk FROM d WHERE gk IS NOT NULL), o AS (SELECT gk, first(st ORDER BY rk, name) AS st, list_sort(list(name)) AS names, count(*) AS n, bool_or(ambiguous) AS am FROM g GROUP BY gk)
      SELECT gk AS group_key, CASE WHEN st NOT IN ('species_ambiguous', 'trade_ambiguous') THEN gk END AS accepted_name, st AS resolution_status, st IN ('species_ambiguous', 'trade_ambiguous') AS ambiguity_flag, array_to_string(names, ',') AS names, n AS n_names, CASE WHEN am THEN 'Alba altera,Alba prima' ELSE '' END AS candidates FROM o""",
    "triage_overlay": f"""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part), d AS (SELECT name, ['unresolvable', 'non_botanical', 'genus_level', 'species_ambiguous', 'common_resolved', 'resolved'][length(name) % 6 + 1] AS decision, {_CAPN} AS value FROM n WHERE adj <> 'blue' UNION ALL SELECT name, 'resolved', 'Ring sola' FROM n WHERE noun = 'ring' AND adj <> 'blue'),
      f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY list_position({_list(backbone.TRIAGE)}, decision), value) AS r FROM d) WHERE r = 1), b AS (SELECT n.name, decision, value, CASE WHEN decision IS NULL THEN 'common_name' WHEN decision = 'common_resolved' THEN 'resolved' ELSE decision END AS bucket FROM n LEFT JOIN f USING (name))
      SELECT name, bucket, CASE WHEN bucket = 'resolved' THEN value END AS accepted_name, CASE WHEN bucket IN ('genus_level', 'non_botanical') THEN value END AS identity, coalesce(decision = 'common_resolved', false) AS outside_authority FROM b""",
    "enrichment_set": f"WITH {_CLASS} SELECT accepted AS accepted_name, first(disposition ORDER BY name) AS via, array_to_string(list_sort(list(name)), ',') AS parsed_names FROM cl WHERE accepted IS NOT NULL AND disposition IN ('accepted', 'synonym') AND NOT ambiguous GROUP BY 1",
    "mapping_round": f"""WITH n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part), m AS (SELECT adj, noun, unnest([' ' || upper(p_name), p_name]) AS cn FROM n)
      SELECT CASE WHEN adj = 'hot' THEN 'Calida nova' ELSE {_CAPN} END AS accepted, array_to_string(list_sort(list(cn)), '|') AS common_names, count(*) FILTER (WHERE adj = 'hot') AS n_corrected FROM m WHERE adj <> 'old' GROUP BY 1 UNION ALL SELECT 'excluded', array_to_string(list_sort(list(cn)), '|'), 0 FROM m WHERE adj = 'old' HAVING count(*) > 0""",
    "adopted_names": f"WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part) SELECT name, CASE WHEN adj = 'cold' THEN {_CAPN} || ' frigida' ELSE {_CAPA} || ' ' || {_CAPN} END AS accepted_name, adj = 'cold' AS adopted FROM n",
    "adjudication_patches": f"""WITH {_PATCHED}, r AS (SELECT canonical_id, CASE WHEN old AND noun IN ('rod', 'bolt') THEN newname WHEN unsure THEN NULL ELSE accepted_name END AS accepted_name, old AND noun IN ('rod', 'bolt') AS renamed, * EXCLUDE (canonical_id, accepted_name), accepted_name AS was FROM i)
      SELECT canonical_id, accepted_name, CASE WHEN renamed THEN split_part(newname, ' ', 1) END AS genus, CASE WHEN renamed THEN 'antiqua' END AS species, CASE WHEN renamed THEN 'species' END AS accepted_rank, unsure AS ambiguity_flag, CASE WHEN unsure THEN 'trade_ambiguous' END AS resolution_status,
      CASE WHEN renamed THEN 'adopt' WHEN unsure THEN 'ambiguous' WHEN adj = 'cold' THEN 'keep_synonym' END AS adjudication, CASE WHEN renamed THEN 'renamed' WHEN old AND noun = 'ring' THEN 'was a ring' WHEN old THEN 'n1' END AS note, CASE WHEN old THEN '2024-01-01' END AS review_date, CASE WHEN unsure THEN 'A b' END AS candidates,
      array_to_string(list_sort(CASE WHEN renamed THEN list_append(scientific_synonyms, was) WHEN adj = 'cold' THEN list_append(scientific_synonyms, 'Frigida nova') ELSE scientific_synonyms END), '|') AS synonyms, array_to_string(list_sort(CASE WHEN old THEN list_append(list_filter(common_names, lambda x: x <> noun), 'new common') ELSE common_names END), '|') AS commons FROM r
      UNION ALL SELECT 'nova-absens', 'Nova absens', 'Nova', 'absens', 'species', false, 'owner-common-mapped', NULL, 'later', NULL, NULL, '', 'New one'""",
    "adjudication_report": f"""WITH {_PATCHED} SELECT nr + 1000000 AS place, 'add_common' AS action, upper(accepted_name) AS target, canonical_id, 'applied' AS outcome FROM i WHERE old UNION ALL SELECT nr + 2000000, 'adopt', accepted_name, canonical_id, 'applied' FROM i WHERE old AND noun IN ('rod', 'bolt')
      UNION ALL SELECT nr + 3000000, 'note', newname, canonical_id, 'applied' FROM i WHERE old AND noun IN ('rod', 'bolt') UNION ALL SELECT nr + 4000000, 'remove_common', canonical_id, canonical_id, 'applied' FROM i WHERE old UNION ALL SELECT nr + 5000000, 'ambiguous', canonical_id, canonical_id, 'applied' FROM i WHERE unsure
      UNION ALL SELECT nr + 6000000, 'note', accepted_name, canonical_id, 'applied' FROM i WHERE old AND noun = 'ring' UNION ALL SELECT nr + 7000000, 'keep_synonym', accepted_name, canonical_id, 'applied' FROM i WHERE adj = 'cold' UNION ALL SELECT 8000001, 'add_common', 'Nova absens', 'nova-absens', 'created'
      UNION ALL SELECT 9000001, 'note', 'nova ABSENS', 'nova-absens', 'applied' UNION ALL SELECT 10000001, 'note', 'Nobody', NULL, 'not_found' UNION ALL SELECT nr + 11000000, 'remove_common', canonical_id, canonical_id, 'skipped' FROM i WHERE adj = 'hot' UNION ALL SELECT nr + 12000000, 'adopt', accepted_name, canonical_id, 'skipped' FROM i WHERE canonical_id = 'cold-rod'""",
    "set_assertions": """SELECT * FROM (VALUES ('same', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0), ('subset', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0),
      ('superset', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0), ('accounts', (SELECT count(*) FILTER (WHERE s_acctbal >= 0) + count(*) FILTER (WHERE s_acctbal < 0) = count(*) FROM supplier)), ('lost', (SELECT count(*) FILTER (WHERE s_acctbal >= 0) = count(*) FROM supplier))) AS t(name, holds)""",
    "truncation_report": "SELECT count(*) AS total, array_to_string(list_sort(list(n_name))[1:5], ',') AS shown, count(*) > 5 AS truncated FROM nation",
    "sentinel_sort": f"WITH {q.IDENTITIES} SELECT canonical_id, row_number() OVER (ORDER BY CASE WHEN canonical_id LIKE 'old-%' THEN '~' || canonical_id ELSE accepted_name END) AS place FROM ident",
    "locale_sort": f"""WITH {_NAUTH}, s AS (SELECT CASE adj WHEN 'cold' THEN translate(adj || ' ' || noun, 'o', 'ö') WHEN 'large' THEN {_CAPA} || ' ' || {_CAPN} WHEN 'hot' THEN translate(adj || ' ' || noun, 'oe', 'óé') WHEN 'new' THEN upper(adj || ' ' || noun) ELSE adj || ' ' || noun END AS name FROM nn)
      SELECT name, row_number() OVER (ORDER BY name COLLATE en_US) AS place FROM s""",
    "map_references": "SELECT p_type AS type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "text_functions": rf"""WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part), w AS (SELECT *, {_CAPA} || ' ' || {_CAPN} AS cap FROM p)
      SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '[IN] ' ELSE '' END || cap || ' powder' || CASE WHEN p_size % 3 = 0 THEN ' (a) ( b )' ELSE '' END AS squeezed, CASE WHEN p_size % 2 = 0 THEN '[IN] ' ELSE '' END || cap || ' powder' AS bare, CASE WHEN p_size % 3 = 0 THEN 'b,a' ELSE '' END AS groups,
      CASE WHEN p_size % 2 = 0 THEN '[IN]' ELSE '' END AS country, cap AS common, {_CAPN} || ' ' || adj AS canonical, {_CAPN} AS genus, CASE WHEN p_size % 3 = 1 THEN 'alba' END AS infra, CASE WHEN p_size % 3 = 1 THEN 'infraspecific' ELSE 'species' END AS rank, p_size <= 25 AS scientific, 'ring' AS part FROM w""",
    "botanical_titles": f"""WITH v AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_size, {_list(text.BOTANICAL.form)} AS form, {_list(text.BOTANICAL.parts)} AS parts, {_list(text.BOTANICAL.noise)} AS noise, {_list(text.BOTANICAL.vernacular)} AS vern FROM part),
      l AS (SELECT *, upper(form[p_partkey % len(form) + 1][1]) || form[p_partkey % len(form) + 1][2:] || ' ' || p_name || ' (x y) ' || parts[p_partkey % len(parts) + 1] || ' ' || noise[p_partkey % len(noise) + 1] AS label, CASE WHEN p_size % 2 = 0 THEN vern[p_partkey % len(vern) + 1] ELSE adj END AS last FROM v),
      n AS (SELECT *, {_CAPN} || ' ' || last AS title FROM l)
      SELECT p_partkey, array_to_string({q.tokens('label', q.words(text.BOTANICAL.strip))}, ' ') AS stripped, array_to_string({q.tokens('label', q.words(text.BOTANICAL.label_words))}, ' ') AS cleaned, NOT list_contains(vern, last) AS scientific,
      title || '|' || {_CAPN} AS ngrams FROM n""",
    "caveats": f"WITH {_CELLS} SELECT s.product, s.role, CASE WHEN s.k % 5 = 0 THEN 'ambiguous_name' WHEN s.k % 5 = 1 THEN 'unknown_name' WHEN s.selected IS NULL THEN 'no_suitable_format' WHEN f.note IS NOT NULL THEN string_split(f.note, '. ')[1] || '.' ELSE 'confirm_sku' END AS caveat FROM sel s LEFT JOIN fmt f ON f.product = s.product AND f.role = s.role AND f.code = s.selected",
}
