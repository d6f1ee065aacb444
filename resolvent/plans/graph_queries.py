"""Queries of the catalogue dataflow and the backbone, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import backbone, graph
from ..session import table
from . import catalogue as c
from . import sql as q


def scan_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return c.catalogue(spark, sf).where("type <> '' and title <> ''").groupBy("type").agg(F.count("*").alias("n_rows"), F.count_distinct("title").alias("n_titles"), F.count_distinct("supplier_id").alias("n_suppliers"))


def latin_key_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.titles(spark, sf).where("latin is not null")
    g = rows.groupBy("latin").agg(F.array_sort(F.collect_set("p_type")).alias("forms"), F.array_sort(F.collect_set("title")).alias("titles"), F.count("*").alias("n_listings"))
    return g.select("latin", F.array_join("forms", ",").alias("forms"), F.size("titles").cast("long").alias("n_titles"), "n_listings")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.near_duplicates(table(spark, sf, "part").select(F.col("p_type").alias("genus"), F.lower("p_brand").alias("species")))


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    return graph.map_types(c.catalogue(spark, sf), c.type_map(spark), c.out_of_scope(spark))


def type_map_split(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf).groupBy("type", "scope").agg(F.count("*").alias("n"))


def supplier_gate(spark: SparkSession, sf: str) -> DataFrame:
    return graph.supplier_metrics(_scoped(spark, sf))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scoped(spark, sf)
    passed = graph.gate(rows, graph.supplier_metrics(rows)).where("scope = 'mapped' and canonical_id is not null")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("family"))
    return passed.join(s, "supplier_id", "left").withColumn("entity_id", F.col("supplier_id"))


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    family = F.coalesce(F.concat(F.lit("n"), F.col("family")), F.concat(F.lit("s"), F.col("entity_id")))
    return graph.form_graph(_observations(spark, sf).withColumn("_fam", family), "_fam")


def form_graph_long(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)


def corroboration_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf).groupBy("canonical_id").agg(F.max("n_entities").alias("e"), F.max("n_families").alias("f"))
    return g.agg(F.count("*").alias("n_identities"), F.count_if(F.col("e") >= 2).alias("by_entities"), F.count_if(F.col("f") >= 2).alias("by_families"))


def dedup_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    per = graph.collapse(_observations(spark, sf))
    return per.groupBy(F.col("entity_id").alias("supplier_id")).agg(F.count("*").alias("n_forms"), F.sum(F.col("n") - 1).alias("dup_collapsed"))


def nested_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = graph.nested_graph(_graph(spark, sf))
    forms = F.transform(F.map_entries("parts"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda f: F.concat(f["key"], F.lit("="), f["value"]["n_entities"], F.lit("/"), f["value"]["n_families"])), ",")))
    return n.select("canonical_id", F.array_join(F.array_sort(forms), ";").alias("forms"))


def conflict_detection(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.catalogue(spark, sf).select(F.col("type").alias("raw"), "canonical_id")
    return graph.conflicts(rows)


def format_normalise(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select("p_partkey", "p_type", F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " Standardised 20% x").when(F.col("p_size") % 5 == 1, " freeze-dried").when(F.col("p_size") % 5 == 2, " isolate").otherwise("")).alias("title"))
    j = t.join(c.type_map(spark), F.col("p_type") == F.col("map_type"), "left")
    over = F.filter(F.split(F.coalesce("overlays", F.lit("")), ","), lambda x: x != "")
    out = j.select("p_partkey", parsing.normalise_format("base", over, "title").alias("f"))
    return out.select("p_partkey", "f.base", F.array_join("f.overlays", ",").alias("overlays"), "f.method", F.array_join("f.rules", ",").alias("rules"), "f.assay")


def assay_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("p_size", F.lit(6))
    raw = F.when(k == 0, F.concat(F.col("p_size"), F.lit(":01"))).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.concat(F.lit("Solarin "), F.col("p_size"), F.lit("% by HPLC"))).when(k == 3, F.concat(F.col("p_size"), F.lit(".5 % Gr"))).when(k == 4, "0.95").otherwise("")
    a = table(spark, sf, "part").select("p_partkey", "p_name", parsing.parse_assay(raw).alias("a"))
    f = a.withColumn("f", parsing.map_format(F.col("a"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat("p_name", F.lit(" spray dried"))).otherwise(F.col("p_name")), F.lit("RE")))
    return f.select("p_partkey", "a.ratio", "a.percent", "a.method", "a.marker", "f.base", F.array_join("f.overlays", ",").alias("overlays"))


def ocr_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Names in joined case, glued ones (long, short, with a digit, with a genus of two letters) and whole ones."""
    k = F.pmod("p_partkey", F.lit(6))
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ")[0].alias("adj"), F.split("p_name", " ")[1].alias("noun"))
    glued = F.when(k == 0, F.concat(F.initcap("adj"), F.initcap("noun"))).when(k == 1, F.concat(F.initcap("adj"), "noun")).when(k == 2, F.concat(F.initcap("adj"), F.lit("1"), "noun", "noun")).when(k == 3, F.concat(F.lit("Io"), "adj", "noun")).when(k == 4, F.concat(F.lit(" "), F.initcap("adj"), F.lit("  "), "noun")).otherwise(F.concat(F.initcap("adj"), "noun", "noun"))
    genera = p.select(F.initcap("adj").alias("genus")).unionByName(p.select(F.lit("Io").alias("genus"))).unionByName(p.where("adj = 'cold'").select(F.concat(F.initcap("adj"), "noun").alias("genus"))).distinct()
    return parsing.repair_names(p.select("p_partkey", glued.alias("name")), genera)


def backbone_merge(spark: SparkSession, sf: str) -> DataFrame:
    edges = spark.createDataFrame([("blue-rod", "cold-rod", False), ("cold-rod", "hot-rod", False), ("red-bolt", "hot-bolt", False), ("no-such", "hot-bolt", False), ("red-gear", "hot-gear", True)], "absorb_id string, keep_id string, drop_name boolean")
    m = backbone.merge_records(c.identities(spark, sf), edges)
    return m.select("canonical_id", "accepted_name", "n_absorbed", F.array_join("scientific_synonyms", ",").alias("synonyms"), F.size("common_names").cast("long").alias("n_commons"))


def converged_dedup(spark: SparkSession, sf: str) -> DataFrame:
    i = c.identities(spark, sf).withColumn("accepted_name", F.split("accepted_name", " ")[0])
    m = backbone.merge_converged(i, spark.createDataFrame([("red-gear",)], "canonical_id string"))
    return m.select("canonical_id", "accepted_name", "n_absorbed", F.size("common_names").cast("long").alias("n_commons"))


def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    """Merges of every third noun's records into the next one's, some of which are missing."""
    i = c.identities(spark, sf)
    e = i.where("canonical_id like 'blue-%'").select(F.col("canonical_id").alias("absorb_id"), F.replace("canonical_id", F.lit("blue"), F.when(F.length("canonical_id") % 2 == 0, "no").otherwise("hot")).alias("keep_id"))
    return backbone.merge_report(i, e.unionByName(e.select(F.concat(F.lit("x"), "absorb_id").alias("absorb_id"), "keep_id")))


def backbone_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the shape of a name, taken as discovered names: some are known, others have the slug of a record or of each other."""
    name = F.when(F.col("p_size") > 25, F.replace(F.initcap("p_name"), F.lit(" "), F.lit("-"))).when(F.col("p_size") > 5, F.initcap("p_name")).otherwise(F.col("title"))
    d = c.titles(spark, sf).where(F.col("title").rlike("^[A-Z][a-z]+ [a-z]+$")).select(name.alias("accepted_name"), F.array("title").alias("parsed_names"), F.array("p_type").alias("common_names"))
    u = backbone.upsert(c.identities(spark, sf), d)
    return u.select("canonical_id", "accepted_name", "inserted", "n_added", "n_parsed", F.array_join("scientific_synonyms", "|").alias("synonyms"), F.size("common_names").cast("long").alias("n_commons"))


def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select(F.concat(F.col("p_name"), F.when(F.col("p_size") > 40, F.lit(" subsp. f. × forma")).when(F.col("p_size") > 25, F.lit("!")).otherwise("")).alias("group_key")).distinct()
    return backbone.with_ids(n)


def delta_examples(spark: SparkSession, sf: str) -> DataFrame:
    return graph.first_examples(c.titles(spark, sf).select("p_brand", "p_partkey", "title"), "p_brand", "p_partkey", "title").select("p_brand", F.array_join("examples", "|").alias("examples"))


def delta_type_promotion(spark: SparkSession, sf: str) -> DataFrame:
    r = c.titles(spark, sf).select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("ord"), (F.col("latin").isNotNull() & (F.col("p_size") > 45)).alias("is_latin"), F.coalesce(F.when(F.col("p_size") > 45, F.col("latin")), F.col("title")).alias("text"))
    return graph.promote_types(r)


def topk_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_cohort(c.catalogue(spark, sf).groupBy(F.col("title").alias("key")).agg(F.count("*").alias("n")), 50)


def percentile_stat(spark: SparkSession, sf: str) -> DataFrame:
    return graph.percentile_floor(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", {"median": 0.5, "p95": 0.95})


QUERIES = {f.__name__: f for f in (scan_catalogue, latin_key_groups, near_duplicates, type_map_split, supplier_gate, form_graph_long, corroboration_two_levels, dedup_collapsed, nested_graph, conflict_detection, format_normalise, assay_parse, ocr_repair, backbone_merge, converged_dedup, merge_report, backbone_upsert, slug_ids, delta_examples, delta_type_promotion, topk_cohort, percentile_stat)}

_OBS = f"{q.CATALOGUE}, obs AS (SELECT g.*, supplier_id AS entity_id, coalesce('n' || s_nationkey, 's' || supplier_id) AS fam FROM gated g LEFT JOIN supplier ON s_suppkey = supplier_id)"
_LONG = f"{_OBS}, gl AS (SELECT canonical_id, part, base, overlays, count(*) AS n_observations, count(DISTINCT entity_id) AS n_entities, count(DISTINCT fam) AS n_families FROM obs GROUP BY ALL)"
_RAW = "CASE p_size % 6 WHEN 0 THEN p_size || ':01' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN 'Solarin ' || p_size || '% by HPLC' WHEN 3 THEN p_size || '.5 % Gr' WHEN 4 THEN '0.95' ELSE '' END"
ORACLE_SQL = {
    "scan_catalogue": f"WITH {q.CATALOGUE} SELECT type, count(*) AS n_rows, count(DISTINCT title) AS n_titles, count(DISTINCT supplier_id) AS n_suppliers FROM cat GROUP BY type",
    "latin_key_groups": f"WITH {q.TITLES} SELECT latin, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS forms, count(DISTINCT title) AS n_titles, count(*) AS n_listings FROM titled WHERE latin IS NOT NULL GROUP BY latin",
    "near_duplicates": "WITH k AS (SELECT DISTINCT p_type AS genus, lower(p_brand) AS species FROM part) SELECT x.genus, x.species AS a, y.species AS b FROM k x JOIN k y ON x.genus = y.genus AND x.species < y.species AND levenshtein(x.species, y.species) <= 1",
    "type_map_split": f"WITH {q.CATALOGUE} SELECT type, scope, count(*) AS n FROM scoped GROUP BY ALL",
    "supplier_gate": f"WITH {q.CATALOGUE} SELECT * FROM metrics",
    "form_graph_long": f"WITH {_LONG} SELECT * FROM gl",
    "corroboration_two_levels": f"WITH {_LONG} SELECT count(*) AS n_identities, count(*) FILTER (WHERE e >= 2) AS by_entities, count(*) FILTER (WHERE f >= 2) AS by_families FROM (SELECT canonical_id, max(n_entities) AS e, max(n_families) AS f FROM gl GROUP BY 1)",
    "dedup_collapsed": f"WITH {_OBS} SELECT entity_id AS supplier_id, count(*) AS n_forms, sum(n - 1)::BIGINT AS dup_collapsed FROM (SELECT entity_id, canonical_id, part, base, overlays, count(*) AS n FROM obs GROUP BY ALL) GROUP BY 1",
    "nested_graph": f"WITH {_LONG}, f AS (SELECT canonical_id, part, base || CASE WHEN overlays <> '' THEN '+' || overlays ELSE '' END AS sig, n_entities, n_families FROM gl), p AS (SELECT canonical_id, part || ':' || string_agg(sig || '=' || n_entities || '/' || n_families, ',' ORDER BY sig) AS s FROM f GROUP BY canonical_id, part) SELECT canonical_id, string_agg(s, ';' ORDER BY s) AS forms FROM p GROUP BY 1",
    "conflict_detection": f"WITH {q.CATALOGUE} SELECT type AS raw, count(DISTINCT canonical_id) AS n_ids FROM cat WHERE canonical_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_id) > 1",
    "format_normalise": f"""WITH {q.TYPES}, t AS (SELECT p_partkey, base, overlays, CASE p_size % 5 WHEN 0 THEN 's' WHEN 1 THEN 'f' WHEN 2 THEN 'i' ELSE '' END AS k FROM part LEFT JOIN tmap ON p_type = map_type)
      SELECT p_partkey, CASE WHEN k = 'f' AND base IN ('MP', 'WD') THEN 'FD' ELSE base END AS base, CASE WHEN base IS NULL THEN NULL WHEN k = 's' OR overlays = 'SE' THEN 'SE' ELSE '' END AS overlays,
      CASE WHEN base IS NULL THEN NULL WHEN k = 'f' AND base IN ('MP', 'WD') THEN 'type_map_plus_title_overlay' WHEN k = 'i' OR k = 'f' THEN 'manual_review' WHEN k = 's' AND overlays <> 'SE' THEN 'type_map_plus_title_overlay' ELSE 'type_map' END AS method,
      CASE WHEN base IS NULL THEN NULL WHEN k = 's' AND overlays <> 'SE' THEN 'TITLE-SE' WHEN k = 'i' THEN 'TITLE-IC' WHEN k = 'f' AND base IN ('MP', 'WD') THEN 'TITLE-FD-TURN' WHEN k = 'f' THEN 'TITLE-FD-KEEP' ELSE '' END AS rules, CASE WHEN base IS NOT NULL AND k = 's' THEN '20%' END AS assay FROM t""",
    "assay_parse": f"""WITH r AS (SELECT p_partkey, p_name, p_size, {_RAW} AS raw FROM part)
      SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size || ':1' WHEN 1 THEN p_size || ':1' END AS ratio, CASE p_size % 6 WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN p_size + 0.5::DOUBLE WHEN 4 THEN 95.0::DOUBLE END AS percent,
      CASE p_size % 6 WHEN 2 THEN 'HPLC' WHEN 3 THEN 'Gravimetric' END AS method, CASE p_size % 6 WHEN 2 THEN 'HPLC Solarin' WHEN 3 THEN 'Gr' END AS marker, CASE WHEN p_partkey % 3 = 0 THEN 'SD' ELSE 'RE' END AS base, CASE WHEN p_size % 6 IN (2, 3) THEN 'SE' ELSE '' END AS overlays FROM r""",
    "ocr_repair": r"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS n, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] AS a FROM part),
      g AS (SELECT DISTINCT a AS genus FROM p UNION SELECT 'Io' UNION SELECT a || n FROM p WHERE adj = 'cold'), nm AS (SELECT p_partkey, CASE k WHEN 0 THEN a || upper(n[1]) || n[2:] WHEN 1 THEN a || n WHEN 2 THEN a || '1' || n || n WHEN 3 THEN 'Io' || adj || n WHEN 4 THEN ' ' || a || '  ' || n ELSE a || n || n END AS name FROM p),
      sp AS (SELECT p_partkey, name, trim(regexp_replace(name, ' +', ' ', 'g')) AS sq FROM nm), cs AS (SELECT *, regexp_replace(sq, '([a-z])([A-Z])', '\1 \2', 'g') AS c FROM sp),
      best AS (SELECT p_partkey, max_by(genus, length(genus)) AS genus FROM cs JOIN g ON starts_with(lower(c), lower(genus)) AND length(c) - length(genus) >= 3 WHERE regexp_full_match(c, '[A-Za-z]{9,}') GROUP BY 1)
      SELECT p_partkey, name, CASE WHEN genus IS NOT NULL THEN genus || ' ' || lower(c[length(genus) + 1:]) ELSE c END AS repaired, CASE WHEN genus IS NOT NULL THEN 'glued_genus_split' WHEN c <> sq THEN 'case_boundary_split' ELSE 'none' END AS repair FROM cs LEFT JOIN best USING (p_partkey)""",
    "backbone_merge": f"""WITH {q.IDENTITIES}, moved AS (SELECT *, CASE WHEN canonical_id IN ('blue-rod', 'cold-rod') THEN 'hot-rod' WHEN canonical_id = 'red-bolt' THEN 'hot-bolt' WHEN canonical_id = 'red-gear' THEN 'hot-gear' ELSE canonical_id END AS dest FROM ident),
      syn AS (SELECT dest, unnest(CASE WHEN dest <> canonical_id AND canonical_id <> 'red-gear' THEN list_append(scientific_synonyms, accepted_name) ELSE scientific_synonyms END) AS s FROM moved), keep AS (SELECT canonical_id AS dest, accepted_name FROM moved WHERE dest = canonical_id)
      SELECT m.dest AS canonical_id, k.accepted_name, count(*) - 1 AS n_absorbed, (SELECT array_to_string(list_sort(list_distinct(list(s))), ',') FROM syn WHERE syn.dest = m.dest) AS synonyms, len(list_distinct(flatten(list(common_names)))) AS n_commons FROM moved m JOIN keep k ON m.dest = k.dest GROUP BY m.dest, k.accepted_name""",
    "converged_dedup": f"WITH {q.IDENTITIES}, i AS (SELECT *, split_part(accepted_name, ' ', 1) AS an FROM ident) SELECT CASE WHEN an = 'Gear' THEN 'red-gear' ELSE min(canonical_id) END AS canonical_id, an AS accepted_name, count(*) - 1 AS n_absorbed, len(list_distinct(flatten(list(common_names)))) AS n_commons FROM i GROUP BY an",
    "merge_report": f"""WITH {q.IDENTITIES}, e AS (SELECT canonical_id AS a, replace(canonical_id, 'blue', CASE WHEN length(canonical_id) % 2 = 0 THEN 'no' ELSE 'hot' END) AS k FROM ident WHERE canonical_id LIKE 'blue-%'), x AS (SELECT a, k FROM e UNION ALL SELECT 'x' || a, k FROM e)
      SELECT a AS absorb_id, k AS keep_id, i.accepted_name AS absorbed_name, j.accepted_name AS kept_name, CASE WHEN i.canonical_id IS NOT NULL AND j.canonical_id IS NOT NULL THEN 'merged' ELSE 'skipped' END AS status FROM x LEFT JOIN ident i ON a = i.canonical_id LEFT JOIN ident j ON k = j.canonical_id""",
    "backbone_upsert": f"""WITH {q.IDENTITIES}, {q.TITLES}, up AS (SELECT *, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS u1, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS u2 FROM titled WHERE regexp_full_match(title, '[A-Z][a-z]+ [a-z]+')),
      d AS (SELECT CASE WHEN p_size > 25 THEN u1 || '-' || u2 WHEN p_size > 5 THEN u1 || ' ' || u2 ELSE title END AS an, title, p_type FROM up), g AS (SELECT lower(an) AS k, min(an) AS an, list_distinct(list(p_type)) AS c, list_distinct(list(title)) AS p FROM d GROUP BY 1),
      j AS (SELECT canonical_id, coalesce(accepted_name, an) AS an, canonical_id IS NULL AS inserted, coalesce(c, []) AS c, list_filter(coalesce(p, []), lambda x: NOT list_contains(coalesce(original_parsed_names, []), x)) AS p, coalesce(scientific_synonyms, []) AS s, coalesce(common_names, []) AS cn FROM ident FULL JOIN g ON lower(accepted_name) = k),
      b AS (SELECT *, trim(regexp_replace(lower(an), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY inserted, base ORDER BY an) + (base IN (SELECT canonical_id FROM ident))::INT AS r FROM b)
      SELECT CASE WHEN NOT inserted THEN canonical_id WHEN r = 1 THEN base ELSE base || '-' || r END AS canonical_id, an AS accepted_name, inserted, len(list_filter(c, lambda x: NOT list_contains(cn, x))) AS n_added, len(p) AS n_parsed,
      array_to_string(list_sort(list_distinct(list_concat(s, list_filter(p, lambda x: x <> an AND NOT list_contains([{', '.join(f"'{w}'" for w in text.DEFAULT.vernacular)}], split_part(x, ' ', 2)))))), '|') AS synonyms, len(list_distinct(list_concat(cn, c))) AS n_commons FROM n""",
    "slug_ids": "WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_size > 40 THEN ' subsp. f. × forma' WHEN p_size > 25 THEN '!' ELSE '' END AS group_key FROM part), s AS (SELECT group_key, trim(regexp_replace(regexp_replace(replace(lower(group_key), '×', 'x-'), '\\b(var|subsp|ssp|f|cv|forma)\\.?\\b', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY group_key) AS r FROM s) SELECT group_key, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS canonical_id FROM k",
    "delta_examples": f"WITH {q.TITLES} SELECT p_brand, array_to_string(list(title ORDER BY p_partkey), '|') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM titled) WHERE k <= 3 GROUP BY p_brand",
    "delta_type_promotion": f"WITH {q.TITLES}, r AS (SELECT p_brand AS key, p_partkey AS ord, latin IS NOT NULL AND p_size > 45 AS l, CASE WHEN latin IS NOT NULL AND p_size > 45 THEN latin ELSE title END AS text FROM titled) SELECT key, CASE WHEN bool_or(l) THEN 'latin' ELSE 'common_only' END AS kind, first(text ORDER BY NOT l, ord) AS text, count(*) AS n FROM r GROUP BY key",
    "topk_cohort": f"WITH {q.CATALOGUE} SELECT title AS key, count(*) AS n FROM cat GROUP BY 1 ORDER BY n DESC, key LIMIT 50",
    "percentile_stat": "WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(n) AS n, max(v) FILTER (WHERE k = least(n, floor(n * 0.5) + 1)) AS median, max(v) FILTER (WHERE k = least(n, floor(n * 0.95) + 1)) AS p95 FROM r GROUP BY 1",
}
