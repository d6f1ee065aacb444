"""Queries of the audits, over records with planted faults, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from . import catalogue as c
from . import sql as q


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


def audit_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counted(audit.taxonomy_problems(c.records(spark, sf)), audit.TAXONOMY_CHECKS, shown=3).select("check", "total", _joined("shown"), "truncated")


def audit_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counted(audit.provenance_problems(c.records(spark, sf)), audit.PROVENANCE_CHECKS, shown=2).select("check", "total", _joined("shown"), "truncated")


def audit_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    odd = lambda k, x: F.when(F.col("canonical_id") == k, F.array(F.lit(x)))
    i = c.identities(spark, sf).withColumn("trade_synonyms", F.coalesce(odd("old-bolt", "Café  rod"), odd("old-rod", "Café  rod"), F.col("trade_synonyms")))
    i = i.withColumn("scientific_synonyms", F.coalesce(odd("old-ring", "Rod alba (L.)"), odd("old-gear", "Gear alba Mill."), F.col("scientific_synonyms")))
    return audit.normalisation_audit(i.withColumn("common_names", F.coalesce(odd("old-anvil", "a\u202fb"), odd("old-plate", "a\u00a0b"), F.col("common_names"))))


def audit_resolver_self(spark: SparkSession, sf: str) -> DataFrame:
    return audit.resolver_self_test(c.identities(spark, sf), *c.indices(spark, sf))


def _versions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    meta = spark.createDataFrame([("v3", 1, None, "2024-01-01", 64, 3)], "identity_version string, identity_schema_version int, initial_backbone_created string, generated_at string, identity_records long, excluded long")
    return meta, spark.createDataFrame([("v2",)], "identity_version string")


def audit_schema(spark: SparkSession, sf: str) -> DataFrame:
    meta, quarantine = _versions(spark)
    excluded = spark.createDataFrame([("Blue rod",), ("salt",), ("old bolt",), (" ",)], "parsed_name string")
    keys = c.names(spark, sf).select(F.initcap("p_name").alias("key")).unionByName(spark.createDataFrame([("Salt",), ("lost key",)], "key string"))
    return audit.schema_problems(c.records(spark, sf), meta, excluded, keys, quarantine)


def audit_orphans(spark: SparkSession, sf: str) -> DataFrame:
    i = c.identities(spark, sf)
    g = i.select("canonical_id").unionByName(i.where("canonical_id like 'hot-%'").select(F.concat("canonical_id", F.lit("-x")).alias("canonical_id")))
    return audit.schema_audit(i.withColumn("common_names", F.when(F.col("canonical_id").endswith("-ring"), F.array().cast("array<string>")).otherwise(F.col("common_names"))), g)


def coverage_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return audit.sibling_coverage(c.identities(spark, sf))


def coverage_merged_species(spark: SparkSession, sf: str) -> DataFrame:
    return audit.merged_species(c.records(spark, sf).distinct()).select("canonical_id", "n_absorbed", _joined("species"))


def coverage_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    i, (exact, common) = c.identities(spark, sf), c.indices(spark, sf)
    commons = c.titles(spark, sf).select(F.concat(F.lit("Fancy "), "title").alias("name"), F.col("p_name").alias("source"))
    excluded = c.names(spark, sf).where("adj in ('old', 'new')").select(F.upper("p_name").alias("parsed_name"))
    return audit.unresolved_commons(commons, excluded, exact, common)


def coverage_thin(spark: SparkSession, sf: str) -> DataFrame:
    i = c.records(spark, sf).distinct()
    few = F.when(F.col("canonical_id").like("%-widget"), F.slice("common_names", 1, 1)).otherwise(F.col("common_names"))
    return audit.thin_names(i.withColumn("common_names", few))


def coverage_seeds(spark: SparkSession, sf: str) -> DataFrame:
    n = c.names(spark, sf)
    seeds = n.select(F.concat(F.initcap("noun"), F.lit(" "), "adj").alias("species")).unionByName(n.select(F.concat(F.initcap("noun"), F.lit("us "), "adj", F.lit(" var. x")).alias("species"))).unionByName(n.select(F.concat(F.lit("Nulla "), "adj").alias("species")))
    return audit.seed_presence(c.records(spark, sf), seeds).select("species", "presence", _joined("canonical_ids"))


def corpus_regression(spark: SparkSession, sf: str) -> DataFrame:
    i, (exact, common) = c.identities(spark, sf), c.indices(spark, sf)
    noun = F.split("canonical_id", "-")[1]
    status = F.element_at(F.create_map(*[F.lit(x) for kv in CORPUS_STATUS.items() for x in kv]), noun)
    identity = F.when(noun == "rod", "blue-rod").when(noun == "ring", F.upper("accepted_name")).when(noun == "bolt", F.col("canonical_id"))
    full = i.select(F.col("accepted_name").alias("query"), status.alias("expected_status"), identity.alias("expected_identity"))
    nouns = i.select(noun.alias("query"), F.lit("ambiguous").alias("expected_status"), F.lit(None).cast("string").alias("expected_identity")).distinct()
    fixed = spark.createDataFrame(CORPUS_ROWS, "query string, expected_status string, expected_identity string")
    known = i.withColumn("resolution_status", F.when(F.col("canonical_id") == "hot-widget", "genus_level").otherwise("accepted"))
    return audit.corpus_regression(full.unionByName(nouns).unionByName(fixed), known, exact, common)


CORPUS_STATUS = {"bolt": "resolved", "ring": "resolved", "rod": "resolved", "plate": "policy_dependent", "anvil": "missing_species", "widget": "genus_level", "gizmo": "odd", "gear": "ambiguous"}
CORPUS_ROWS = [(None, "resolved", None), ("zzz", "unrecognised", None), ("zzz zzz", "missing_species", None), ("yyy", "resolved", None)]


def form_key_of(spark: SparkSession, sf: str) -> DataFrame:
    """Species keys, genera and binomial shapes of every name of the records."""
    from ..functions import text

    r = c.records(spark, sf).distinct()
    names = r.select("canonical_id", F.explode(F.array_compact(F.concat(F.array("accepted_name"), "scientific_synonyms", "original_parsed_names"))).alias("name"))
    kept = audit.species_of(names, audit.valid_genera(r)).select("canonical_id", "name").withColumn("species", F.lit(True))
    out = names.join(kept, ["canonical_id", "name"], "left")
    return out.select("canonical_id", "name", text.species_key("name").alias("key"), text.genus_token("name").alias("genus"), text.is_binomial("name").alias("binomial"), F.coalesce("species", F.lit(False)).alias("species"))


QUERIES = {f.__name__: f for f in (audit_taxonomy, audit_provenance, audit_normalisation, audit_resolver_self, audit_schema, audit_orphans, coverage_siblings, coverage_merged_species, coverage_unresolved, coverage_thin, coverage_seeds, corpus_regression, form_key_of)}

_FORMED = r"'[A-Z][a-zA-Z-]+(\s+([×x]|×?[a-z][a-zà-ÿ-]*))*'"
_AMB = "coalesce(resolution_status LIKE '%\\_ambiguous' ESCAPE '\\', false)"
_FIRST = r"regexp_replace(split_part(trim(regexp_replace(regexp_replace(coalesce(accepted_name, ''), '\s×\s?', ' ', 'g'), '^×', '')), ' ', 1), '^×', '')"


def _counted(source: str, checks: tuple[str, ...], shown: int) -> str:
    """One row per check from ``p(check_, canonical_id)``."""
    return f"""SELECT n.check_ AS "check", count(p.check_) AS total, coalesce(array_to_string(list_sort(list(p.canonical_id ORDER BY p.canonical_id) FILTER (WHERE p.check_ IS NOT NULL))[1:{shown}], ','), '') AS shown, count(p.check_) > {shown} AS truncated
      FROM (VALUES {', '.join(f"('{x}')" for x in checks)}) AS n(check_) LEFT JOIN ({source}) p USING (check_) GROUP BY 1"""


_RANKS = ", ".join(f"'{r}'" for r in audit.RANKS)
_TAXONOMY = f"""SELECT 'malformed_accepted_name' AS check_, canonical_id FROM rec WHERE CASE WHEN {_AMB} THEN accepted_name IS NOT NULL ELSE NOT coalesce(regexp_full_match(trim(accepted_name), {_FORMED}), false) END
  UNION ALL SELECT 'accepted_vs_authority_mismatch', canonical_id FROM rec WHERE accepted_name IS DISTINCT FROM authority_accepted_name
  UNION ALL SELECT 'rank_field_inconsistency', canonical_id FROM rec WHERE NOT {_AMB} AND accepted_rank NOT IN ({_RANKS})
  UNION ALL SELECT 'rank_field_inconsistency', canonical_id FROM rec WHERE NOT {_AMB} AND genus <> {_FIRST} AND {_FIRST} <> ''
  UNION ALL SELECT 'rank_field_inconsistency', canonical_id FROM rec WHERE NOT {_AMB} AND accepted_rank = 'SPECIES' AND infra IS NOT NULL
  UNION ALL SELECT 'rank_field_inconsistency', canonical_id FROM rec WHERE NOT {_AMB} AND accepted_rank IN ('SUBSPECIES', 'VARIETY', 'FORM') AND infra IS NULL
  UNION ALL SELECT 'missing_genus_species', canonical_id FROM rec WHERE NOT {_AMB} AND accepted_rank IS DISTINCT FROM 'GENUS' AND (genus IS NULL OR species IS NULL)
  UNION ALL SELECT 'malformed_synonym', canonical_id FROM (SELECT canonical_id, unnest(scientific_synonyms) AS s FROM rec) WHERE NOT regexp_full_match(trim(s), {_FORMED})
  UNION ALL SELECT 'converged_accepted_name_duplicates', min(canonical_id) FROM rec WHERE authority_accepted_name IS NOT NULL GROUP BY authority_accepted_name HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_canonical_id', canonical_id FROM rec GROUP BY canonical_id HAVING count(*) > 1"""
_PROV = """prov AS (SELECT canonical_id, CASE WHEN json_valid(provenance) AND json_type(provenance) = 'OBJECT' THEN provenance::JSON END AS p FROM rec),
pv AS (SELECT *, json_type(p, '$.enriched_by') AS kind, coalesce(json_array_length(p, '$.enriched_by'), 0) AS k, coalesce(p->>'$.authority', '') <> '' AS au, coalesce(p->>'$.resolved_by', '') AS rb, coalesce(p->>'$.query_date', '') <> '' AS qd, coalesce(p->>'$.review_date', '') <> '' AS rv, p->>'$.recheck' AS rc FROM prov)"""
_PROVENANCE = """SELECT 'records_without_provenance' AS check_, canonical_id FROM pv WHERE p IS NULL
  UNION ALL SELECT 'enriched_by_not_array', canonical_id FROM pv WHERE p IS NOT NULL AND kind IS NOT NULL AND kind <> 'ARRAY'
  UNION ALL SELECT 'records_untraceable_to_source', canonical_id FROM pv WHERE p IS NOT NULL AND NOT (au OR rb <> '' OR k > 0)
  UNION ALL SELECT 'accepted_outside_missing_stamp', canonical_id FROM pv WHERE p->>'$.accepted_outside_authority' = 'true' AND NOT ((qd OR rv OR p->>'$.recheck.query_date' IS NOT NULL) AND (rv OR (rb <> '' AND lower(rb) <> 'authority') OR rc IS NOT NULL))"""
_SELF = f"""{q.INDEX}, uniq AS (SELECT {q.norm('v')} AS key, count(DISTINCT canonical_id) AS n_ids, min(canonical_id) AS cid FROM com GROUP BY 1),
probes AS (SELECT 'accepted_name_exact' AS path, accepted_name AS input, canonical_id AS expected FROM ident UNION ALL SELECT 'scientific_synonym_exact', unnest(scientific_synonyms), canonical_id FROM ident
  UNION ALL SELECT 'common_name_unique_no_strip_override', key, cid FROM uniq WHERE n_ids = 1 AND key <> '' UNION ALL SELECT 'ambiguous_never_picks_outside', key, NULL FROM common WHERE len(cids) > 1
  UNION ALL SELECT 'unrecognised', g, NULL FROM (VALUES {', '.join(f"('{g}')" for g in audit.GIBBERISH)}) AS x(g) UNION ALL SELECT 'part_and_format_stripped', key || x.s, cid FROM uniq, (VALUES {', '.join(f"('{s}')" for s in audit.SUFFIXES)}) AS x(s) WHERE n_ids = 1 AND key <> ''
  UNION ALL SELECT 'case_whitespace_normalisation', unnest([upper(accepted_name), lower(accepted_name), '  ' || accepted_name || '  ', replace(accepted_name, ' ', '  ')]), canonical_id FROM ident
  UNION ALL SELECT 'no_substring_or_fuzzy_match', unnest([split_part(accepted_name, ' ', 1), accepted_name[:greatest(5, length(accepted_name) // 2)], accepted_name[:length(accepted_name) - 1] || CASE WHEN accepted_name LIKE '%a' THEN 'x' ELSE 'a' END]), canonical_id FROM ident),
lab AS (SELECT NULL::VARCHAR AS latin, input AS label FROM probes), {q.hits('lab', 'latin, label', q.serving_cands(True))},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS r FROM hit) WHERE r = 1),
res AS (SELECT p.*, {q.norm('input')} AS k, h.key AS matched, CASE WHEN method IS NOT NULL THEN canonical_id WHEN n_ids = 1 THEN cids[1] END AS cid, CASE WHEN method IS NULL AND n_ids IS NULL THEN 'unresolved' WHEN method IS NULL AND n_ids > 1 THEN 'ambiguous' ELSE 'resolved' END AS st FROM probes p LEFT JOIN pick h ON h.label = p.input),
ev AS (SELECT *, CASE WHEN path IN ('accepted_name_exact', 'case_whitespace_normalisation') THEN cid IS NOT DISTINCT FROM expected WHEN path = 'scientific_synonym_exact' THEN cid IS NOT DISTINCT FROM expected OR st = 'ambiguous'
  WHEN path = 'common_name_unique_no_strip_override' THEN cid IS NOT DISTINCT FROM expected OR st <> 'resolved' OR matched = k WHEN path = 'ambiguous_never_picks_outside' THEN st <> 'resolved' OR list_contains((SELECT cids FROM common WHERE common.key = res.k), cid)
  WHEN path = 'unrecognised' THEN st = 'unresolved' WHEN path = 'part_and_format_stripped' THEN st <> 'unresolved' ELSE st <> 'resolved' OR EXISTS (SELECT 1 FROM exact e WHERE e.key = res.k) OR EXISTS (SELECT 1 FROM common m WHERE m.key = res.k AND len(m.cids) = 1) END AS ok FROM res)"""
_CORPUS = f"""{q.INDEX}, corpus AS (SELECT accepted_name AS query, CASE split_part(canonical_id, '-', 2) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CORPUS_STATUS.items())} END AS want, CASE split_part(canonical_id, '-', 2) WHEN 'rod' THEN 'blue-rod' WHEN 'ring' THEN upper(accepted_name) WHEN 'bolt' THEN canonical_id END AS who FROM ident
  UNION ALL SELECT DISTINCT noun, 'ambiguous', NULL FROM names UNION ALL SELECT * FROM (VALUES {', '.join(f"({q.quoted(a)}, {q.quoted(b)}, {q.quoted(d)})" for a, b, d in CORPUS_ROWS)})),
lab AS (SELECT NULL::VARCHAR AS latin, query AS label FROM corpus), {q.hits('lab', 'latin, label', q.serving_cands(True))},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS r FROM hit) WHERE r = 1),
res AS (SELECT c.*, CASE WHEN method IS NOT NULL THEN canonical_id WHEN n_ids = 1 THEN cids[1] END AS canonical_id, n_ids FROM corpus c LEFT JOIN pick h ON h.label = c.query),
st AS (SELECT r.*, CASE WHEN r.canonical_id IS NOT NULL THEN 'resolved' WHEN n_ids > 1 THEN 'ambiguous' ELSE 'unrecognised' END AS status, i.accepted_name FROM res r LEFT JOIN ident i USING (canonical_id))"""
_SERVE = """pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS r FROM hit) WHERE r = 1)"""
_NAMES_OF = "(SELECT DISTINCT canonical_id, accepted_name, unnest(list_concat(original_parsed_names, scientific_synonyms)) AS name FROM rec)"


def _spkey(x: str) -> str:
    return f"array_to_string(string_split({q.norm(f'''regexp_replace(regexp_replace({x}, '^×', ''), '{chr(92)}s×{chr(92)}s?', ' ', 'g')''')}, ' ')[1:2], ' ')"


def _genus(x: str) -> str:
    return q.norm(f"regexp_split_to_array(trim({x}), '[ ×]')[1]")


_GENERA = f"genera AS (SELECT DISTINCT g FROM (SELECT {_genus('accepted_name')} AS g FROM rec WHERE accepted_name IS NOT NULL UNION ALL SELECT {q.norm('genus')} FROM rec WHERE genus IS NOT NULL) WHERE g <> '')"
_SPECIES = rf"regexp_matches(trim(name), '^[A-Z][a-z]+[ ×]') AND coalesce(regexp_full_match(string_split({q.norm('name')}, ' ')[2], '[a-z][a-zà-ÿ-]{{2,}}'), false) AND {_genus('name')} IN (SELECT g FROM genera)"
ORACLE_SQL = {
    "audit_taxonomy": f"WITH {q.RECORDS} {_counted(_TAXONOMY, audit.TAXONOMY_CHECKS, 3)}",
    "audit_provenance": f"WITH {q.RECORDS}, {_PROV} {_counted(_PROVENANCE, audit.PROVENANCE_CHECKS, 2)}",
    "audit_normalisation": rf"""WITH {q.IDENTITIES}, n AS (SELECT canonical_id, 'accepted_name' AS kind, accepted_name AS name FROM ident UNION ALL SELECT canonical_id, 'original_parsed_names', unnest(original_parsed_names) FROM ident UNION ALL SELECT canonical_id, 'scientific_synonyms', unnest(CASE canonical_id WHEN 'old-ring' THEN ['Rod alba (L.)'] WHEN 'old-gear' THEN ['Gear alba Mill.'] ELSE scientific_synonyms END) FROM ident
      UNION ALL SELECT canonical_id, 'trade_synonyms', unnest(CASE WHEN canonical_id IN ('old-bolt', 'old-rod') THEN ['Café  rod'] ELSE trade_synonyms END) FROM ident UNION ALL SELECT canonical_id, 'common_names', unnest(CASE canonical_id WHEN 'old-anvil' THEN ['a' || chr(8239) || 'b'] WHEN 'old-plate' THEN ['a' || chr(160) || 'b'] ELSE common_names END) FROM ident), s AS (SELECT kind, {q.norm('name')} AS key, count(DISTINCT canonical_id) AS c FROM n GROUP BY ALL HAVING count(DISTINCT canonical_id) > 1)
      SELECT kind, count(*) AS n_names, count(*) FILTER (WHERE contains(name, chr(160)) OR contains(name, chr(8239))) AS n_nbsp, count(*) FILTER (WHERE name LIKE '%  %' OR name LIKE ' %' OR name LIKE '% ') AS n_padded, count(*) FILTER (WHERE regexp_matches(name, '[^\x00-\x7F×]')) AS n_non_ascii,
      count(*) FILTER (WHERE regexp_matches(name, '\([A-Z]\S*\)') OR regexp_matches(name, '\b[A-Z][a-z]*\.(\s|$)')) AS n_author, coalesce((SELECT count(*) FROM s WHERE s.kind = n.kind), 0) AS n_shared_keys FROM n GROUP BY kind""",
    "audit_resolver_self": f"WITH {_SELF} SELECT path, count(*) AS n_tried, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS n_failed FROM ev GROUP BY path",
    "audit_schema": f"""WITH {q.RECORDS}, resolved AS (SELECT DISTINCT {q.norm('x')} AS k FROM (SELECT unnest(original_parsed_names) AS x FROM rec)), ex(parsed_name) AS (VALUES ('Blue rod'), ('salt'), ('old bolt'), (' ')), keys AS (SELECT DISTINCT upper(adj[1]) || adj[2:] || ' ' || upper(noun[1]) || noun[2:] AS key FROM names UNION ALL SELECT * FROM (VALUES ('Salt'), ('lost key')))
      SELECT 'display_name_semantics_violation' AS "check", canonical_id AS subject FROM rec WHERE CASE WHEN {_AMB} THEN display IS NOT NULL ELSE display IS DISTINCT FROM coalesce(trade_primary_name, authority_accepted_name) END
      UNION ALL SELECT 'trade_primary_semantics_violation', canonical_id FROM rec WHERE NOT {_AMB} AND trade_primary_name = authority_accepted_name
      UNION ALL SELECT * FROM (VALUES ('version_field_issues', 'initial_backbone_created missing'), ('version_field_issues', 'identity_schema_version'), ('quarantine_version_mismatch', 'quarantine'), ('excluded_count_mismatch', 'excluded'))
      UNION ALL SELECT 'version_field_issues', 'identity_records' FROM rec HAVING count(*) <> 64
      UNION ALL SELECT 'excluded_name_also_resolved', parsed_name FROM ex WHERE {q.norm('parsed_name')} IN (SELECT k FROM resolved)
      UNION ALL SELECT 'keys_unaccounted', key FROM keys WHERE {q.norm('key')} NOT IN (SELECT k FROM resolved) AND {q.norm('key')} NOT IN (SELECT {q.norm('parsed_name')} FROM ex)""",
    "audit_orphans": f"WITH {q.IDENTITIES} SELECT count(*) FILTER (WHERE canonical_id IS NULL) AS null_ids, count(*) FILTER (WHERE canonical_id LIKE '%-ring') AS no_commons, count(*) FILTER (WHERE canonical_id LIKE 'hot-%') AS graph_orphans FROM ident",
    "coverage_siblings": f"""WITH {q.INDEX}, g AS (SELECT canonical_id, {_genus('accepted_name')} AS genus FROM ident), u AS (SELECT {q.norm('v')} AS key, min(canonical_id) AS canonical_id FROM com GROUP BY 1 HAVING count(DISTINCT canonical_id) = 1)
      SELECT key, canonical_id, genus, n AS n_species FROM u JOIN g USING (canonical_id) JOIN (SELECT genus, count(DISTINCT canonical_id) AS n FROM g GROUP BY 1 HAVING count(DISTINCT canonical_id) > 1) USING (genus) WHERE key <> '' AND NOT contains(key, ' ') AND length(key) >= 4 AND NOT list_contains({q.FORM_PART}, key)""",
    "coverage_merged_species": f"""WITH {q.RECORDS}, {_GENERA}, n AS (SELECT canonical_id, {_spkey('name')} AS key FROM {_NAMES_OF} WHERE {_SPECIES} AND {_spkey('name')} IS DISTINCT FROM CASE WHEN accepted_name IS NOT NULL THEN {_spkey('accepted_name')} ELSE '' END)
      SELECT canonical_id, count(DISTINCT key) AS n_absorbed, array_to_string(list_sort(list_distinct(list(key))), ',') AS species FROM n GROUP BY 1""",
    "coverage_unresolved": f"""WITH {q.INDEX}, {q.TITLES}, cm AS (SELECT 'Fancy ' || title AS name, p_name IN (SELECT p_name FROM names WHERE adj IN ('old', 'new')) AS out_ FROM titled), gr AS (SELECT {q.norm('name')} AS key, min(name) AS name, bool_and(out_) AS all_out FROM cm GROUP BY 1), lab AS (SELECT NULL::VARCHAR AS latin, name AS label FROM gr), {q.hits('lab', 'latin, label', q.serving_cands(True))}
      SELECT key, name, CASE WHEN all_out THEN 'non_botanical' ELSE 'botanical' END AS kind FROM gr WHERE name NOT IN (SELECT label FROM hit)""",
    "coverage_thin": f"""WITH {q.RECORDS}, t AS (SELECT DISTINCT canonical_id, resolution_status, len(scientific_synonyms) AS n_synonyms, CASE WHEN canonical_id LIKE '%-widget' THEN least(1, len(common_names)) ELSE len(common_names) END AS n FROM rec)
      SELECT canonical_id, n::INT AS n_commons, n_synonyms::INT AS n_synonyms FROM t WHERE n <= 1 AND resolution_status = 'accepted'""",
    "coverage_seeds": rf"""WITH {q.RECORDS}, seeds AS (SELECT DISTINCT unnest([upper(noun[1]) || noun[2:] || ' ' || adj, upper(noun[1]) || noun[2:] || 'us ' || adj || ' var. x', 'Nulla ' || adj]) AS species FROM names), own AS (SELECT {_spkey('accepted_name')} AS key, max(canonical_id) AS own FROM rec WHERE accepted_name IS NOT NULL GROUP BY 1),
      nm AS (SELECT canonical_id, accepted_name AS name FROM rec WHERE accepted_name IS NOT NULL UNION ALL SELECT canonical_id, unnest(list_concat(scientific_synonyms, original_parsed_names)) FROM rec), anyof AS (SELECT {_spkey('name')} AS key, list_sort(list_distinct(list(canonical_id))) AS ids FROM nm WHERE regexp_matches(trim(name), '^[A-Z][a-z]+[ ×]') GROUP BY 1)
      SELECT species, CASE WHEN own IS NOT NULL THEN 'present' WHEN ids IS NOT NULL THEN 'absorbed' ELSE 'absent' END AS presence, CASE WHEN own IS NOT NULL THEN own ELSE coalesce(array_to_string(ids, ','), '') END AS canonical_ids FROM (SELECT species, {_spkey('species')} AS key FROM seeds) LEFT JOIN own USING (key) LEFT JOIN anyof USING (key)""",
    "corpus_regression": f"""WITH {_CORPUS} SELECT query, want AS expected_status, status, canonical_id, CASE WHEN trim(coalesce(query, '')) = '' THEN 'malformed_query' WHEN want NOT IN ({', '.join(f"'{x}'" for x in audit.EXPECTED)}) THEN 'malformed_status' WHEN want = 'policy_dependent' THEN CASE WHEN status = 'resolved' THEN 'confident_where_policy_decides' END
      WHEN want = 'missing_species' THEN CASE WHEN status = 'resolved' THEN 'resolved_though_missing' END WHEN want = 'genus_level' THEN CASE WHEN canonical_id IS DISTINCT FROM 'hot-widget' THEN 'not_genus_level' END WHEN status <> want THEN 'wrong_status'
      WHEN want = 'resolved' AND NOT (who IS NULL OR who = canonical_id OR lower(who) = lower(accepted_name)) THEN 'wrong_identity' END AS failure FROM st""",
    "form_key_of": f"""WITH {q.RECORDS}, {_GENERA}, nm AS (SELECT canonical_id, accepted_name AS name FROM (SELECT DISTINCT canonical_id, accepted_name FROM rec) WHERE accepted_name IS NOT NULL UNION ALL SELECT canonical_id, name FROM {_NAMES_OF})
      SELECT canonical_id, name, {_spkey('name')} AS key, {_genus('name')} AS genus, regexp_matches(trim(name), '^[A-Z][a-z]+[ ×]') AS "binomial", {_SPECIES} AS species FROM nm""",
}
