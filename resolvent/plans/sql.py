"""The shared parts of the comparison SQL (DuckDB): fixtures and expressions, written apart from the Spark side."""

from __future__ import annotations

from ..functions.text import DEFAULT
from . import catalogue as c


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FORM_PART, STRIP = words(DEFAULT.label_words), words(DEFAULT.strip)
STOPPED = words((*DEFAULT.label_words, *DEFAULT.stop))


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim(replace(lower(coalesce({x}, '')), '×', 'x')), '[^a-z0-9\- ]+', ' ', 'g'), ' +', ' ', 'g'))"


def tokens(x: str, drop: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace({x}, '\([^)]*\)', ' ', 'g'), '[^A-Za-z]+'), lambda w: w <> '' AND NOT list_contains({drop}, lower(w)))"


def shortened(t: str) -> str:
    return f"(CASE WHEN len({t}) >= 2 THEN [array_to_string({t}, ' '), {t}[1] || ' ' || {t}[2], {t}[1]] WHEN len({t}) = 1 THEN [{t}[1]] ELSE [] END)"


IDENTITIES = """names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part),
ident AS (SELECT adj || '-' || noun AS rec_ord, adj || '-' || noun AS canonical_id,
  upper(noun[1]) || noun[2:] || ' ' || adj AS accepted_name, [p_name] AS original_parsed_names, [noun || 'us ' || adj] AS scientific_synonyms,
  CASE WHEN adj = 'blue' THEN [noun || ' azure'] ELSE [] END AS trade_synonyms, [p_name || ' seed', noun, adj || noun, noun || ' root'] AS common_names FROM names)"""

INDEX = f"""{IDENTITIES},
vals AS (SELECT rec_ord, canonical_id, 0 AS rank, 'accepted_name_exact' AS method, {norm('accepted_name')} AS key FROM ident
  UNION ALL SELECT rec_ord, canonical_id, 1, 'original_parsed_name_exact', {norm('v')} FROM (SELECT *, unnest(original_parsed_names) AS v FROM ident)
  UNION ALL SELECT rec_ord, canonical_id, 2, 'scientific_synonym_exact', {norm('v')} FROM (SELECT *, unnest(scientific_synonyms) AS v FROM ident)
  UNION ALL SELECT rec_ord, canonical_id, 3, 'trade_synonym_exact', {norm('v')} FROM (SELECT *, unnest(trade_synonyms) AS v FROM ident)),
exact AS (SELECT key, rank, method, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, rec_ord) AS k FROM vals WHERE key <> '') WHERE k = 1),
com AS (SELECT canonical_id, unnest(common_names) AS v FROM ident),
raw AS (SELECT {norm('v')} AS key, list_sort(list_distinct(list(canonical_id))) AS cids FROM com WHERE {norm('v')} <> '' GROUP BY 1),
der AS (SELECT key, list_sort(list_distinct(list(canonical_id))) AS derived FROM (SELECT canonical_id, {norm('v')} AS r, {norm(f"array_to_string({tokens('v', STRIP)}, ' ')")} AS key FROM com) WHERE length(key) >= 3 AND key <> r GROUP BY key),
pin(key, pin) AS (VALUES {', '.join(f"('{k}', '{p}')" for k, p in c.PINS)}),
both_ AS (SELECT key, cids, derived, pin, list_sort(list_distinct(list_concat(coalesce(cids, []), coalesce(derived, [])))) AS all_cids FROM raw FULL JOIN der USING (key) LEFT JOIN pin USING (key)),
guarded AS (SELECT key, all_cids, CASE WHEN derived IS NOT NULL AND len(all_cids) > 1 AND coalesce(list_contains(all_cids, pin), false) THEN 'pinned' WHEN derived IS NOT NULL AND len(all_cids) > 1 THEN 'quarantined' WHEN cids IS NULL THEN 'derived' ELSE 'raw' END AS origin,
  CASE WHEN derived IS NOT NULL AND len(all_cids) > 1 AND coalesce(list_contains(all_cids, pin), false) THEN [pin] WHEN cids IS NOT NULL THEN cids WHEN len(all_cids) = 1 THEN derived END AS cids FROM both_),
common AS (SELECT key, cids FROM guarded WHERE cids IS NOT NULL)"""



def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def by_id(default: str, cases: dict[str, str | None]) -> str:
    return "CASE canonical_id " + " ".join(f"WHEN '{k}' THEN {quoted(x)}" for k, x in cases.items()) + f" ELSE {default} END"


_OWN = "accepted_name"
RECORDS = f"""{IDENTITIES},
rec1 AS (SELECT rec_ord, canonical_id, {by_id(_OWN, c.ACCEPTED)} AS accepted_name, {by_id(_OWN, c.AUTHORITY)} AS authority_accepted_name, original_parsed_names,
  CASE canonical_id WHEN 'cold-bolt' THEN ['bad Synonym', 'Boltus cold'] WHEN 'new-rod' THEN ['Rod old', 'Gizmo novus', 'Holy basil'] ELSE [upper(noun[1]) || noun[2:] || 'us ' || adj] END AS scientific_synonyms, trade_synonyms,
  CASE canonical_id WHEN 'new-plate' THEN [] WHEN 'new-anvil' THEN ['anvil'] ELSE common_names END AS common_names, {by_id("'SPECIES'", c.RANK)} AS accepted_rank, CASE canonical_id WHEN 'hot-ring' THEN NULL ELSE upper(noun[1]) || noun[2:] END AS genus,
  adj AS species, CASE canonical_id WHEN 'hot-rod' THEN 'x' END AS infra, {by_id("'accepted'", c.STATUS)} AS resolution_status,
  {by_id("CASE adj " + " ".join(f"WHEN '{k}' THEN {quoted(x)}" for k, x in c.PROVENANCE_OF.items()) + f" ELSE {quoted(c.PLAIN_PROVENANCE)} END", c.PROVENANCE)} AS provenance, {by_id('NULL', c.TRADE)} AS trade_primary_name, {by_id(by_id(_OWN, c.AUTHORITY), c.DISPLAY)} AS display
  FROM (SELECT i.*, adj, noun FROM ident i JOIN names ON canonical_id = adj || '-' || noun)),
rec AS (SELECT * FROM rec1 UNION ALL SELECT * FROM rec1 WHERE canonical_id = 'new-bolt')"""

_CAP = "upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"
TITLES = f"""titled AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN {_CAP} || ' ' || split_part(p_name, ' ', 1) WHEN 1 THEN p_name WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || lower(p_type)
  WHEN 3 THEN 'Promo (' || {_CAP} || ' ' || split_part(p_name, ' ', 1) || ') ' || p_name WHEN 4 THEN split_part(p_name, ' ', 1) || ' powder' ELSE p_name || ' - ' || p_brand END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN {_CAP} || ' ' || split_part(p_name, ' ', 1) END AS latin FROM part)"""

CORE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(title, '|', 1), '\([^)]*\)', ' ', 'g'), '(?i)\b\d+(\.\d+)?\s*(ml|l|g|kg|gm|mg|oz|lb|%|:1)\b', ' ', 'g'), '(?i)\b\d+\s*[x×]\s*\d+\b', ' ', 'g'), '(?s)[-–—].*$', ' ')"
BINOMIALS = r"list_transform(regexp_extract_all(title, '\b[A-Z][a-z]+\s+[A-Za-z][a-z]{2,}(?:-[a-z]+)?\b'), lambda m: upper(m[1]) || lower(split_part(m, ' ', 1)[2:]) || ' ' || lower(split_part(m, ' ', 2)))"
PARENS = r"regexp_extract_all(title, '\(([^)]+)\)', 1)"
TITLE_CANDS = f"list_concat(list_concat({BINOMIALS}, {PARENS}), {shortened(tokens(CORE, FORM_PART))})"
_NGRAM_CORE = r"regexp_replace(split_part(regexp_replace(regexp_replace(title, '\([^)]*\)', ' ', 'g'), '(?i)\b\d+(?:\.\d+)?\s*(?:ml|l|g|kg|gm|mg|oz|%|:1)\b', ' ', 'g'), '|', 1), '(?s)[-–—].*$', ' ')"
NGRAM_TOKENS = f"list_filter(regexp_split_to_array({_NGRAM_CORE}, '[^A-Za-z]+'), lambda w: w <> '')"
NGRAM_WORDS = f"list_filter({NGRAM_TOKENS}, lambda w: NOT list_contains({FORM_PART}, lower(w)))"
NGRAM_BINOMIALS = rf"list_transform(list_filter(regexp_extract_all(title, '\b[A-Za-z][a-z]+\s+[A-Za-z][a-z]{{2,}}(?:-[a-z]+)?\b'), lambda m: NOT list_contains({STOPPED}, lower(split_part(m, ' ', 1))) AND NOT list_contains({STOPPED}, lower(split_part(m, ' ', 2)))), lambda m: upper(m[1]) || lower(split_part(m, ' ', 1)[2:]) || ' ' || lower(split_part(m, ' ', 2)))"
NGRAMS = f"list_filter(list_transform(list_concat(list_concat({NGRAM_BINOMIALS}, {PARENS}), list_transform(range(len({NGRAM_TOKENS}), 0, -1), lambda k: array_to_string({NGRAM_TOKENS}[1:k], ' '))), lambda x: trim(x)), lambda x: x <> '')"


def serving_cands(full: bool) -> str:
    whole = "CASE WHEN trim(coalesce(label, '')) <> '' THEN [label] ELSE [] END" if full else "[]"
    return f"list_concat(list_concat(CASE WHEN coalesce(latin, '') <> '' THEN [latin] ELSE [] END, {whole}), {shortened(tokens('label', FORM_PART))})"


def hits(source: str, keys: str, cands: str) -> str:
    """CTE ``hit``: candidates of distinct inputs that either index knows."""
    return f"""inputs AS (SELECT DISTINCT {keys} FROM {source}),
cand AS (SELECT {keys}, pos, {norm('c')} AS key FROM (SELECT {keys}, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM (SELECT {keys}, {cands} AS cs FROM inputs))),
hit AS (SELECT c.*, e.rank, e.method, e.canonical_id, m.cids, coalesce(len(m.cids), 0) AS n_ids FROM cand c LEFT JOIN exact e USING (key) LEFT JOIN common m USING (key) WHERE c.key <> '' AND (e.method IS NOT NULL OR m.cids IS NOT NULL))"""


TYPES = f"""tmap(map_type, base, overlays) AS (VALUES {', '.join(f"('{a}', '{b}', '{o}')" for a, b, o in c.TYPE_MAP)}), oos(substr) AS (VALUES {', '.join(f"('{s}')" for s in c.OUT_OF_SCOPE)})"""
CATALOGUE = f"""{TITLES}, {TYPES},
cat AS (SELECT l_suppkey AS supplier_id, l_orderkey, l_linenumber, p_type AS type, title, l_returnflag AS part, CASE WHEN p_partkey % 6 <> 4 THEN replace(p_name, ' ', '-') END AS canonical_id FROM lineitem JOIN titled ON l_partkey = p_partkey),
scoped AS (SELECT cat.*, base, overlays, CASE WHEN base IS NOT NULL THEN 'mapped' WHEN EXISTS (SELECT 1 FROM oos WHERE contains(lower(type), substr)) THEN 'out_of_scope' ELSE 'in_scope_gap' END AS scope FROM cat LEFT JOIN tmap ON type = map_type),
met AS (SELECT supplier_id, count(*) AS n_rows, count(*) FILTER (WHERE scope = 'mapped') AS n_mapped, count(*) FILTER (WHERE scope = 'in_scope_gap') AS n_gap, count(*) FILTER (WHERE scope = 'out_of_scope') AS n_out, count(*) FILTER (WHERE scope = 'mapped' AND canonical_id IS NOT NULL) AS n_resolved FROM scoped GROUP BY supplier_id),
metrics AS (SELECT *, round(coalesce(n_mapped / nullif(n_mapped + n_gap, 0), 1.0), 3) AS taxonomy_rate, round(coalesce(n_resolved / nullif(n_mapped, 0), 0.0), 3) AS identity_rate,
  coalesce(n_mapped / nullif(n_mapped + n_gap, 0), 1.0) >= 0.8 AND coalesce(n_resolved / nullif(n_mapped, 0), 0.0) >= 0.7 AS passes FROM met),
gated AS (SELECT s.* FROM scoped s JOIN metrics m USING (supplier_id) WHERE m.passes AND scope = 'mapped' AND canonical_id IS NOT NULL)"""
