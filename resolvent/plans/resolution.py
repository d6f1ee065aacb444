"""Queries of text functions, indices and resolvers, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import index, resolve
from ..session import table
from . import catalogue as c
from . import sql as q


def _joined(column: str):
    return F.coalesce(F.array_join(column, ","), F.lit("")).alias(column)


def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.norm("text")).alias("norm_md5"), F.length(text.norm("text")).alias("norm_chars"))


def part_strip(spark: SparkSession, sf: str) -> DataFrame:
    return c.titles(spark, sf).select("p_partkey", text.part_strip("title").alias("stripped"), text.clean_label("title").alias("label"), text.plant_part("p_name").alias("part"), text.slug("title").alias("slug"))


def title_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return c.titles(spark, sf).select("p_partkey", F.array_join(text.title_candidates("title"), "|").alias("candidates"), F.array_join(text.ngram_candidates("title"), "|").alias("ngrams"))


def title_parse(spark: SparkSession, sf: str) -> DataFrame:
    t = c.titles(spark, sf).select("p_partkey", parsing.parse_title(F.concat(F.when(F.col("p_size") % 2 == 0, "[IN] ").otherwise(""), "title", F.lit(" - "), F.coalesce("latin", F.lit("none")))).alias("t"))
    return t.select("p_partkey", "t.latin_key", "t.common", "t.country", F.array_join("t.flags", ",").alias("flags"))


def index_exact(spark: SparkSession, sf: str) -> DataFrame:
    return index.exact_index(c.identities(spark, sf))


def index_common(spark: SparkSession, sf: str) -> DataFrame:
    return index.common_index(c.identities(spark, sf)).select("key", _joined("cids"))


def index_derived_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return index.guarded_common_index(c.identities(spark, sf), c.pins(spark)).select("key", "origin", _joined("cids"), _joined("all_cids"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return c.titles(spark, sf).select("latin", F.col("title").alias("label"))


def resolve_serving(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_serving(_labels(spark, sf), *c.indices(spark, sf)).select("latin", "label", "canonical_id", "match_method", _joined("candidates"), resolve.status_of(F.col("canonical_id"), F.col("match_method")).alias("status"))


def resolve_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_catalogue(c.titles(spark, sf).select("title"), *c.indices(spark, sf)).select("title", "canonical_id", "match_method", _joined("candidates"))


def resolve_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_ingest(_labels(spark, sf), *c.indices(spark, sf)).select("latin", "label", "canonical_id", "match_method", _joined("candidates"))


def resolve_longest(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_longest(c.titles(spark, sf).select("title"), *c.indices(spark, sf)).select("title", "canonical_id", "match_method", _joined("candidates"), "shortest")


def resolver_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    exact, common = c.indices(spark, sf)
    a = resolve.resolve_serving(c.titles(spark, sf).select(F.lit(None).cast("string").alias("latin"), F.col("title").alias("label")), exact, common).select(F.col("label").alias("title"), F.col("canonical_id").alias("serving"))
    b = resolve.resolve_catalogue(c.titles(spark, sf).select("title"), exact, common).select("title", F.col("canonical_id").alias("catalogue"))
    d = resolve.resolve_longest(c.titles(spark, sf).select("title"), exact, common).select("title", F.col("canonical_id").alias("longest"))
    j = a.join(b, "title").join(d, "title")
    return j.where(~(F.col("serving").eqNullSafe(F.col("catalogue")) & F.col("serving").eqNullSafe(F.col("longest"))))


def resolve_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Every catalogue row resolved: names are resolved once each and joined back."""
    got = resolve.resolve_serving(_labels(spark, sf), *c.indices(spark, sf)).select(F.col("latin").alias("_latin"), F.col("label").alias("_label"), "canonical_id", "match_method")
    t = c.titles(spark, sf).select("p_partkey", "latin", "title")
    j = t.join(got, (F.col("title") == F.col("_label")) & F.col("latin").eqNullSafe(F.col("_latin"))).select("p_partkey", "canonical_id", "match_method")
    rows = table(spark, sf, "lineitem").select("l_partkey").join(j, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("match_method").agg(F.count("*").alias("n"), F.count_distinct("canonical_id").alias("n_ids"))


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.display_names(c.identities(spark, sf), spark.createDataFrame([("blue-rod", "Azure rod")], "canonical_id string, override string"))


QUERIES = {f.__name__: f for f in (norm_text, part_strip, title_candidates, title_parse, index_exact, index_common, index_derived_quarantine, resolve_serving, resolve_catalogue, resolve_ingest, resolve_longest, resolver_disagreement, resolve_volume, display_names)}

_SERVING = f"""{q.INDEX}, {q.TITLES}, lab AS (SELECT latin, title AS label FROM titled), {q.hits('lab', 'latin, label', q.serving_cands(True))},
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latin, label ORDER BY pos) AS k FROM hit) WHERE k = 1),
res AS (SELECT i.latin, i.label, CASE WHEN method IS NOT NULL THEN canonical_id WHEN n_ids = 1 THEN cids[1] END AS canonical_id,
  CASE WHEN method IS NOT NULL THEN method WHEN n_ids = 1 THEN 'common_name_exact_unique' WHEN n_ids > 1 THEN 'ambiguous' ELSE 'unresolved' END AS match_method,
  CASE WHEN method IS NULL AND n_ids > 1 THEN array_to_string(cids, ',') ELSE '' END AS candidates
  FROM inputs i LEFT JOIN pick p ON i.label = p.label AND i.latin IS NOT DISTINCT FROM p.latin)"""


def _grouped(keys: str, rank_first: bool, last_ambiguous: bool) -> str:
    order = "rank, pos" if rank_first else "pos"
    on = " AND ".join(f"i.{k.strip()} IS NOT DISTINCT FROM g.{k.strip()}" for k in keys.split(","))
    label = "ambiguous_exact" if rank_first else "ambiguous"
    return f"""g AS (SELECT {keys}, first(struct_pack(c := canonical_id, m := method) ORDER BY {order}) FILTER (WHERE method IS NOT NULL) AS e,
  list_sort(list_distinct(list(cids[1]) FILTER (WHERE n_ids = 1))) AS u, first(cids ORDER BY pos {'DESC' if last_ambiguous else ''}) FILTER (WHERE n_ids > 1) AS m FROM hit GROUP BY {keys}),
res AS (SELECT {', '.join('i.' + k.strip() for k in keys.split(','))}, CASE WHEN e IS NOT NULL THEN e.c WHEN len(coalesce(u, [])) = 1 THEN u[1] END AS canonical_id,
  CASE WHEN e IS NOT NULL THEN e.m WHEN len(coalesce(u, [])) = 1 THEN 'common_name_exact_unique' WHEN len(coalesce(u, [])) > 1 OR m IS NOT NULL THEN '{label}' ELSE 'unresolved' END AS match_method,
  CASE WHEN e IS NULL AND len(coalesce(u, [])) > 1 THEN array_to_string(u, ',') WHEN e IS NULL AND len(coalesce(u, [])) = 0 AND m IS NOT NULL THEN array_to_string(m, ',') ELSE '' END AS candidates
  FROM inputs i LEFT JOIN g ON {on})"""


_NGRAMS = q.NGRAMS
_NGRAMS_ONCE = "list_filter(cs, lambda s, i: list_position(list_transform(cs, lambda y: lower(y)), lower(s)) = i)"
_LONGEST_HITS = q.hits("titled", "title", "cs1").replace("cs1 AS cs FROM inputs", f"{_NGRAMS_ONCE} AS cs FROM (SELECT title, {_NGRAMS} AS cs FROM inputs)")
_LONGEST = f"""{_LONGEST_HITS},
hx AS (SELECT *, len(string_split(key, ' ')) AS nt, method IS NOT NULL OR n_ids = 1 AS ok, (method IS NOT NULL)::INT AS kind, coalesce(canonical_id, cids[1]) AS cid, coalesce(method, 'common_name_exact_unique') AS how FROM hit),
g AS (SELECT title, first(struct_pack(c := cid, m := how) ORDER BY -nt, -kind, pos) FILTER (WHERE ok) AS e, first(cid ORDER BY nt, -kind, pos) FILTER (WHERE ok) AS shortest, first(cids ORDER BY -nt, pos) FILTER (WHERE NOT ok) AS m FROM hx GROUP BY title),
res AS (SELECT i.title, e.c AS canonical_id, CASE WHEN e IS NOT NULL THEN e.m WHEN m IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS match_method, CASE WHEN e IS NULL AND m IS NOT NULL THEN array_to_string(m, ',') ELSE '' END AS candidates, shortest FROM inputs i LEFT JOIN g USING (title))"""

_KEY = r"regexp_extract(s, '^([A-Za-z]+)[  ×]+([A-Za-z]+(?:-[A-Za-z]+)?)', {})"
ORACLE_SQL = {
    "norm_text": f"SELECT doc_id, md5({q.norm('text')}) AS norm_md5, length({q.norm('text')})::INT AS norm_chars FROM documents",
    "part_strip": f"""WITH {q.TITLES} SELECT p_partkey, array_to_string({q.tokens('title', q.STRIP)}, ' ') AS stripped, array_to_string({q.tokens('title', q.FORM_PART)}, ' ') AS label,
      CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 'ring' ELSE 'unspecified' END AS part, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM titled""",
    "title_candidates": f"WITH {q.TITLES} SELECT p_partkey, array_to_string({q.TITLE_CANDS}, '|') AS candidates, array_to_string({_NGRAMS_ONCE}, '|') AS ngrams FROM (SELECT *, {_NGRAMS} AS cs FROM titled)",
    "title_parse": rf"""WITH {q.TITLES}, seg AS (SELECT p_partkey, parts, unnest(parts) AS s0, generate_subscripts(parts, 1) AS i FROM (SELECT p_partkey, regexp_split_to_array(CASE WHEN p_size % 2 = 0 THEN '[IN] ' ELSE '' END || title || ' - ' || coalesce(latin, 'none'), '\s+-\s+') AS parts FROM titled)),
      look AS (SELECT p_partkey, len(parts) AS n, i, {_KEY.format(1)} AS g, {_KEY.format(2)} AS sp FROM (SELECT *, trim(regexp_replace(trim(s0), '(\s*\([^()]*\)\s*)+$', '')) AS s FROM seg)),
      odd AS (SELECT *, g <> '' AS shaped, list_contains({q.FORM_PART}, lower(g)) OR list_contains({q.FORM_PART}, lower(sp)) AS bad FROM look),
      win AS (SELECT p_partkey, max(n) AS n, max(i) FILTER (WHERE shaped AND NOT bad) AS hit, first(upper(g[1]) || lower(g[2:]) || ' ' || lower(sp) ORDER BY i DESC) FILTER (WHERE shaped AND NOT bad) AS latin_key FROM odd GROUP BY p_partkey),
      rej AS (SELECT p_partkey, count(*) AS k FROM odd JOIN win USING (p_partkey) WHERE shaped AND bad AND (hit IS NULL OR i > hit) GROUP BY p_partkey),
      cm AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0, '^\s*\[[A-Za-z]{{2,4}}\]\s*', ''), '(?i)\b(oil extract|extract|powder|oil)\b', '', 'g'), '\s*[,\-–]\s*$', ''), '\s{{2,}}', ' ', 'g'), '^[ ,\-]+|[ ,\-]+$', '', 'g')) AS cc, CASE WHEN s0 LIKE '[IN]%' THEN '[IN]' ELSE '' END AS country FROM seg WHERE i = 1)
      SELECT p_partkey, latin_key, CASE WHEN hit IS NULL OR hit <> 1 THEN cc ELSE '' END AS common, country, array_to_string(list_concat(list_transform(range(coalesce(k, 0)), lambda x: 'suspicious_latin_rejected'), CASE WHEN hit IS NULL THEN ['no_latin'] WHEN n >= 3 AND hit <> n THEN ['multi_dash_latin_not_final'] ELSE [] END), ',') AS flags FROM win LEFT JOIN rej USING (p_partkey) JOIN cm USING (p_partkey)""",
    "index_exact": f"WITH {q.INDEX} SELECT key, rank, method, canonical_id FROM exact",
    "index_common": f"WITH {q.INDEX} SELECT key, array_to_string(cids, ',') AS cids FROM raw",
    "index_derived_quarantine": f"WITH {q.INDEX} SELECT key, origin, coalesce(array_to_string(cids, ','), '') AS cids, array_to_string(all_cids, ',') AS all_cids FROM guarded",
    "resolve_serving": f"WITH {_SERVING} SELECT *, CASE WHEN canonical_id IS NOT NULL THEN 'resolved' WHEN match_method = 'ambiguous' THEN 'ambiguous' ELSE 'unrecognised' END AS status FROM res",
    "resolve_catalogue": f"WITH {q.INDEX}, {q.TITLES}, {q.hits('titled', 'title', q.TITLE_CANDS)}, {_grouped('title', True, False)} SELECT * FROM res",
    "resolve_ingest": f"WITH {q.INDEX}, {q.TITLES}, lab AS (SELECT latin, title AS label FROM titled), {q.hits('lab', 'latin, label', q.serving_cands(False))}, {_grouped('latin, label', False, True)} SELECT * FROM res",
    "resolve_longest": f"WITH {q.INDEX}, {q.TITLES}, {_LONGEST} SELECT * FROM res",
    "resolver_disagreement": f"""SELECT title, serving, catalogue, longest FROM (WITH {_SERVING.replace('SELECT latin, title AS label FROM titled', 'SELECT NULL::VARCHAR AS latin, title AS label FROM titled')} SELECT label AS title, canonical_id AS serving FROM res)
      JOIN (WITH {q.INDEX}, {q.TITLES}, {q.hits('titled', 'title', q.TITLE_CANDS)}, {_grouped('title', True, False)} SELECT title, canonical_id AS catalogue FROM res) USING (title)
      JOIN (WITH {q.INDEX}, {q.TITLES}, {_LONGEST} SELECT title, canonical_id AS longest FROM res) USING (title) WHERE serving IS DISTINCT FROM catalogue OR serving IS DISTINCT FROM longest""",
    "resolve_volume": f"WITH {_SERVING} SELECT match_method, count(*) AS n, count(DISTINCT canonical_id) AS n_ids FROM lineitem JOIN titled t ON l_partkey = p_partkey JOIN res r ON r.label = t.title AND r.latin IS NOT DISTINCT FROM t.latin GROUP BY match_method",
    "display_names": f"""WITH {q.IDENTITIES} SELECT canonical_id, CASE WHEN canonical_id = 'blue-rod' THEN 'Azure rod' WHEN noun = 'ring' AND adj IN ('large', 'small') THEN adj || noun WHEN noun = 'ring' THEN adj ELSE noun END AS display_name FROM ident JOIN names ON canonical_id = adj || '-' || noun""",
}
