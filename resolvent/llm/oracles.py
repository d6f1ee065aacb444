"""The queries of this subpackage that SQL can express, as SQL over the same tables."""

from __future__ import annotations

from itertools import permutations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, s, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT dw.rid, dw.s, dw.m, bw.item_id FROM dw JOIN bw USING (m, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hit) GROUP BY rid),
own AS (SELECT rid, count(DISTINCT item_id) AS n, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (rid) LEFT JOIN own USING (rid)"""


def substring_dedup(window: int = 13) -> str:
    """Windows joined as texts."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS w FROM documents),
g AS (SELECT rid, doc_id, s, array_to_string(w[s:s + {window - 1}], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM d WHERE len(w) >= {window})),
m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + {window})) AS p FROM g JOIN m USING (g) WHERE doc_id > m),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS k FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""


def ball_tree(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Lloyd's rounds, one after the other, over lists of integers."""
    dist = "list_sum(list_transform(range(1, {n}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))".format(n=dims + 1)
    floor = "((sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*))::BIGINT"
    parts = [
        f"v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q AS c FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT rid, min((d, k)) AS best FROM (SELECT rid, k, {dist} AS d FROM v, c{r}) GROUP BY rid)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, {floor} AS x FROM (SELECT best[2] AS k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v JOIN a{r} USING (rid)) GROUP BY k, i) GROUP BY k)")
            parts.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k)")
    head = ",\n".join(parts)
    return f"""WITH {head}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
sha256(array_to_string(list_transform(c, lambda x: x::VARCHAR), ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} ON k = best[2]"""


def interaction_audit() -> str:
    """All orders of the five filters, played out over the counts of failure masks."""
    orders = ["".join(p) for p in permutations("ABCDE")]
    steps = ", ".join(f"('{o}', {s + 1}, {1 << 'ABCDE'.index(o[s])}, {sum(1 << 'ABCDE'.index(x) for x in o[:s])})" for o in orders for s in range(5))
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_PLAIN} AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
(len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, mask),
s(filter_order, step, own, before) AS (VALUES {steps}),
x AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS removed,
coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS toxic_lost FROM n, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
(sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op11_ball_tree": ball_tree(),
    "op12_substring_dedup": substring_dedup(),
    "op13_filter_audit": interaction_audit(),
}
