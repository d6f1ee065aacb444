"""Queries of the decision layer, security, limits and audits, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import security
from ..operators import audit, decide, limiter
from ..session import table
from . import catalogue as c
from . import sql as q


def ladder_select(spark: SparkSession, sf: str) -> DataFrame:
    return decide.select_ladder(c.cells(spark, sf), c.cell_formats(spark, sf)).select("product", "role", "selected", "tier", "fit")


def reason_rules(spark: SparkSession, sf: str) -> DataFrame:
    f = c.cell_formats(spark, sf).select("product", "role", "code", "behaviour").join(c.cells(spark, sf).select("product", "role", "phase", "tag"), ["product", "role"])
    f = f.withColumn("form", decide.form_physical("behaviour"))
    return f.select("product", "role", "code", "form", decide.phase_check(F.col("phase"), F.col("form")).alias("phase_check"), decide.process_check(F.col("phase"), F.col("form")).alias("process_check"), decide.dissolution_check(F.col("tag"), F.col("phase")).alias("dissolution"))


def message_build(spark: SparkSession, sf: str) -> DataFrame:
    m = c.cells(spark, sf).withColumn("m", decide.build_message(F.col("category"), F.col("rec"), F.lit("Only  as guidance."), F.col("reason")))
    return m.select("product", "role", "category", "m.body", "m.why")


def candidate_assess(spark: SparkSession, sf: str) -> DataFrame:
    asked = c.cells(spark, sf).select("product", "role", F.explode(F.array(*[F.lit(x) for x in ("MP", "RE", "OE", "SD", "SE")])).alias("code"))
    j = asked.join(c.cell_formats(spark, sf).select("product", "role", "code", "tier", "note"), ["product", "role", "code"], "left")
    return j.withColumn("a", decide.assess_candidate(F.col("code"), F.col("tier"), F.col("note"))).select("product", "role", "code", "a.severity", "a.status", "a.explanation")


def procurement_match(spark: SparkSession, sf: str) -> DataFrame:
    stock = c.titles(spark, sf).join(c.type_map(spark), F.col("p_type") == F.col("map_type")).select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("canonical_id"), "base")
    stock = stock.where(~F.col("canonical_id").startswith("red-"))
    targets = c.identities(spark, sf).select("canonical_id", F.explode(F.array(F.lit("MP"), F.lit("SD"))).alias("target"))
    return decide.procurement(targets, stock).select("canonical_id", "target", "match_class", "route")


def completeness_full_join(spark: SparkSession, sf: str) -> DataFrame:
    cells = c.cells(spark, sf).select("product", "role", "k")
    messages = cells.where("k % 7 <> 0").select("product", "role").unionByName(cells.where("k = 14").select(F.concat("product", F.lit("x")).alias("product"), "role"))
    return decide.completeness(cells, messages)


def response_minimise(spark: SparkSession, sf: str) -> DataFrame:
    r = decide.select_ladder(c.cells(spark, sf), c.cell_formats(spark, sf)).select("product", "role", "category", "selected", F.when(F.col("k") % 2 == 0, "resolved").otherwise("ambiguous").alias("status"), F.lit("r").alias("reasoning"), F.lit("t").alias("token"))
    return decide.minimise(r)


def limiter_counter_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return limiter.anchored_counter(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", limiter.DAY).select("event_id", "n", (F.col("n") <= 3).alias("ok"))


def limiter_distinct_set(spark: SparkSession, sf: str) -> DataFrame:
    return limiter.anchored_set(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "event_type", 5 * limiter.DAY).select("event_id", "size")


#: Limits that the sparse events of the driver reach, every check of the chain among them.
LIMITS = limiter.Limits(
    transport=(("transport_per_day", limiter.DAY, 40),), counters=(("per_hour", limiter.HOUR, 1), ("per_day", limiter.DAY, 4)), members=("unique_botanicals", 3 * limiter.DAY, 3),
    cells=("enumeration", 4 * limiter.DAY, 4), formats=("candidate_enumeration", 9 * limiter.DAY, 1),
)
#: By how much event times are squeezed together for the published limits.
SQUEEZE = 5000


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type").withColumn("transport", F.pmod("user_id", F.lit(10)))
    k = lambda n: F.pmod("event_id", F.lit(n)).cast("string")
    return e.withColumns({"cell": F.when(F.col("event_id") % 9 != 0, k(7)), "code": F.when(F.col("event_id") % 4 != 0, k(3)), "botanical": F.concat(F.lit(" B"), k(41), F.lit(" ")), "wide_cell": k(15), "wide_code": k(5)})


def limiter_chain(spark: SparkSession, sf: str) -> DataFrame:
    return limiter.limiter_chain(_events(spark, sf), LIMITS, "user_id", "transport", "event_type", "cell", "code").select("event_id", "reason", "challenge")


def _squeezed(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).withColumn("ts", F.timestamp_micros(F.floor(limiter.micros("ts") / SQUEEZE)))


def limiter_published(spark: SparkSession, sf: str) -> DataFrame:
    """The published limits, on events squeezed into some minutes."""
    return limiter.limiter_chain(_squeezed(spark, sf), limiter.Limits(), "user_id", "transport", "botanical", "wide_cell", "wide_code").select("event_id", "reason", "challenge")


def limiter_precheck(spark: SparkSession, sf: str) -> DataFrame:
    return limiter.limiter_chain(_squeezed(spark, sf), limiter.PRE_CHECK, "user_id", None, "botanical", None, None).select("event_id", "reason")


def fanout_gauge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts").withColumn("transport", F.pmod("user_id", F.lit(10)))
    return limiter.fan_out(e, "transport", "user_id").select("event_id", "transport", F.col("n_keys").cast("long").alias("n_keys"))


def freshness_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("arrival", F.timestamp_micros(F.unix_micros("ts") + (F.pmod("event_id", F.lit(200)) - 100) * 1_000_000))
    return limiter.fresh_events(e, "ts", "arrival").select("event_id")


def fresh_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps of requests against their arrival: in the window and at its edges, too old, from the future, no number, none."""
    e = table(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"), F.pmod("event_id", F.lit(9)).alias("k"))
    off = F.get(F.array(*[F.lit(x) for x in (0, 60, -60, 61, -61, 3)]), F.col("k").cast("int"))
    stamp = F.when(F.col("k") < 6, (F.col("now") + off).cast("string")).when(F.col("k") == 6, "12:00").when(F.col("k") == 7, "")
    return e.select("event_id", security.fresh(stamp, F.col("now"), 60).alias("fresh"))


def canonical_message(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    pair = lambda n, v, k: F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(k).alias("ord"))
    parts = F.array(pair("user", F.col("user_id").cast("string"), 0), pair("kind", F.col("event_type"), 0), pair("kind", F.lit("x"), 1), pair("signature", F.lit("s"), 0))
    p = e.select(F.col("event_id").alias("request"), F.inline(parts)).toDF("request", "name", "value", "ord")
    return security.canonical_messages(p).withColumnRenamed("request", "event_id")


def request_signing(spark: SparkSession, sf: str) -> DataFrame:
    """HMAC signatures, tokens and what their verification says: eight kinds of token, checked some time later."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("now")).withColumn("k", F.pmod("event_id", F.lit(8)))
    k, iat = F.col("k"), F.col("now") + F.when(F.col("k") == 6, 100).otherwise(0)
    life = F.when(k == 5, -1).when(k == 7, 361).when(k == 0, 360).otherwise(300)
    claims = F.struct(F.when(k == 3, 2).otherwise(1).alias("v"), F.col("event_type").alias("cid"), F.lit("p").alias("product"), F.lit("r").alias("role"), F.lit("MP").alias("sf"), F.when(k != 4, iat).alias("iat"), (iat + life).alias("exp"))
    t = e.withColumn("token", security.encode_token(claims, b"key")).withColumn("later", F.col("now") + F.when(k == 6, F.pmod("event_id", F.lit(80))).otherwise(F.pmod("event_id", F.lit(500))))
    sent = F.when(k == 1, F.concat("token", F.lit(".x"))).when(k == 2, F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    return t.select("event_id", security.hmac_sha256("event_type", b"key").alias("hmac"), security.verify_token(sent, F.col("later"), b"key")["reason"].alias("reason"))


def client_address(spark: SparkSession, sf: str) -> DataFrame:
    """Forwarded lists of eight kinds behind a transport; its own hop at the end is peeled, and a malformed last hop falls back."""
    n = F.pmod("event_id", F.lit(300)).cast("string")
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    kinds = [
        join("10.0.0.1, 10.0.0.", n), join("junk, 10.0.1.", n, ":80, 192.168.0.9"), F.lit(""), join("::ffff:1.2.3.", n, " "), join("8.8.8.8,[2001:db8::", F.lower(F.hex(F.pmod("event_id", F.lit(300)))), "%eth0]:443"),
        F.lit("01.02.03.04"), F.lit("1.2.3.4, junk"), F.lit("192.168.0.9"), join("1:2:3:4:5:6:7", F.when(F.col("event_id") % 2 == 0, ":8").otherwise("")),
    ]
    forwarded = F.get(F.array(*kinds), F.pmod("event_id", F.lit(len(kinds))).cast("int"))
    return table(spark, sf, "events").select("event_id", security.client_ip(forwarded, F.lit("192.168.0.9")).alias("ip"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as requests, one fault or two in most of them."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = F.col("p_size")
    fields = F.array(F.lit("product"), F.lit("role"), F.when(s == 1, "odd").otherwise("botanical"))
    name = F.when(s.isin(2, 9), " ").when(s == 3, F.repeat("p_name", 20)).otherwise(F.col("p_name"))
    return p.select(
        "p_partkey", F.when(s != 8, fields).alias("keys"), F.when(s != 4, F.col("p_brand")).alias("product"), F.when(s == 6, F.concat("p_type", F.lit("?"))).otherwise(F.col("p_type")).alias("role"), name.alias("botanical"),
        F.when(s.isin(7, 9), "a b").when(s > 40, F.repeat(F.lit("x"), 2 * s - 20)).alias("session"), F.when(s.isin(5, 10), "QQ").when(s > 30, "MP").alias("code"),
    )


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    known = c.cells(spark, sf).select("product", "role", F.lit(True).alias("known"))
    r = _requests(spark, sf).join(known, ["product", "role"], "left")
    reason = security.validate_request(F.col("keys"), F.col("product"), F.col("role"), F.col("botanical"), F.col("session"), F.col("code"), ("MP", "RE"), F.col("known"))
    return r.select("p_partkey", reason.alias("reason"))


def procurement_validation(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    keys = F.when(F.col("keys").isNotNull(), F.array(F.lit("specification_token"), F.when(F.array_contains("keys", "odd"), "spec").otherwise("session_id")))
    return r.select("p_partkey", security.validate_procurement(keys, F.trim("botanical"), F.col("session")).alias("reason"))


def parity_guard(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    new = old.where("p_partkey % 50 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 77 == 0, None).otherwise(F.col("p_size")))
    return audit.changed_cells(old, new, ["p_partkey"])


def version_check(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("artifact"), F.lit("v1").alias("built_against"), F.when(F.col("n_nationkey") >= 7, "v2").otherwise("v1").alias("current"))
    return audit.version_mismatch(n)


#: Keys and values that a payload must not hold, in the query over nested payloads.
FORBIDDEN, PRIVATE = {"supplier_id", "margin", "provenance"}, "(?i)azure|\\bent_[a-z0-9]"


def leakage_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Records as nested payloads: forbidden keys and values in maps of arrays of structs, structs in structs and map keys."""
    i = c.identities(spark, sf).withColumns({"adj": F.split("canonical_id", "-")[0], "noun": F.split("canonical_id", "-")[1]})
    value = F.struct(F.lit("s").alias("supplier_id"), F.when(F.col("adj") == "hot", F.concat(F.lit("see ent_"), "noun")).otherwise(F.col("noun")).alias("note"))
    forms = F.map_from_arrays(F.array("adj"), F.array(F.array(F.struct(F.lit("base").alias("key"), F.when(F.col("noun") != "ring", value).alias("value")))))
    kept = F.array(F.struct(F.struct(F.length("noun").alias("margin"), F.array("trade_synonyms").alias("tags")).alias("inner")))
    plain = F.map_from_arrays(F.array(F.when(F.col("noun") == "gear", "provenance").otherwise(F.col("noun"))), F.array("canonical_id"))
    return audit.leaks(i.select("canonical_id", "common_names", forms.alias("forms"), kept.alias("rows"), plain.alias("plain")), FORBIDDEN, PRIVATE)


def limiter_busy_counter(spark: SparkSession, sf: str) -> DataFrame:
    """Ten transports, each with more events than one task is to fold: their windows are found by the way of busy keys."""
    e = table(spark, sf, "events").select("event_id", "ts", F.pmod("user_id", F.lit(10)).alias("transport"))
    return limiter.anchored_counter(e, "transport", limiter.HOUR, busy=100).select("event_id", "transport", "n")


QUERIES = {f.__name__: f for f in (ladder_select, reason_rules, message_build, candidate_assess, procurement_match, completeness_full_join, response_minimise, limiter_counter_anchored, limiter_distinct_set, limiter_chain, limiter_published, limiter_precheck, fanout_gauge, freshness_filter, fresh_stamps, canonical_message, request_signing, client_address, request_validation, procurement_validation, parity_guard, version_check, leakage_scan, limiter_busy_counter)}

# CRC-32 is no SQL function of the other engine: the cells' number comes from a table of the part brands and types.
_PH = "[" + ", ".join(f"'{p}'" for p in c.PHASES) + "]"


def _crc_table() -> str:
    """crc32 modulo 60 of every brand and type that can occur, as rows."""
    import zlib

    kinds = ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")
    return ", ".join(f"('Brand#{b}', '{t}', {zlib.crc32(f'Brand#{b}|{t}'.encode()) % 60})" for b in range(0, 60) for t in kinds)


_CELLS = f"""crc(b, t, k) AS (VALUES {_crc_table()}),
cells AS (SELECT p_brand AS product, p_type AS role, k, {_PH}[k % 6 + 1] AS phase, ['NND', 'DISP', 'MD', 'ASK'][k % 4 + 1] AS tag, ['1', '2', '4B', '5', '6'][k % 5 + 1] AS category,
  ['MP', 'RE', 'OE', 'SD'][1:k % 3] AS preferred, CASE WHEN k % 2 = 1 THEN ['OE'] ELSE [] END AS conditional, 'Use it for ' || lower(p_type) || ' goods.' AS rec, CASE WHEN k % 3 = 0 THEN 'use it for ' || lower(p_type) ELSE 'Grain size matters' END AS reason FROM (SELECT DISTINCT p_brand, p_type FROM part) JOIN crc ON b = p_brand AND t = p_type),
fmt AS (SELECT product, role, code, ['ok', 'warn', 'avoid', 'see text'][(k + 2 * i) % 4 + 1] AS tier, ['Dry-solid, water-soluble', 'Oil liquid', 'water-soluble', 'phase matched', 'unresolved'][(k + i) % 5 + 1] AS behaviour, CASE WHEN k % 2 = 0 THEN 'Check the grade of ' || code || '. Then ask.' END AS note
  FROM cells, (VALUES (0, 'MP'), (1, 'RE'), (2, 'OE'), (3, 'SD')) AS x(i, code) WHERE (k + i) % 4 <> 3),
pick AS (SELECT c.*, (SELECT first(f.code ORDER BY list_position(preferred, f.code)) FROM fmt f WHERE f.product = c.product AND f.role = c.role AND f.tier = 'ok' AND list_contains(preferred, f.code)) AS best FROM cells c),
sel AS (SELECT p.*, coalesce(best, conditional[1]) AS selected, CASE WHEN best IS NOT NULL THEN 'ok' WHEN len(conditional) > 0 THEN coalesce((SELECT f.tier FROM fmt f WHERE f.product = p.product AND f.role = p.role AND f.code = conditional[1]), 'warn') END AS tier FROM pick p)"""

_ORDERED = "ev AS (SELECT *, epoch_us(ts) AS t FROM events), o AS (SELECT event_id, user_id, user_id % 10 AS transport, event_type, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev)"


def _chain(limits: limiter.Limits, source: str, member: str, cell: str | None, code: str | None, challenge: bool = True) -> str:
    """The chain as one recursion for each check, over what the checks before it admit."""
    parts, steps, n = [f"a0 AS ({source})"], [], 0

    def check(name: str, keys: str, width: int, most: int, value: str | None) -> None:
        nonlocal n
        where = "" if value is None else f" WHERE {value} IS NOT NULL" + (f" AND {cell} IS NOT NULL" if "," in keys else "")
        on = " AND ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
        own = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
        start, more = ("1::BIGINT", "n + 1") if value is None else (f"[{value}]", f"list_distinct(list_append(n, o.{value}))")
        again = "1" if value is None else f"[o.{value}]"
        parts.append(f"o{n} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, event_id) AS k FROM a{n}{where})")
        parts.append(f"r{n} AS (SELECT {keys}, k, event_id, t AS s, {start} AS n FROM o{n} WHERE k = 1 UNION ALL SELECT {own}, o.k, o.event_id, CASE WHEN o.t - s >= {width} THEN o.t ELSE s END, CASE WHEN o.t - s >= {width} THEN {again} ELSE {more} END FROM r{n} r JOIN o{n} o ON {on} AND o.k = r.k + 1)")
        parts.append(f"x{n} AS (SELECT event_id FROM r{n} WHERE {'n' if value is None else 'len(n)'} > {most})")
        parts.append(f"a{n + 1} AS (SELECT * FROM a{n} WHERE event_id NOT IN (SELECT event_id FROM x{n}))")
        steps.append(f"SELECT event_id, '{name}' AS reason FROM x{n}")
        n += 1

    for name, width, most in limits.transport:
        check(name, "transport", width, most, None)
    for name, width, most in limits.counters:
        check(name, "user_id", width, most, None)
    if limits.members:
        check(limits.members[0], "user_id", limits.members[1], limits.members[2], member)
    if limits.cells and cell:
        check(limits.cells[0], "user_id", limits.cells[1], limits.cells[2], cell)
    if limits.formats and code:
        check(limits.formats[0], f"user_id, {cell}", limits.formats[1], limits.formats[2], code)
    last = ", reason IS NOT DISTINCT FROM 'enumeration' AS challenge" if challenge else ""
    return f"WITH RECURSIVE {', '.join(parts)} SELECT event_id, reason{last} FROM ({' UNION ALL '.join(steps)} UNION ALL SELECT event_id, NULL FROM a{n})"


_EV = "SELECT event_id, user_id, user_id % 10 AS transport, event_type, {t} AS t, CASE WHEN event_id % 9 <> 0 THEN (event_id % 7)::VARCHAR END AS cell, CASE WHEN event_id % 4 <> 0 THEN (event_id % 3)::VARCHAR END AS code, 'b' || event_id % 41 AS botanical, (event_id % 15)::VARCHAR AS wide_cell, (event_id % 5)::VARCHAR AS wide_code FROM events"
_SQUEEZED = _EV.format(t=f"epoch_us(ts) // {SQUEEZE}")


def _hmac(message: str, secret: bytes) -> str:
    """HMAC-SHA256 as hex, from two nested hashes over the padded key."""
    key = secret.ljust(64, b"\0")
    pad = lambda x: bytes(b ^ x for b in key).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({message}))))"


ORACLE_SQL = {
    "ladder_select": f"WITH {_CELLS} SELECT product, role, selected, tier, CASE WHEN selected IS NULL THEN 'none' WHEN tier = 'ok' THEN 'best' ELSE 'conditional' END AS fit FROM sel",
    "reason_rules": f"""WITH {_CELLS}, f AS (SELECT product, role, code, phase, tag, CASE behaviour WHEN 'Dry-solid, water-soluble' THEN 'dry' WHEN 'Oil liquid' THEN 'oil' WHEN 'water-soluble' THEN 'water' WHEN 'phase matched' THEN 'matched' END AS form FROM fmt JOIN cells USING (product, role))
      SELECT product, role, code, form, CASE WHEN phase = 'application-dependent' THEN 'varies' WHEN form IS NULL THEN 'confirm' WHEN phase = 'emulsion' THEN CASE form WHEN 'oil' THEN 'oil_phase' WHEN 'water' THEN 'water_phase' ELSE 'into_emulsion' END
        WHEN form = 'matched' OR (phase, form) IN (('dry-solid', 'dry'), ('aqueous', 'water'), ('oil', 'oil'), ('suspension-dispersion', 'water'), ('suspension-dispersion', 'dry')) THEN 'compatible' ELSE 'different' END AS phase_check,
      CASE WHEN phase = 'application-dependent' OR form IS NULL THEN 'variable' WHEN phase = 'dry-solid' AND form IN ('oil', 'water') THEN 'liquid_into_dry' WHEN phase = 'oil' AND form = 'water' THEN 'water_into_oil' WHEN phase IN ('aqueous', 'suspension-dispersion') AND form = 'oil' THEN 'oil_into_aqueous' ELSE 'sku' END AS process_check,
      CASE tag WHEN 'NND' THEN 'not_required' WHEN 'DISP' THEN 'dispersion' WHEN 'MD' THEN CASE phase WHEN 'application-dependent' THEN 'in_phase' WHEN 'dry-solid' THEN 'on_use' WHEN 'oil' THEN 'in_oil' WHEN 'emulsion' THEN 'in_continuous' ELSE 'in_aqueous' END ELSE 'confirm' END AS dissolution FROM f""",
    "message_build": f"WITH {_CELLS} SELECT product, role, category, CASE WHEN category = '5' THEN 'Only as guidance.' ELSE rec END AS body, CASE WHEN category = '1' THEN reason WHEN category IN ('2', '4B', '6') AND reason = 'Grain size matters' THEN reason END AS why FROM cells",
    "candidate_assess": f"""WITH {_CELLS} SELECT c.product, c.role, a.code, CASE WHEN a.code = 'SE' OR f.tier IS NULL THEN 'neutral' WHEN f.tier IN ('ok', 'warn') THEN f.tier ELSE 'avoid' END AS severity,
      CASE WHEN a.code = 'SE' THEN 'review' WHEN f.tier IS NULL THEN 'not_evaluated' WHEN f.tier = 'ok' THEN 'best' WHEN f.tier = 'warn' THEN 'conditional' ELSE 'unsuitable' END AS status,
      CASE WHEN a.code = 'SE' THEN 'overlay_not_a_format' WHEN f.tier IS NULL THEN 'not_evaluated_for_role' WHEN f.note IS NOT NULL THEN 'Check the grade of ' || a.code || '.' ELSE 'default_' || CASE WHEN f.tier IN ('ok', 'warn') THEN f.tier ELSE 'avoid' END END AS explanation
      FROM cells c, (VALUES ('MP'), ('RE'), ('OE'), ('SD'), ('SE')) AS a(code) LEFT JOIN fmt f ON f.product = c.product AND f.role = c.role AND f.code = a.code""",
    "procurement_match": f"""WITH {q.IDENTITIES}, {q.TITLES}, {q.TYPES}, stock AS (SELECT replace(p_name, ' ', '-') AS canonical_id, list(DISTINCT base) AS have FROM titled JOIN tmap ON p_type = map_type WHERE p_name NOT LIKE 'red %' GROUP BY 1), t AS (SELECT canonical_id, unnest(['MP', 'SD']) AS target FROM ident)
      SELECT canonical_id, target, CASE WHEN list_contains(have, target) THEN 'exact_match' WHEN have IS NOT NULL THEN 'compatible_alternative' ELSE 'ask_us_to_source' END AS match_class, CASE WHEN list_contains(have, target) THEN 'catalogue' WHEN have IS NOT NULL THEN 'catalogue_alternative' ELSE 'request_sourcing' END AS route FROM t LEFT JOIN stock USING (canonical_id)""",
    "completeness_full_join": f"WITH {_CELLS} SELECT product, role, 'missing_message' AS problem FROM cells WHERE k % 7 = 0 UNION ALL SELECT product || 'x', role, 'orphan_message' FROM cells WHERE k = 14",
    "response_minimise": f"WITH {_CELLS} SELECT product, role, category, selected, CASE WHEN k % 2 = 0 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN category = '1' AND selected IS NOT NULL THEN 'r' END AS reasoning, CASE WHEN category = '1' AND selected IS NOT NULL AND k % 2 = 0 THEN 't' END AS token FROM sel",
    "limiter_counter_anchored": f"WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, k, event_id, t AS s, 1::BIGINT AS n FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.t - s >= {limiter.DAY} THEN o.t ELSE s END, CASE WHEN o.t - s >= {limiter.DAY} THEN 1 ELSE n + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT event_id, n, n <= 3 AS ok FROM r",
    "limiter_distinct_set": f"WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, k, event_id, t AS s, [event_type] AS m FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.t - s >= {5 * limiter.DAY} THEN o.t ELSE s END, CASE WHEN o.t - s >= {5 * limiter.DAY} THEN [o.event_type] ELSE list_distinct(list_append(m, o.event_type)) END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT event_id, len(m) AS size FROM r",
    "limiter_chain": _chain(LIMITS, _EV.format(t="epoch_us(ts)"), "event_type", "cell", "code"),
    "limiter_published": _chain(limiter.Limits(), _SQUEEZED, "botanical", "wide_cell", "wide_code"),
    "limiter_precheck": _chain(limiter.PRE_CHECK, _SQUEEZED, "botanical", None, None, challenge=False),
    "fanout_gauge": "WITH f AS (SELECT event_id, user_id % 10 AS transport, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first_ FROM events) SELECT event_id, transport, sum(first_::INT) OVER (PARTITION BY transport ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS n_keys FROM f",
    "limiter_busy_counter": f"WITH RECURSIVE {_ORDERED.replace('PARTITION BY user_id', 'PARTITION BY user_id % 10')}, r AS (SELECT transport, k, event_id, t AS s, 1::BIGINT AS n FROM o WHERE k = 1 UNION ALL SELECT o.transport, o.k, o.event_id, CASE WHEN o.t - s >= {limiter.HOUR} THEN o.t ELSE s END, CASE WHEN o.t - s >= {limiter.HOUR} THEN 1 ELSE n + 1 END FROM r JOIN o ON o.transport = r.transport AND o.k = r.k + 1) SELECT event_id, transport, n FROM r",
    "leakage_scan": f"""WITH {q.IDENTITIES}, i AS (SELECT ident.*, adj, noun FROM ident JOIN names ON canonical_id = adj || '-' || noun),
      p AS (SELECT canonical_id, json_object('canonical_id', canonical_id, 'common_names', common_names, 'forms', json_object(adj, json_array(json_object('key', 'base', 'value', CASE WHEN noun <> 'ring' THEN json_object('supplier_id', 's', 'note', CASE WHEN adj = 'hot' THEN 'see ent_' || noun ELSE noun END) END))),
        'rows', json_array(json_object('inner', json_object('margin', length(noun), 'tags', [trade_synonyms]))), 'plain', json_object(CASE WHEN noun = 'gear' THEN 'provenance' ELSE noun END, canonical_id)) AS j FROM i),
      t AS (SELECT canonical_id, x.key, x.type, x.atom, regexp_replace(x.fullkey[3:], '\\[[0-9]+\\]', '[]', 'g') AS fk FROM p, json_tree(p.j) AS x),
      h AS (SELECT canonical_id, regexp_replace(fk, '^forms\\.[a-z]+', 'forms.*') AS path, 'key' AS what FROM t WHERE key IN ('supplier_id', 'margin', 'provenance')
        UNION ALL SELECT canonical_id, regexp_replace(fk, '^(forms|plain)\\.[a-z]+', '\\1.*'), 'value' FROM t WHERE type = 'VARCHAR' AND regexp_matches(atom::VARCHAR, '(?i)azure|\\bent_[a-z0-9]'))
      SELECT path, what, count(DISTINCT canonical_id) AS n FROM h GROUP BY path, what""",
    "freshness_filter": "SELECT event_id FROM events WHERE abs(event_id % 200 - 100) <= 60",
    "fresh_stamps": """WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS now, event_id % 9 AS k FROM events), s AS (SELECT *, CASE WHEN k < 6 THEN (now + [0, 60, -60, 61, -61, 3][k + 1])::VARCHAR WHEN k = 6 THEN '12:00' WHEN k = 7 THEN '' END AS stamp FROM e)
      SELECT event_id, coalesce(abs(now - try_cast(stamp AS DOUBLE)) <= 60, false) AS fresh FROM s""",
    "canonical_message": "SELECT event_id, 'kind=' || event_type || ',xuser=' || user_id AS message FROM events",
    "client_address": r"""WITH e AS (SELECT event_id, event_id % 300 AS n, event_id % 9 AS k FROM events), h AS (SELECT event_id, CASE k WHEN 0 THEN '10.0.0.' || n WHEN 1 THEN '10.0.1.' || n WHEN 3 THEN '::ffff:1.2.3.' || n WHEN 4 THEN '2001:db8::' || lower(to_hex(n)) WHEN 5 THEN '01.02.03.04' WHEN 6 THEN 'junk' WHEN 7 THEN '192.168.0.9' WHEN 8 THEN '1:2:3:4:5:6:7' || CASE WHEN event_id % 2 = 0 THEN ':8' ELSE '' END END AS hop FROM e),
      o AS (SELECT *, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])' AS q FROM h)
      SELECT event_id, CASE WHEN regexp_full_match(hop, q || '(\.' || q || '){3}') OR (hop LIKE '::ffff:%' AND regexp_full_match(hop[8:], q || '(\.' || q || '){3}')) OR (NOT contains(hop, '.') AND regexp_full_match(hop, '([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|2001:db8::[0-9a-f]{1,4}')) THEN hop ELSE '192.168.0.9' END AS ip FROM o""",
    "request_signing": f"""WITH e AS (SELECT event_id, event_type, event_id % 8 AS k, event_id % 500 AS d FROM events) SELECT event_id, {_hmac('event_type', b'key')} AS hmac, CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'bad_signature' WHEN 3 THEN 'bad_token_version' WHEN 4 THEN 'malformed' WHEN 5 THEN 'bad_expiry' WHEN 6 THEN CASE WHEN 100 > event_id % 80 + 60 THEN 'iat_in_future' END
      WHEN 7 THEN CASE WHEN d > 361 THEN 'expired' ELSE 'ttl_too_long' END WHEN 0 THEN CASE WHEN d > 360 THEN 'expired' END END AS reason FROM e""",
    "request_validation": r"""WITH r AS (SELECT p_partkey, p_size AS s, p_brand, p_type, CASE WHEN p_size IN (2, 9) THEN ' ' WHEN p_size = 3 THEN repeat(p_name, 20) ELSE p_name END AS botanical, CASE WHEN p_size IN (7, 9) THEN 'a b' WHEN p_size > 40 THEN repeat('x', 2 * p_size - 20) END AS session FROM part)
      SELECT p_partkey, CASE WHEN s = 8 THEN 'bad_body' WHEN s = 1 THEN 'unexpected_field' WHEN s = 4 THEN 'missing_product_role' WHEN trim(botanical) = '' OR length(botanical) > 80 THEN 'bad_botanical' WHEN NOT regexp_full_match(session, '[A-Za-z0-9_-]{1,64}') THEN 'bad_session' WHEN s IN (5, 10) THEN 'bad_candidate_format' WHEN s = 6 THEN 'unknown_product_role' END AS reason FROM r""",
    "procurement_validation": r"""WITH r AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size IN (7, 9) THEN 'a b' WHEN p_size > 40 THEN repeat('x', 2 * p_size - 20) END AS session FROM part)
      SELECT p_partkey, CASE WHEN s = 8 THEN 'bad_body' WHEN s = 1 THEN 'unexpected_field' WHEN s IN (2, 9) THEN 'missing_token' WHEN NOT regexp_full_match(session, '[A-Za-z0-9_-]{1,64}') THEN 'bad_session' END AS reason FROM r""",
    "parity_guard": "SELECT p_partkey FROM part WHERE p_partkey % 50 = 0 OR p_partkey % 77 = 0",
    "version_check": "SELECT coalesce(first(n_name ORDER BY n_nationkey) FILTER (WHERE n_nationkey >= 7), 'ok') AS first_mismatch, count(*) FILTER (WHERE n_nationkey >= 7) AS n_mismatches FROM nation",
}
