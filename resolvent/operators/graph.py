"""Catalogue aggregation: mapped rows, supplier gates and the graph of observed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rate
from ..session import cut_lineage

#: Least share of resolved and of mapped rows that lets a supplier's rows into the graph.
IDENTITY_FLOOR, TAXONOMY_FLOOR = 0.70, 0.80


def map_types(rows: DataFrame, type_map: DataFrame, out_of_scope: DataFrame, type_col: str = "type") -> DataFrame:
    """Adds the type map's columns and ``scope``: mapped, out_of_scope (the type has a listed substring) or in_scope_gap.

    Rows without a type are left out.  The substring test runs once per distinct unmapped type, not per row.
    """
    kept = rows.where(F.trim(F.coalesce(type_col, F.lit(""))) != "")
    kinds = kept.select(F.col(type_col).alias("_kind")).distinct()
    outside = kinds.join(F.broadcast(out_of_scope.agg(F.collect_set(F.lower("substr")).alias("_subs")))).where(F.exists("_subs", lambda s: F.contains(F.lower(F.col("_kind")), s))).select("_kind", F.lit(True).alias("_out"))
    joined = kept.join(type_map.withColumn("_mapped", F.lit(True)), kept[type_col] == type_map["map_type"], "left").join(outside, F.col(type_col) == F.col("_kind"), "left")
    scope = F.when(F.col("_mapped"), "mapped").when(F.col("_out"), "out_of_scope").otherwise("in_scope_gap")
    return joined.withColumn("scope", scope).drop("_mapped", "_out", "_kind", "map_type")


def supplier_metrics(rows: DataFrame, supplier: str = "supplier_id") -> DataFrame:
    """Per supplier: rows, mapped, gap, out of scope, resolved, both rates and whether the gate passes.

    ``rows(supplier, scope, canonical_id)``; an empty denominator is 1.0 for taxonomy and 0.0 for identity."""
    count = lambda c: F.count_if(c)
    scope = F.col("scope")
    out = rows.groupBy(supplier).agg(
        F.count("*").alias("n_rows"), count(scope == "mapped").alias("n_mapped"), count(scope == "in_scope_gap").alias("n_gap"),
        count(scope == "out_of_scope").alias("n_out"), count((scope == "mapped") & F.col("canonical_id").isNotNull()).alias("n_resolved"),
    )
    out = out.withColumn("taxonomy_rate", rate(F.col("n_mapped"), F.col("n_mapped") + F.col("n_gap"), 1.0)).withColumn("identity_rate", rate(F.col("n_resolved"), F.col("n_mapped"), 0.0))
    exact = F.coalesce(F.try_divide("n_mapped", F.col("n_mapped") + F.col("n_gap")), F.lit(1.0)) >= TAXONOMY_FLOOR
    return out.withColumn("passes", exact & (F.coalesce(F.try_divide("n_resolved", "n_mapped"), F.lit(0.0)) >= IDENTITY_FLOOR))


def gate(rows: DataFrame, metrics: DataFrame, supplier: str = "supplier_id") -> DataFrame:
    """Rows of suppliers that pass; the metrics keep those that do not."""
    return rows.join(metrics.where("passes").select(supplier), supplier, "left_semi")


FORM_KEY = ("canonical_id", "part", "base", "overlays")


def collapse(observations: DataFrame, entity: str = "entity_id") -> DataFrame:
    """One row per entity and form with ``n`` observations; ``n - 1`` of them are collapsed duplicates."""
    return observations.groupBy(entity, *FORM_KEY).agg(F.count("*").alias("n"))


def form_graph(observations: DataFrame, family: str, entity: str = "entity_id") -> DataFrame:
    """Per identity, part and form: observations, entities and independent families.  Rows are counted per entity first."""
    per = observations.groupBy(entity, family, *FORM_KEY).agg(F.count("*").alias("n"))
    return per.groupBy(*FORM_KEY).agg(F.sum("n").alias("n_observations"), F.count_distinct(entity).alias("n_entities"), F.count_distinct(family).alias("n_families"))


def nested_graph(long: DataFrame) -> DataFrame:
    """The long graph as ``(canonical_id, parts MAP<part, MAP<signature, counts>>)``."""
    sig = F.concat_ws("+", "base", F.when(F.col("overlays") != "", F.col("overlays")))
    inner = long.groupBy("canonical_id", "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(sig.alias("key"), F.struct("base", "overlays", "n_entities", "n_families").alias("value"))))).alias("forms"))
    return inner.groupBy("canonical_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", F.map_entries("forms").alias("forms"))))).alias("parts"))


def conflicts(observations: DataFrame) -> DataFrame:
    """``(raw, n_ids)`` of raw strings that were resolved to more than one identity; a pair counts once, before the shuffle."""
    return conflict_rows(observations).groupBy("raw").agg(F.count("*").alias("n_ids"))


def conflict_rows(observations: DataFrame) -> DataFrame:
    """``(raw, canonical_id)``: the identities of such strings, a row for each."""
    pairs = observations.where("canonical_id is not null").select("raw", "canonical_id").distinct()
    wide = pairs.groupBy("raw").agg(F.min("canonical_id").alias("a"), F.max("canonical_id").alias("b")).where("a <> b").select("raw")
    return pairs.join(wide, "raw", "left_semi")


def near_duplicates(keys: DataFrame) -> DataFrame:
    """``keys(genus, species)`` -> pairs ``a < b`` of one genus whose species differ by one edit.

    Pairs meet on the genus and on a shared neighbourhood key (the species with one character left out, or whole), never
    all with all: two species within one edit share such a key.
    """
    base = keys.select("genus", "species").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("species")), lambda i: F.concat(F.substr("species", F.lit(1), i - 1), F.substr("species", i + 1)))
    near = base.select("genus", "species", F.explode(F.array_distinct(F.concat(F.array("species"), F.when(F.length("species") > 0, cut).otherwise(F.array().cast("array<string>"))))).alias("k"))
    pairs = near.select("genus", "k", F.col("species").alias("a")).join(near.select("genus", "k", F.col("species").alias("b")), ["genus", "k"]).where("a < b")
    return pairs.select("genus", "a", "b").distinct().where(F.levenshtein("a", "b", 1) >= 0)


def top_cohort(counts: DataFrame, n: int = 50, count: str = "n", key: str = "key") -> DataFrame:
    """The n largest by count, then key: a report whose size is the feature."""
    return counts.orderBy(F.desc(count), F.asc(key)).limit(n)


def truncated(rows: DataFrame, value: Column, shown: int) -> DataFrame:
    """One row: total, the first ``shown`` values in order, and whether there are more."""
    top = rows.select(value.alias("v")).orderBy("v").limit(shown)
    return rows.agg(F.count("*").alias("total")).join(top.agg(F.array_sort(F.collect_list("v")).alias("shown"))).withColumn("truncated", F.col("total") > shown)


def first_examples(rows: DataFrame, key: str, ord_col: str, value: str, n: int = 3) -> DataFrame:
    """At most n examples per key in arrival order, each key pre-aggregated to its n smallest by a bounded top-k."""
    from pyspark.sql import Window

    ranked = rows.select(key, ord_col, value, F.row_number().over(Window.partitionBy(key).orderBy(ord_col)).alias("_k")).where(F.col("_k") <= n)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, value))), lambda s: s[value]).alias("examples"))


def promote_types(rows: DataFrame, key: str = "key") -> DataFrame:
    """``rows(key, ord, is_latin, text)``: a group is latin once any member is; its text is the first latin one, else the first."""
    g = rows.groupBy(key).agg(F.max("is_latin").alias("latin"), F.min_by("text", F.struct(~F.col("is_latin"), "ord")).alias("text"), F.count("*").alias("n"))
    return g.select(key, F.when(F.col("latin"), "latin").otherwise("common_only").alias("kind"), "text", "n")


#: Most brackets of ``percentile_floor`` that are broadcast, some 100 bytes each.
SENT = 100_000


def percentile_floor(rows: DataFrame, key: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Per key the value at sorted index floor(p n), capped at the last: an exact order statistic.

    A sketch of fixed size brackets each share by its error bound; only what lies inside the bracket, counted per value, is
    ranked, about 6 / ``accuracy`` of a key's rows at most, and what lies below is only counted.  The brackets, a row for each
    key and share, are counted; up to ``SENT`` of them go to every task, which then filters its own rows, and more are joined.
    Raises if a bracket misses its rank.
    """
    from pyspark.sql import Window

    kept = rows.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("_v"))
    room = 3 / accuracy
    ends = sorted({min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-room, room)})
    at = F.percentile_approx("_v", [float(e) for e in ends], accuracy)
    marks = kept.groupBy(key).agg(F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), at.alias("_q"))
    edge = lambda p, d: F.col("_min" if p + d <= 0 else "_max") if not 0 < p + d < 1 else F.col("_q")[ends.index(p + d)]
    spans = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.col("n"), F.floor(F.col("n") * p) + 1).alias("rank"), edge(p, -room).alias("lo"), edge(p, room).alias("hi")) for name, p in shares.items()])
    wanted = cut_lineage(marks.select(key, "n", F.inline(spans)))
    j = kept.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, key).where("_v <= hi")
    inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))
    counts = j.groupBy(key, "n", "name", "rank", inside.alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key, "name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_to", F.sum("c").over(upto))
    hit = run.groupBy(key, "n").agg(*[F.min(F.when((F.col("name") == name) & (F.col("_to") >= F.col("rank")) & F.col("v").isNotNull(), F.col("v"))).alias(name) for name in shares], F.max(F.col("v").isNull() & (F.col("_to") >= F.col("rank"))).alias("_missed"))
    checked = hit.where(F.when(F.col("_missed") | F.expr(" or ".join(f"`{n}` is null" for n in shares)), F.raise_error(F.lit("a bracket misses its rank"))).otherwise(F.lit(True)))
    return checked.drop("_missed")


def storefront(graph: DataFrame, fields: tuple[str, ...] = ("base", "overlays", "status")) -> DataFrame:
    """A nested graph ``(canonical_id, parts MAP<part, ARRAY<{key, value}>>)`` with only the allowed fields of every form."""
    kind = graph.schema["parts"].dataType.valueType.elementType["value"].dataType
    keep = [f for f in fields if f in kind.fieldNames()]
    slim = lambda e: F.struct(e["key"].alias("key"), F.struct(*[e["value"][f].alias(f) for f in keep]).alias("value"))
    return graph.select(*[c for c in graph.columns if c != "parts"], F.transform_values("parts", lambda _, forms: F.transform(forms, slim)).alias("parts"))


def observed_ladder(preferred: Column, observed: Column) -> Column:
    """The preferred codes that were observed, in the ladder's order."""
    return F.filter(preferred, lambda c: F.coalesce(F.array_contains(observed, c), F.lit(False)))


def references(counts: Column) -> Column:
    """Sum of a map's values: how often something is referred to."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)
