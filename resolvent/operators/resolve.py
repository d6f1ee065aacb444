"""The four resolvers.  They differ in candidates, order and ambiguity, and stay apart on purpose.

Each takes distinct inputs once: candidates are exploded with their position, joined to the indices by key, and
one partial aggregation per input picks by its policy.  Ambiguity is data: no id, but the candidate ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT, Vocabulary, ngram_candidates, norm, serving_candidates, title_candidates


def _hits(inputs: DataFrame, keys: list[str], cands: Column, exact: DataFrame, common: DataFrame) -> DataFrame:
    rows = inputs.select(*keys).distinct().select(*keys, F.posexplode(cands).alias("pos", "cand")).withColumn("key", norm("cand")).where("key <> ''")
    found = rows.join(exact, "key", "left").join(common, "key", "left")
    return found.where("method is not null or cids is not null").withColumn("n_ids", F.coalesce(F.size("cids"), F.lit(0)))


def _finish(inputs: DataFrame, keys: list[str], grouped: DataFrame, cid: Column, method: Column, ids: Column, **more: Column) -> DataFrame:
    picked = grouped.select(*[F.col(k).alias(f"_{k}") for k in keys], cid.alias("canonical_id"), method.alias("match_method"), ids.alias("candidates"), *[c.alias(k) for k, c in more.items()])
    every = inputs.select(*keys).distinct()
    same = None
    for k in keys:
        c = every[k].eqNullSafe(picked[f"_{k}"])
        same = c if same is None else same & c
    out = every.join(picked, same, "left")
    return out.select(*keys, "canonical_id", F.coalesce("match_method", F.lit("unresolved")).alias("match_method"), "candidates", *more)


def resolve_serving(inputs: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``inputs(latin, label)``: candidate by candidate, exact before common; the first hit decides, ambiguous or not, and is
    given as ``matched``."""
    keys = ["latin", "label"]
    hits = _hits(inputs, keys, serving_candidates("latin", "label", v), exact, common)
    first = hits.groupBy(*keys).agg(F.min_by(F.struct("canonical_id", "method", "cids", "n_ids", "cand"), "pos").alias("h"))
    sure = F.col("h.method").isNotNull()
    one = F.col("h.n_ids") == 1
    cid = F.when(sure, F.col("h.canonical_id")).when(one, F.get("h.cids", F.lit(0)))
    method = F.when(sure, F.col("h.method")).when(one, "common_name_exact_unique").otherwise("ambiguous")
    return _finish(inputs, keys, first, cid, method, F.when(~sure & ~one, F.col("h.cids")), matched=F.col("h.cand"))


def resolve_catalogue(inputs: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``inputs(title)``: all exact hits first, the lowest rank and then the earliest wins; else the one id that unique
    common names give; several, or only ambiguous names, are ambiguous."""
    hits = _hits(inputs, ["title"], title_candidates("title", v), exact, common)
    g = hits.groupBy("title").agg(
        F.expr("min_by(struct(canonical_id, method), struct(rank, pos)) FILTER (WHERE method IS NOT NULL)").alias("e"),
        F.expr("array_sort(collect_set(cids[0]) FILTER (WHERE n_ids = 1))").alias("u"),
        F.expr("min_by(cids, pos) FILTER (WHERE n_ids > 1)").alias("m"),
    )
    sure, n = F.col("e").isNotNull(), F.size("u")
    cid = F.when(sure, F.col("e.canonical_id")).when(n == 1, F.get("u", F.lit(0)))
    method = F.when(sure, F.col("e.method")).when(n == 1, "common_name_exact_unique").otherwise("ambiguous_exact")
    return _finish(inputs, ["title"], g, cid, method, F.when(~sure & (n > 1), F.col("u")).when(~sure & (n == 0), F.col("m")))


def resolve_ingest(inputs: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``inputs(latin, label)``: the earliest exact candidate; else the single id of unique common names; several, or an
    ambiguous name (the last one's ids), are ambiguous."""
    keys = ["latin", "label"]
    hits = _hits(inputs, keys, serving_candidates("latin", "label", v, full_label=False), exact, common)
    g = hits.groupBy(*keys).agg(
        F.expr("min_by(struct(canonical_id, method), pos) FILTER (WHERE method IS NOT NULL)").alias("e"),
        F.expr("array_sort(collect_set(cids[0]) FILTER (WHERE n_ids = 1))").alias("u"),
        F.expr("max_by(cids, pos) FILTER (WHERE n_ids > 1)").alias("m"),
    )
    sure, n = F.col("e").isNotNull(), F.size("u")
    cid = F.when(sure, F.col("e.canonical_id")).when(n == 1, F.get("u", F.lit(0)))
    method = F.when(sure, F.col("e.method")).when(n == 1, "common_name_exact_unique").otherwise("ambiguous")
    return _finish(inputs, keys, g, cid, method, F.when(~sure & (n > 1), F.col("u")).when(~sure & (n == 0), F.col("m")))


def resolve_longest(inputs: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``inputs(title)``: of all exact and unique common hits the one with the most words, exact before common, then the
    earliest; ``shortest`` is the id that the fewest words would give; ambiguous only without any such hit."""
    hits = _hits(inputs, ["title"], ngram_candidates("title", v), exact, common).withColumn("nt", F.size(F.split("key", " ")))
    hit = F.struct(F.coalesce("canonical_id", F.get("cids", F.lit(0))).alias("cid"), F.coalesce("method", F.lit("common_name_exact_unique")).alias("how"))
    rows = hits.withColumn("ok", F.col("method").isNotNull() | (F.col("n_ids") == 1)).withColumn("hit", hit).withColumn("kind", F.col("method").isNotNull().cast("int"))
    g = rows.groupBy("title").agg(
        F.expr("min_by(hit, struct(-nt, -kind, pos)) FILTER (WHERE ok)").alias("e"),
        F.expr("min_by(hit, struct(nt, -kind, pos)) FILTER (WHERE ok)").alias("s"),
        F.expr("min_by(cids, struct(-nt, pos)) FILTER (WHERE NOT ok)").alias("m"),
    )
    sure = F.col("e").isNotNull()
    return _finish(inputs, ["title"], g, F.col("e.cid"), F.when(sure, F.col("e.how")).otherwise("ambiguous"), F.when(~sure, F.col("m")), shortest=F.col("s.cid"))


def status_of(canonical_id: Column, method: Column) -> Column:
    """Public status: resolved, ambiguous or unrecognised."""
    return F.when(canonical_id.isNotNull(), "resolved").when(method.startswith("ambiguous"), "ambiguous").otherwise("unrecognised")


def display_names(identities: DataFrame, overrides: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``(canonical_id, display_name)``: an override, else the most frequent stripped common name (ties: the shorter, then
    the first), else the display or accepted name."""
    from ..functions.text import part_strip, squeeze

    base = identities.select("canonical_id", F.posexplode("common_names").alias("ord", "c")).withColumn("base", squeeze(part_strip("c", v))).where("length(base) >= 3").withColumn("k", norm("base"))
    counted = base.groupBy("canonical_id", "k").agg(F.count("*").alias("n"), F.min_by("base", "ord").alias("sample"), F.min("ord").alias("ord"))
    best = counted.groupBy("canonical_id").agg(F.min_by(F.struct("k", "sample"), F.struct(-F.col("n"), F.length("sample"), "ord")).alias("b"))
    same = base.withColumn("raw", norm("c")).groupBy("canonical_id", "raw").agg(F.min_by("c", "ord").alias("exact_name"))
    named = best.select("canonical_id", "b.k", "b.sample").join(same.withColumnRenamed("raw", "k"), ["canonical_id", "k"], "left")
    out = identities.select("canonical_id", "accepted_name").join(overrides, "canonical_id", "left").join(named, "canonical_id", "left")
    return out.select("canonical_id", F.coalesce("override", "exact_name", "sample", "accepted_name").alias("display_name"))
