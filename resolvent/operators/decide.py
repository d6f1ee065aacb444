"""The decision layer: ladders, rule checks, messages, candidate assessment and procurement, as codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, adds_information, first_sentence, squeeze


def select_ladder(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """``cells(product, role, preferred, conditional, ...)`` and ``formats(product, role, code, tier)``: the first preferred
    code whose tier is ok, else the first conditional one; adds ``selected, tier, fit``."""
    tiers = formats.groupBy("product", "role").agg(F.map_from_entries(F.collect_list(F.struct("code", "tier"))).alias("_tiers"))
    j = cells.join(tiers, ["product", "role"], "left")
    best = F.get(F.filter("preferred", lambda c: F.try_element_at(F.col("_tiers"), c) == "ok"), F.lit(0))
    selected = F.coalesce(best, F.get("conditional", F.lit(0)))
    tier = F.when(best.isNotNull(), "ok").when(selected.isNotNull(), F.coalesce(F.try_element_at(F.col("_tiers"), selected), F.lit("warn")))
    fit = F.when(selected.isNull(), "none").when(tier == "ok", "best").otherwise("conditional")
    return j.withColumn("selected", selected).withColumn("tier", tier).withColumn("fit", fit).drop("_tiers")


def form_physical(behaviour: Column | str) -> Column:
    """Physical form of a format: dry, matched, oil, water or null; dry is tested before solubility."""
    b = F.lower(F.coalesce(_col(behaviour), F.lit("")))
    has = lambda *w: _any([F.contains(b, F.lit(x)) for x in w])
    return F.when(has("unresolved", "per row text"), None).when(has("dry-solid", "coarse", "whole", "dried"), "dry").when(has("dual", "matched"), "matched").when(has("oil"), "oil").when(has("water-soluble", "dispersible"), "water")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def phase_check(phase: Column, form: Column) -> Column:
    """compatible, different, confirm, varies, into_emulsion, water_phase or oil_phase."""
    return (
        F.when(phase == "application-dependent", "varies").when(form.isNull(), "confirm")
        .when(phase == "emulsion", F.when(form == "oil", "oil_phase").when(form == "water", "water_phase").otherwise("into_emulsion"))
        .when(form == "matched", "compatible")
        .when((phase == "dry-solid") & (form == "dry") | (phase == "aqueous") & (form == "water") | (phase == "suspension-dispersion") & form.isin("water", "dry") | (phase == "oil") & (form == "oil"), "compatible")
        .otherwise("different")
    )


def process_check(phase: Column, form: Column) -> Column:
    """variable, sku, liquid_into_dry, water_into_oil or oil_into_aqueous; an emulsion never crosses."""
    return (
        F.when((phase == "application-dependent") | form.isNull(), "variable")
        .when((phase == "dry-solid") & form.isin("oil", "water"), "liquid_into_dry").when((phase == "oil") & (form == "water"), "water_into_oil")
        .when(phase.isin("aqueous", "suspension-dispersion") & (form == "oil"), "oil_into_aqueous").otherwise("sku")
    )


def dissolution_check(tag: Column, phase: Column) -> Column:
    """not_required, dispersion, in_phase, on_use, in_<noun> or confirm."""
    noun = F.when(phase == "oil", "in_oil").when(phase == "emulsion", "in_continuous").otherwise("in_aqueous")
    return F.when(tag == "NND", "not_required").when(tag == "DISP", "dispersion").when(tag == "MD", F.when(phase == "application-dependent", "in_phase").when(phase == "dry-solid", "on_use").otherwise(noun)).otherwise("confirm")


def build_message(category: Column, stored: Column, authored: Column, reason: Column) -> Column:
    """Struct of ``body`` and ``why``: category 5 has an authored body and no reason; 1 always its reason; 2, 4B and 6 only
    one that adds information."""
    body, why = F.when(category == "5", squeeze(authored)).otherwise(squeeze(stored)), F.nullif(squeeze(reason), F.lit(""))
    return F.struct(body.alias("body"), F.when(category == "1", why).when(category.isin("2", "4B", "6") & adds_information(reason, body), why).alias("why"))


def assess_candidate(code: Column, tier: Column, note: Column) -> Column:
    """Struct of ``severity, status, explanation``; an absent format is not evaluated, which is no negative verdict."""
    severity = F.when(code == "SE", "neutral").when(tier.isNull(), "neutral").when(tier.isin("ok", "warn"), tier).otherwise("avoid")
    status = F.when(code == "SE", "review").when(tier.isNull(), "not_evaluated").when(tier == "ok", "best").when(tier == "warn", "conditional").otherwise("unsuitable")
    text = F.when(code == "SE", "overlay_not_a_format").when(tier.isNull(), "not_evaluated_for_role").otherwise(F.coalesce(F.nullif(first_sentence(note), F.lit("")), F.concat(F.lit("default_"), severity)))
    return F.struct(severity.alias("severity"), status.alias("status"), text.alias("explanation"))


def one_caveat(status: Column, selected: Column, note: Column) -> Column:
    """A single caveat: by the identity's status, else the first sentence of the selected format's note."""
    return F.when(status == "ambiguous", "ambiguous_name").when(status == "unrecognised", "unknown_name").when(selected.isNull(), "no_suitable_format").otherwise(F.coalesce(F.nullif(first_sentence(note), F.lit("")), F.lit("confirm_sku")))


def procurement(targets: DataFrame, stock: DataFrame) -> DataFrame:
    """``targets(canonical_id, target)`` against ``stock(canonical_id, base)``: exact_match, compatible_alternative or
    ask_us_to_source, with the sourcing route."""
    have = stock.groupBy("canonical_id").agg(F.array_sort(F.collect_set("base")).alias("available"))
    j = targets.join(have, "canonical_id", "left")
    exact = F.coalesce(F.array_contains("available", F.col("target")), F.lit(False))
    match = F.when(exact, "exact_match").when(F.coalesce(F.size("available"), F.lit(0)) > 0, "compatible_alternative").otherwise("ask_us_to_source")
    route = F.when(exact, "catalogue").when(F.coalesce(F.size("available"), F.lit(0)) > 0, "catalogue_alternative").otherwise("request_sourcing")
    return j.withColumn("match_class", match).withColumn("route", route)


def completeness(cells: DataFrame, messages: DataFrame, keys: tuple[str, ...] = ("product", "role")) -> DataFrame:
    """Cells without a message and messages without a cell."""
    a, b = cells.select(*keys).distinct().withColumn("_c", F.lit(True)), messages.select(*keys).distinct().withColumn("_m", F.lit(True))
    j = a.join(b, list(keys), "full_outer")
    return j.where("_c is null or _m is null").select(*keys, F.when(F.col("_c").isNull(), "orphan_message").otherwise("missing_message").alias("problem"))


def check_complete(cells: DataFrame, messages: DataFrame) -> None:
    if not completeness(cells, messages).isEmpty():
        raise ValueError("cells and messages do not cover each other")


def minimise(response: DataFrame) -> DataFrame:
    """``response(category, selected, status, reasoning, token)``: reasoning only for category 1 with a selected format, the
    token only if the identity is resolved as well."""
    open_ = (F.col("category") == "1") & F.col("selected").isNotNull()
    return response.withColumn("reasoning", F.when(open_, F.col("reasoning"))).withColumn("token", F.when(open_ & (F.col("status") == "resolved"), F.col("token")))
