"""Supplier rows to resolved, normalised rows with their metrics, queues and candidates for the backbone."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.text import DEFAULT, Vocabulary, _col, _words, clean_label, ngram_binomials, ngram_core, norm, plant_part_anywhere, rate, squeeze
from .graph import first_examples, promote_types
from .resolve import resolve_ingest, resolve_longest


class Ingest(NamedTuple):
    """``rows`` is the base; the other frames are filters and aggregates of it."""

    rows: DataFrame
    review: DataFrame
    unresolved: DataFrame
    repairs: DataFrame
    metrics: DataFrame


def ingest(raw: DataFrame, exact: DataFrame, common: DataFrame, genera: DataFrame, base: str = "RE", v: Vocabulary = DEFAULT) -> Ingest:
    """``raw(supplier_id, row_no, label, latin, part_text, assay_raw)`` -> resolved rows and what follows from them.

    Rows without a label are left out.  A given scientific name is repaired, else one is looked for in the label; names are
    resolved once each.  A row may go to several queues: ambiguous ones and those with review flags to ``review``, those that
    nothing resolves to ``unresolved``.
    """
    labelled = raw.withColumn("label", squeeze("label")).where("label <> ''").withColumn("_given", F.nullif(F.col("latin"), F.lit("")))
    fixed = parsing.repair_names(labelled.where("_given is not null").select(F.col("_given").alias("name")).distinct(), genera).withColumnRenamed("name", "_given")
    rows = labelled.join(fixed, "_given", "left").withColumn("name", F.coalesce("repaired", parsing.extract_latin("label", v)))
    found = resolve_ingest(rows.select(F.col("name").alias("latin"), "label"), exact, common, v)
    found = found.withColumnsRenamed({"latin": "_name", "label": "_label"})
    rows = rows.join(found, rows["name"].eqNullSafe(found["_name"]) & (rows["label"] == found["_label"]), "left")
    rows = rows.withColumn("assay", parsing.parse_assay(F.coalesce("assay_raw", F.lit("")))).withColumn("f", parsing.map_format(F.col("assay"), "label", F.lit(base)))
    rows = rows.select(
        "supplier_id", "row_no", "label", F.col("_given").alias("raw_name"), "name", "canonical_id", "match_method", "candidates", plant_part_anywhere([F.coalesce("part_text", F.lit("")), "label"], v).alias("part"),
        F.col("f.base").alias("base"), F.col("f.overlays").alias("overlays"), F.col("f.method").alias("normalisation"), F.col("f.flags").alias("review_flags"), F.col("assay.ratio").alias("ratio"),
        F.col("assay.percent").alias("percent"), F.col("assay.marker").alias("marker"), F.col("assay.method").alias("method"), F.coalesce("repair", F.lit("none")).alias("repair"),
    )
    review = route_review(rows)
    unresolved = rows.where("canonical_id is null and match_method = 'unresolved'").select(
        "supplier_id", "row_no", "label", F.coalesce("name", clean_label("label", v)).alias("candidate"), F.when(F.col("name").isNotNull(), "latin").otherwise("common_only").alias("type"),
    )
    repairs = rows.where("repair <> 'none'").select("supplier_id", "row_no", F.col("repair").alias("kind"), F.col("raw_name").alias("before"), F.col("name").alias("after"))
    return Ingest(rows, review, unresolved, repairs, ingest_metrics(rows))


def route_review(rows: DataFrame) -> DataFrame:
    """A queue entry for each reason that a row needs review; a row with several reasons has several."""
    ambiguous = F.when(F.col("match_method") == "ambiguous", F.struct(F.lit("ambiguous_common_name").alias("type"), F.col("candidates").alias("detail")))
    form = F.when(F.size("review_flags") > 0, F.struct(F.lit("form_normalization_disagreement").alias("type"), F.col("review_flags").alias("detail")))
    return rows.select("supplier_id", "row_no", "label", F.inline(F.array_compact(F.array(ambiguous, form))))


def ingest_metrics(rows: DataFrame) -> DataFrame:
    """Per supplier: rows, resolved, ambiguous, unresolved, and the share of resolved ones to three digits (0 without rows)."""
    how = F.col("match_method")
    g = rows.groupBy("supplier_id").agg(F.count("*").alias("n_rows"), F.count_if(~how.isin("unresolved", "ambiguous")).alias("n_resolved"), F.count_if(how == "ambiguous").alias("n_ambiguous"), F.count_if(how == "unresolved").alias("n_unresolved"))
    return g.withColumn("identity_rate", rate(F.col("n_resolved"), F.col("n_rows"), 0.0))


def signature(base: Column | str = "base", overlays: Column | str = "overlays") -> Column:
    """A format and its overlays, joined by plus signs."""
    return F.array_join(F.concat(F.array(_col(base)), _col(overlays)), "+")


def distribution(rows: DataFrame, value: Column, key: str = "supplier_id") -> DataFrame:
    """How often each supplier has each value."""
    return rows.groupBy(key, value.alias("value")).agg(F.count("*").alias("n"))


class Delta(NamedTuple):
    candidates: DataFrame
    review: DataFrame
    recovered: DataFrame


def extract_delta(rows: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT, examples: int = 3) -> Delta:
    """``rows(supplier_id, ord, title)`` under the longest-match resolver: what it resolves is recovered (``tiebreak`` where
    the shortest match would give another id), what is ambiguous goes to review, and the rest become candidates.

    A candidate is the title's first binomial, else its core, if its key has three characters or more; it is latin once any
    of its titles gives a binomial.  ``examples`` titles in order and the number of listings per supplier are kept.
    """
    got = resolve_longest(rows.select("title"), exact, common, v)
    j = rows.join(got.withColumnRenamed("title", "_title"), F.col("title") == F.col("_title")).drop("_title")
    recovered = j.where("canonical_id is not null").select("supplier_id", "ord", "title", "canonical_id", "match_method", (F.col("shortest") != F.col("canonical_id")).alias("tiebreak"))
    review = j.where("match_method = 'ambiguous'").select("supplier_id", "ord", "title", "candidates")
    binomial = F.get(ngram_binomials("title", v), F.lit(0))
    rest = j.where("match_method = 'unresolved'").select("supplier_id", "ord", "title", binomial.isNotNull().alias("is_latin"), F.coalesce(binomial, ngram_core("title", v)).alias("text")).withColumn("key", norm("text")).where("length(key) >= 3")
    kinds = promote_types(rest)
    per = rest.groupBy("key", "supplier_id").agg(F.count("*").alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("supplier_id", "n"))).alias("suppliers"))
    out = kinds.join(per, "key").join(first_examples(rest, "key", "ord", "title", examples), "key")
    return Delta(out.select("key", F.col("text").alias("candidate"), F.col("kind").alias("type"), F.col("n").alias("n_listings"), "suppliers", "examples"), review, recovered)


@dataclass(frozen=True)
class WorkWords:
    """Words of the worklist filter; the defaults are small general sets."""

    descriptive: tuple[str, ...] = ("organic", "natural", "fine", "coarse", "dry")
    generic: tuple[str, ...] = ("black", "white", "red", "green", "blue", "hot", "sweet", "wild")
    foreign: tuple[str, ...] = ("mineral", "salt", "wax", "acid", "sugar")
    dropped: tuple[str, ...] = ("egg shell", "grape", "black")


def keep_for_work(key: Column | str, words: WorkWords = WorkWords(), v: Vocabulary = DEFAULT) -> Column:
    """Whether a candidate's key is worth a person's time: no dropped string, no foreign word, some word that is neither
    descriptive nor a form or part word, not generic words alone, and more than two characters."""
    k = _col(key)
    tokens = F.filter(F.split(k, " "), lambda t: t != "")
    content = F.filter(tokens, lambda t: ~F.array_contains(_words((*words.descriptive, *v.label_words)), t))
    return (
        ~k.isin(*words.dropped) & ~F.arrays_overlap(tokens, _words(words.foreign)) & (F.size(content) > 0)
        & F.exists(content, lambda t: ~F.array_contains(_words(words.generic), t)) & (F.length(k) > 2)
    )


def other_families(suppliers: DataFrame, family: DataFrame) -> DataFrame:
    """Suppliers that are in none of the listed families; one without a family is its own."""
    return suppliers.join(family.select("family").distinct(), "family", "left_anti")


#: Flags that need a look, and those of them that are probably errors.
UNCERTAIN = ("multi_dash_latin_not_final", "near_duplicate_latin", "suspicious_latin_rejected")
LIKELY_WRONG = ("near_duplicate_latin", "suspicious_latin_rejected")


def review_cost(cohort: DataFrame, flags: DataFrame, size: int = 50, per_flag: float = 2.5, per_entry: float = 1.5) -> DataFrame:
    """One row: what reviewing a cohort costs. ``cohort(key)`` and ``flags(key, reason)``; rates are shares of ``size``, minutes
    count every flag of the cohort and one check for each of ``size`` entries."""
    j = cohort.select("key").join(flags, "key", "left").groupBy("key").agg(
        F.count("reason").alias("n"), F.max(F.coalesce(F.col("reason").isin(*UNCERTAIN), F.lit(False))).alias("u"), F.max(F.coalesce(F.col("reason").isin(*LIKELY_WRONG), F.lit(False))).alias("w"),
    )
    return j.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_flags"), (F.count_if("u") / size).alias("review_rate"), (F.count_if("w") / size).alias("error_rate"),
        (F.coalesce(F.sum("n"), F.lit(0)) * per_flag + size * per_entry).alias("minutes"),
    )
