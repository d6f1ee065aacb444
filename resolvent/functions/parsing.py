"""Parsers of catalogue cells: titles, assays, formats and scanning errors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DEFAULT, Vocabulary, _col, _words, binomial_case, clean_common, country_tag, squeeze, strip_trailing_parens

_DASH = "\\s+[-‐‑‒–—―]\\s+"
_BINOMIAL = "^([A-Za-z]+)[  ×]+([A-Za-z]+(?:-[A-Za-z]+)?)"
_ASSAY = "(?i)[%≥≤:]|\\d|standardi|extract|ratio"


def parse_title(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """Struct of ``latin_key, common, country, flags``: the last dash-separated segment that begins with a binomial whose
    words are neither form nor part words; rejected ones, notes behind it and its place are flagged."""
    raw = F.trim(_col(c))
    parts = F.split(raw, _DASH)
    n = F.size(parts)

    def look(seg: Column, i: Column) -> Column:
        core, notes = strip_trailing_parens(F.trim(seg))
        genus, species = F.regexp_extract(F.trim(core), _BINOMIAL, 1), F.regexp_extract(F.trim(core), _BINOMIAL, 2)
        shaped = genus != ""
        odd = F.array_contains(_words(v.label_words), F.lower(genus)) | F.array_contains(_words(v.label_words), F.lower(species))
        return F.struct(i.alias("i"), genus.alias("genus"), species.alias("species"), shaped.alias("shaped"), odd.alias("odd"), notes.alias("notes"))

    seen = F.reverse(F.transform(parts, look))
    hit = F.get(F.filter(seen, lambda s: s.shaped & ~s.odd), F.lit(0))
    rejected = F.filter(seen, lambda s: s.shaped & s.odd & (hit.isNull() | (s.i > hit.i)))
    flags = F.concat(
        F.transform(rejected, lambda s: F.lit("suspicious_latin_rejected")),
        F.coalesce(F.transform(hit.notes, lambda p: F.when(p.rlike(_ASSAY), "assay_in_latin").otherwise("name_in_latin_paren")), F.array().cast("array<string>")),
        F.when(hit.isNull(), F.array(F.lit("no_latin"))).when((n >= 3) & (hit.i != n - 1), F.array(F.lit("multi_dash_latin_not_final"))).otherwise(F.array().cast("array<string>")),
    )
    common = F.when(hit.isNull() | (hit.i != 0), clean_common(F.get(parts, F.lit(0)))).otherwise("")
    return F.struct(F.when(hit.isNotNull(), binomial_case(hit.genus, hit.species)).alias("latin_key"), common.alias("common"), country_tag(raw).alias("country"), flags.alias("flags"))


def parse_assay(c: Column | str) -> Column:
    """Struct of ``ratio, percent, method, marker`` of an assay cell as suppliers write it."""
    r = squeeze(c)
    a, b = F.regexp_extract(r, "(\\d+)\\s*:\\s*0?(\\d+)", 1), F.regexp_extract(r, "(\\d+)\\s*:\\s*0?(\\d+)", 2)
    has_ratio = a != ""
    percent = F.regexp_extract(r, "(\\d+(?:\\.\\d+)?)\\s*%", 1)
    ratio = F.when(has_ratio, F.concat(a.cast("long").cast("string"), F.lit(":"), b.cast("long").cast("string"))).when((percent == "") & r.rlike("^\\d+$"), F.concat(F.try_to_number(r, F.lit("999999999999")).cast("long").cast("string"), F.lit(":1")))
    value = F.when(percent != "", percent.try_cast("double")).when(~has_ratio & r.rlike("^0?\\.\\d+$"), F.round(r.try_cast("double") * 100, 1))
    by, known = F.regexp_extract(r, "(?i)\\bby\\s+([A-Za-z]+)", 1), F.regexp_extract(r, "(?i)\\b(HPLC|GC|UV|Titration|Gravimetric|Gr)\\b", 1)
    name = F.when(by != "", by).otherwise(known)
    method = F.when(name == "", None).when(F.lower(name) == "gr", "Gravimetric").when(F.length(name) <= 4, F.upper(name)).otherwise(F.initcap(name))
    near = F.concat(F.regexp_replace(r, "^.*?\\d+(?:\\.\\d+)?\\s*%", ""), F.lit(" "), F.regexp_extract(r, "^(.*?)\\d+(?:\\.\\d+)?\\s*%", 1))
    marker = F.regexp_extract(near, "([A-Z][A-Za-z]+(?:\\s+[A-Z]?[A-Za-z]+)?)", 1)
    marker = F.when((percent != "") & (marker != "") & ~F.lower(marker).isin("by", "hplc", "gc", "uv", "titration", "gravimetric"), F.trim(marker))
    return F.struct(ratio.alias("ratio"), value.alias("percent"), method.alias("method"), marker.alias("marker"))


def map_format(assay: Column, label: Column | str, base: Column | str) -> Column:
    """Struct of ``base, overlays, method, flags`` from a parsed assay and a label; an essential oil is never changed."""
    low, b = F.lower(squeeze(label)), _col(base)
    spray, freeze, extract = low.rlike("spray[ -]dried"), F.contains(low, F.lit("freeze")), F.contains(low, F.lit("extract"))
    fixed = b == "EO"
    new = F.when(fixed, b).when(freeze & ~extract, "FD").when(spray, "SD").otherwise(b)
    overlays = F.when(~fixed & assay["marker"].isNotNull() & assay["percent"].isNotNull(), F.array(F.lit("SE"))).otherwise(F.array().cast("array<string>"))
    review = ~fixed & freeze & extract
    return F.struct(new.alias("base"), overlays.alias("overlays"), F.when(review, "manual_review").otherwise("assay_map").alias("method"), F.when(review, F.array(F.lit("freeze_dried_extract"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def normalise_format(base: Column | str, overlays: Column | str, title: Column | str, extracts: tuple[str, ...] = ("RE", "SD", "OE"), solids: tuple[str, ...] = ("MP", "WD")) -> Column:
    """Struct of ``base, overlays, assay, method, rules, flags``: a mapped type's format with the title's overlays; a later
    rule overrides the method; null where the type is not mapped."""
    b, o, t = _col(base), _col(overlays), _col(title)
    std, isolate, freeze = t.rlike("(?i)standardi[sz](ed|ation)"), t.rlike("(?i)isolate|high[- ]purity"), t.rlike("(?i)freeze[- ]dried")
    add = std & ~F.array_contains(o, "SE")
    all_overlays = F.array_sort(F.array_distinct(F.when(add, F.array_append(o, F.lit("SE"))).otherwise(o)))
    keep, turn = freeze & b.isin(*extracts), freeze & b.isin(*solids)
    method = F.when(turn, "type_map_plus_title_overlay").when(keep | isolate, "manual_review").when(add, "type_map_plus_title_overlay").otherwise("type_map")
    pick = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in pairs]), lambda x: x.isNotNull())
    assay = F.when(F.array_contains(all_overlays, "SE"), F.nullif(F.regexp_extract(t, "(\\d+(?:\\.\\d+)?\\s*%)", 1), F.lit("")))
    out = F.struct(
        F.when(turn, "FD").otherwise(b).alias("base"), all_overlays.alias("overlays"), assay.alias("assay"), method.alias("method"),
        pick((add, "TITLE-SE"), (isolate, "TITLE-IC"), (keep, "TITLE-FD-KEEP"), (turn, "TITLE-FD-TURN")).alias("rules"),
        pick((isolate, "possible_isolate"), (keep, "freeze_dried_extract")).alias("flags"),
    )
    return F.when(b.isNotNull(), out)


def split_joined_case(c: Column | str) -> Column:
    """A scanned name with a space where a capital follows a small letter."""
    return F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2")


def repair_names(names: DataFrame, genera: DataFrame, column: str = "name") -> DataFrame:
    """Adds ``repaired`` and ``repair``: joined case is split; a name that is still one word of letters alone, longer than
    eight, is split behind its longest known genus, if at least three letters remain.

    A glued name's beginnings meet the genera in an equi-join, so a genus of any length is found.
    """
    rows = names.withColumn("_split", split_joined_case(squeeze(column))).withColumn("_id", F.monotonically_increasing_id())
    known = genera.where("genus <> ''").groupBy(F.lower("genus").alias("_g")).agg(F.min("genus").alias("_genus"))
    glued = rows.where(F.col("_split").rlike("^\\p{L}{9,}$"))
    heads = glued.select("_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("_split") - 3), lambda k: F.substr(F.lower("_split"), F.lit(1), k))).alias("_g"))
    best = heads.join(known, "_g").groupBy("_id").agg(F.max_by("_genus", F.length("_g")).alias("_genus"))
    out = rows.join(best, "_id", "left")
    parted = F.concat("_genus", F.lit(" "), F.lower(F.substr(F.col("_split"), F.length("_genus") + 1)))
    kind = F.when(F.col("_genus").isNotNull(), "glued_genus_split").when(F.col("_split") != squeeze(column), "case_boundary_split").otherwise("none")
    return out.select(*names.columns, F.coalesce(parted, "_split").alias("repaired"), kind.alias("repair"))


def extract_latin(c: Column | str, v: Vocabulary = DEFAULT) -> Column:
    """The binomial in parentheses, else in the whole text, whose words are no form or part words; of each chunk only the
    first binomial is tried."""
    x = squeeze(c)
    chunks = F.concat(F.regexp_extract_all(x, F.lit("\\(([^)]+)\\)"), F.lit(1)), F.array(x))
    pattern = "\\b([A-Z][a-zA-Z]+)\\s+([A-Za-z][a-z]{2,}(?:-[a-z]+)?)\\b"
    tried = F.transform(chunks, lambda k: F.struct(F.regexp_extract(k, pattern, 1).alias("g"), F.regexp_extract(k, pattern, 2).alias("s")))
    good = F.filter(tried, lambda t: (t.g != "") & ~F.array_contains(_words(v.form), F.lower(t.g)) & ~F.array_contains(_words(v.label_words), F.lower(t.s)))
    hit = F.get(good, F.lit(0))
    return F.when(hit.isNotNull(), binomial_case(hit.g, hit.s))
