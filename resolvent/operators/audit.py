"""Integrity, coverage, leakage and version checks.  Checks that must fail closed run an action and raise."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.security import name_features, well_formed
from ..functions.text import DEFAULT, Vocabulary, epithet_shaped, genus_token, is_binomial, norm, species_key
from .index import METHODS
from .resolve import resolve_serving


def check_versions(meta: dict[str, DataFrame], expected: dict[str, str]) -> None:
    """Raise with the first artifact whose one-row ``version`` is not the expected one, or that is missing."""
    for name, version in expected.items():
        if name not in meta:
            raise ValueError(f"{name} is missing")
        rows = meta[name].select("version").limit(2).collect()
        if len(rows) != 1 or rows[0]["version"] != version:
            raise ValueError(f"{name} has version {[r['version'] for r in rows]}, not {version}")


def version_mismatch(versions: DataFrame) -> DataFrame:
    """``versions(ord, artifact, built_against, current)`` -> one row: the first mismatch in order, or 'ok'."""
    return versions.agg(F.coalesce(F.expr("min_by(artifact, ord) FILTER (WHERE NOT built_against <=> current)"), F.lit("ok")).alias("first_mismatch"), F.count_if(~F.col("built_against").eqNullSafe(F.col("current"))).alias("n_mismatches"))


RANKS = ("SPECIES", "SUBSPECIES", "VARIETY", "FORM", "GENUS", "HYBRID", "SUBVARIETY")


def _ambiguous() -> Column:
    return F.coalesce(F.col("resolution_status").endswith("_ambiguous"), F.lit(False))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _found(*checks: tuple[str, Column]) -> Column:
    """Rows (check, canonical_id) of the checks that fail."""
    return F.inline(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("check"))) for name, bad in checks])))


def taxonomy_problems(identities: DataFrame) -> DataFrame:
    """``(check, canonical_id)`` of seven checks of names, ranks and ids.

    ``identities`` has ``canonical_id, accepted_name, authority_accepted_name, accepted_rank, genus, species,
    infraspecific_epithet, resolution_status, scientific_synonyms``.  Ambiguous records have no accepted name.
    """
    amb = _ambiguous()
    name, rank, infra = F.col("accepted_name"), F.col("accepted_rank"), F.col("infraspecific_epithet")
    first = F.regexp_replace(F.get(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "\\s×\\s?", " "), "^×", "")), "\\s+"), F.lit(0)), "^×", "")
    has_infra = ~_blank("infraspecific_epithet")
    one = identities.select("canonical_id", _found(
        ("malformed_accepted_name", F.when(amb, name.isNotNull()).otherwise(~well_formed(name))),
        ("accepted_vs_authority_mismatch", ~name.eqNullSafe(F.col("authority_accepted_name"))),
        ("rank_field_inconsistency", ~amb & rank.isNotNull() & ~rank.isin(*RANKS)),
        ("rank_field_inconsistency", ~amb & ~_blank("genus") & (first != "") & (F.col("genus") != first)),
        ("rank_field_inconsistency", ~amb & (rank == "SPECIES") & has_infra),
        ("rank_field_inconsistency", ~amb & rank.isin("SUBSPECIES", "VARIETY", "FORM") & ~has_infra),
        ("missing_genus_species", ~amb & ~rank.eqNullSafe("GENUS") & (_blank("genus") | _blank("species"))),
    ))
    synonyms = identities.select("canonical_id", F.explode("scientific_synonyms").alias("s")).where(~well_formed("s")).select("canonical_id", F.lit("malformed_synonym").alias("check"))
    converged = identities.where("authority_accepted_name is not null").groupBy("authority_accepted_name").agg(F.min("canonical_id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1").select("canonical_id", F.lit("converged_accepted_name_duplicates").alias("check"))
    repeated = identities.groupBy("canonical_id").agg(F.count("*").alias("n")).where("n > 1").select("canonical_id", F.lit("duplicate_canonical_id").alias("check"))
    return one.unionByName(synonyms).unionByName(converged).unionByName(repeated).select("check", "canonical_id")


def provenance_problems(identities: DataFrame, outside: str = "accepted_outside_authority", authority: str = "authority") -> DataFrame:
    """``(check, canonical_id)`` of four checks of the records' ``provenance``, a JSON object as text: there is one, it leads
    to a source, ``enriched_by`` is an array, and names from outside the authority bear a date and a person's mark."""
    p = F.col("provenance")
    at = lambda k: F.get_json_object(p, f"$.{k}")
    text = lambda k: F.trim(F.coalesce(at(k), F.lit(""))) != ""
    none = ~F.coalesce(F.get_json_object(p, "$").startswith("{"), F.lit(False))
    enriched = at("enriched_by")
    is_list = F.coalesce(enriched.startswith("["), F.lit(False))
    traceable = text("authority") | text("resolved_by") | (is_list & F.coalesce(enriched != "[]", F.lit(False)))
    dated = text("query_date") | text("review_date") | text("recheck.query_date")
    marked = (at("owner_common_mapping") == "true") | text("review_date") | (text("resolved_by") & (F.lower(at("resolved_by")) != authority.lower())) | at("recheck").isNotNull() | (at("owner_resolved") == "true")
    return identities.select("canonical_id", _found(
        ("records_without_provenance", none), ("enriched_by_not_array", ~none & enriched.isNotNull() & ~is_list), ("records_untraceable_to_source", ~none & ~traceable),
        ("accepted_outside_missing_stamp", ~none & (at(outside) == "true") & ~(dated & F.coalesce(marked, F.lit(False)))),
    )).select("check", "canonical_id")


def counted(problems: DataFrame, checks: tuple[str, ...], shown: int = 25) -> DataFrame:
    """One row per check, also those without a problem: how many, the first ids, and whether there are more.

    Ids are ranked within a check first, so no list is longer than ``shown``."""
    from pyspark.sql import Window

    n = problems.groupBy("check").agg(F.count("*").alias("total"))
    some = problems.select("check", "canonical_id").withColumn("_k", F.row_number().over(Window.partitionBy("check").orderBy("canonical_id"))).where(F.col("_k") <= shown)
    some = some.groupBy("check").agg(F.array_sort(F.collect_list("canonical_id")).alias("shown"))
    every = problems.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    out = every.join(n, "check", "left").join(some, "check", "left")
    return out.select("check", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("shown", F.array().cast("array<string>")).alias("shown"), (F.coalesce("total", F.lit(0)) > shown).alias("truncated"))


TAXONOMY_CHECKS = ("malformed_accepted_name", "accepted_vs_authority_mismatch", "rank_field_inconsistency", "malformed_synonym", "converged_accepted_name_duplicates", "duplicate_canonical_id", "missing_genus_species")
PROVENANCE_CHECKS = ("records_without_provenance", "records_untraceable_to_source", "enriched_by_not_array", "accepted_outside_missing_stamp")


def names_of(identities: DataFrame) -> DataFrame:
    """``(canonical_id, kind, name)`` of every name of every record."""
    out = None
    for kind, _, _ in (*METHODS, ("common_names", 9, "")):
        part = identities.select("canonical_id", F.lit(kind).alias("kind"), F.explode(F.array("accepted_name") if kind == "accepted_name" else F.col(kind)).alias("name")).where("name is not null")
        out = part if out is None else out.unionByName(part)
    return out


def normalisation_audit(identities: DataFrame) -> DataFrame:
    """Per kind of name: names, keys shared by several records, and names with odd spaces, other letters or authors."""
    names = names_of(identities).withColumn("key", norm("name")).withColumn("f", name_features("name"))
    shared = names.groupBy("kind", "key").agg(F.count_distinct("canonical_id").alias("n")).where("n > 1").groupBy("kind").agg(F.count("*").alias("n_shared_keys"))
    counts = names.groupBy("kind").agg(F.count("*").alias("n_names"), *[F.count_if(F.col(f"f.{x}")).alias(f"n_{x}") for x in ("nbsp", "padded", "non_ascii", "author")])
    return counts.join(shared, "kind", "left").withColumn("n_shared_keys", F.coalesce("n_shared_keys", F.lit(0)))


def _as_label(c: str = "input") -> list[Column]:
    return [F.lit(None).cast("string").alias("latin"), F.col(c).alias("label")]


def unique_commons(identities: DataFrame) -> DataFrame:
    """``(key, n_ids, canonical_id)``: each common name's key, how many records bear it, and one of them."""
    rows = identities.select("canonical_id", F.explode("common_names").alias("c")).select("canonical_id", norm("c").alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.count_distinct("canonical_id").alias("n_ids"), F.min("canonical_id").alias("canonical_id"))


#: Inputs that no index may know, and suffixes that stripping must see through.
GIBBERISH = ("Xyzzy blorptonium 42", "qwertyuiop", "zzz zzz zzz", "1234567")
SUFFIXES = (" Root", " Powder", " Leaf, Cut")


def resolver_probes(identities: DataFrame, common: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(path, input, expected)``: inputs of the eight paths that the serving resolver is tested on, for every record."""
    name = F.col("accepted_name")
    named = identities.where("accepted_name is not null").select("canonical_id", "accepted_name", "scientific_synonyms")
    plain = named.where(~F.coalesce(F.regexp_replace(name, "^\\S+\\s*", "").rlike("\\S-\\S"), F.lit(False)))
    probe = lambda df, path, inputs: df.select(F.lit(path).alias("path"), inputs.alias("input"), F.col("canonical_id").alias("expected"))
    n = F.length(name)
    cases = F.explode(F.array(F.upper(name), F.lower(name), F.concat(F.lit("  "), name, F.lit("  ")), F.replace(name, F.lit(" "), F.lit("  "))))
    wrong = F.explode(F.array(F.split(name, " ")[0], F.substr(name, F.lit(1), F.greatest(F.lit(5), F.floor(n / 2).cast("int"))), F.concat(F.substr(name, F.lit(1), n - 1), F.when(name.endswith("a"), "x").otherwise("a"))))
    only = unique_commons(identities).where("n_ids = 1")
    many = common.where("size(cids) > 1").select(F.lit(None).cast("string").alias("canonical_id"), "key")
    none = identities.sparkSession.createDataFrame([(g, None) for g in GIBBERISH], "g string, canonical_id string")
    parts = [
        probe(named, "accepted_name_exact", name), probe(named, "scientific_synonym_exact", F.explode("scientific_synonyms")), probe(only, "common_name_unique_no_strip_override", F.col("key")),
        probe(many, "ambiguous_never_picks_outside", F.col("key")), probe(none, "unrecognised", F.col("g")), probe(only, "part_and_format_stripped", F.explode(F.array(*[F.concat("key", F.lit(x)) for x in suffixes]))),
        probe(plain, "case_whitespace_normalisation", cases), probe(named, "no_substring_or_fuzzy_match", wrong),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def resolver_failures(identities: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The probes with ``ok``: what the serving resolver makes of them; distinct inputs are resolved once."""
    probes = resolver_probes(identities, common, suffixes)
    got = resolve_serving(probes.select(*_as_label()), exact, common, v).withColumn("_key", norm("label"))
    known = exact.select(F.col("key").alias("_key"), F.lit(True).alias("_exact"))
    sets = common.select(F.col("key").alias("_key"), F.col("cids").alias("_cids"))
    j = probes.join(got, probes["input"] == got["label"], "left").join(known, "_key", "left").join(sets, "_key", "left")
    own, resolved, how = F.col("canonical_id").eqNullSafe(F.col("expected")), F.col("canonical_id").isNotNull(), F.col("match_method")
    legit = F.coalesce(F.col("_exact"), F.lit(False)) | F.coalesce(F.size("_cids") == 1, F.lit(False))
    path = F.col("path")
    ok = (
        F.when(path.isin("accepted_name_exact", "case_whitespace_normalisation"), own).when(path == "scientific_synonym_exact", own | (how == "ambiguous"))
        .when(path == "common_name_unique_no_strip_override", own | ~resolved | (norm("matched") == F.col("_key")))
        .when(path == "ambiguous_never_picks_outside", ~resolved | F.array_contains("_cids", F.col("canonical_id"))).when(path == "unrecognised", how == "unresolved")
        .when(path == "part_and_format_stripped", how != "unresolved").otherwise(~resolved | legit)
    )
    return j.select("path", "input", "expected", "canonical_id", "match_method", F.coalesce(ok, F.lit(False)).alias("ok"))


def resolver_self_test(identities: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row per path: how many inputs were tried, and how many fail."""
    return resolver_failures(identities, exact, common, v, suffixes).groupBy("path").agg(F.count("*").alias("n_tried"), F.count_if(~F.col("ok")).alias("n_failed"))


SCHEMA_FIELDS = ("authority_accepted_name", "trade_primary_name", "canonical_display_name", "accepted_name")
META_FIELDS = ("identity_version", "identity_schema_version", "initial_backbone_created", "generated_at")


def schema_problems(identities: DataFrame, meta: DataFrame, excluded: DataFrame, keys: DataFrame, quarantine: DataFrame, schema_version: int = 2) -> DataFrame:
    """``(check, subject)`` of eight checks that hold the artifacts against each other.

    ``meta`` is one row of version fields and counts (``identity_records``, ``excluded``), ``excluded(parsed_name)``,
    ``keys(key)`` all keys that must be accounted for, ``quarantine`` one row with its ``identity_version``.
    """
    missing = [f for f in SCHEMA_FIELDS if f not in identities.columns]
    full = identities.withColumns({f: F.lit(None).cast("string") for f in missing})
    amb = _ambiguous()
    shown, trade, authority = F.col("canonical_display_name"), F.col("trade_primary_name"), F.col("authority_accepted_name")
    records = full.select(F.col("canonical_id").alias("subject"), _found(
        ("missing_schema_fields", F.lit(bool(missing))), ("display_name_semantics_violation", F.when(amb, shown.isNotNull()).otherwise(~shown.eqNullSafe(F.coalesce(F.nullif(trade, F.lit("")), authority)))),
        ("trade_primary_semantics_violation", ~amb & trade.isNotNull() & (trade == authority)),
    ))
    n = identities.agg(F.count("*").alias("_records")).join(excluded.agg(F.count("*").alias("_excluded")))
    has = lambda f: F.col(f).isNotNull() if f in meta.columns else F.lit(False)
    fields = [(f"{f} missing", ~has(f)) for f in META_FIELDS]
    if "identity_schema_version" in meta.columns:
        fields.append(("identity_schema_version", ~F.col("identity_schema_version").eqNullSafe(schema_version)))
    if "identity_records" in meta.columns:
        fields.append(("identity_records", F.col("identity_records") != F.col("_records")))
    issue = lambda check, name, bad: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(name).alias("subject")))
    entries = [issue("version_field_issues", name, bad) for name, bad in fields]
    if "excluded" in meta.columns:
        entries.append(issue("excluded_count_mismatch", "excluded", F.col("excluded") != F.col("_excluded")))
    versions = meta.join(n).join(quarantine.select(F.col("identity_version").alias("_quarantine")))
    if "identity_version" in meta.columns:
        entries.append(issue("quarantine_version_mismatch", "quarantine", F.col("_quarantine") != F.col("identity_version")))
    meta_rows = versions.select(F.inline(F.array_compact(F.array(*entries))))
    resolved = identities.select(F.explode("original_parsed_names").alias("p")).select(norm("p").alias("key")).distinct()
    out = excluded.select("parsed_name", norm("parsed_name").alias("key"))
    both = out.where("key <> ''").join(resolved, "key", "left_semi").select(F.lit("excluded_name_also_resolved").alias("check"), F.col("parsed_name").alias("subject"))
    lost = keys.select(F.col("key").alias("subject"), norm("key").alias("key")).join(resolved, "key", "left_anti").join(out.where("key <> ''").select("key"), "key", "left_anti").select(F.lit("keys_unaccounted").alias("check"), "subject")
    return records.select("check", "subject").unionByName(meta_rows).unionByName(both).unionByName(lost)


def schema_audit(identities: DataFrame, graph: DataFrame) -> DataFrame:
    """One row: null ids, empty common names, and graph rows whose identity does not exist."""
    orphans = graph.join(identities.select("canonical_id"), "canonical_id", "left_anti").agg(F.count("*").alias("graph_orphans"))
    return identities.agg(F.count_if(F.col("canonical_id").isNull()).alias("null_ids"), F.count_if(F.size("common_names") == 0).alias("no_commons")).join(orphans)


def valid_genera(identities: DataFrame) -> DataFrame:
    """``(genus)``: keys of the genera of accepted names and of the ``genus`` column, if there is one."""
    g = identities.where("accepted_name is not null").select(genus_token("accepted_name").alias("genus"))
    if "genus" in identities.columns:
        g = g.unionByName(identities.where(~_blank("genus")).select(norm("genus").alias("genus")))
    return g.where("genus <> ''").distinct()


def species_of(names: DataFrame, genera: DataFrame, column: str = "name") -> DataFrame:
    """The rows whose name is a binomial of a known genus: capital common names drop out."""
    return names.where(is_binomial(column) & epithet_shaped(column)).withColumn("_g", genus_token(column)).join(genera.select(F.col("genus").alias("_g")), "_g", "left_semi").drop("_g")


def merged_species(identities: DataFrame) -> DataFrame:
    """``(canonical_id, n_absorbed, species)``: other species that a record holds among its parsed names and synonyms."""
    names = identities.select("canonical_id", "accepted_name", F.explode(F.concat("original_parsed_names", "scientific_synonyms")).alias("name"))
    rows = species_of(names, valid_genera(identities)).withColumn("key", species_key("name")).where(~F.col("key").eqNullSafe(species_key("accepted_name")))
    return rows.groupBy("canonical_id").agg(F.count_distinct("key").alias("n_absorbed"), F.array_sort(F.collect_set("key")).alias("species"))


def sibling_coverage(identities: DataFrame, v: Vocabulary = DEFAULT, least: int = 4) -> DataFrame:
    """One-word common names of ``least`` letters or more, no form or part words, that only one record bears, though its
    genus has several species."""
    base = identities.where("accepted_name is not null").select("canonical_id", genus_token("accepted_name").alias("genus"))
    wide = base.groupBy("genus").agg(F.count_distinct("canonical_id").alias("n_species")).where("n_species > 1")
    lone = unique_commons(identities).where((F.col("n_ids") == 1) & ~F.contains("key", F.lit(" ")) & (F.length("key") >= least) & ~F.col("key").isin(*v.label_words))
    return lone.join(base, "canonical_id").join(wide, "genus").select("key", "canonical_id", "genus", "n_species")


def unresolved_commons(commons: DataFrame, excluded: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``commons(name, source)``, suppliers' common names and the keys that they come from -> ``(key, name, kind)`` of those
    that nothing resolves: ``non_botanical`` if all their sources are excluded, else ``botanical``."""
    rows = commons.withColumn("key", norm("name")).where("key <> ''")
    out = excluded.select(norm("parsed_name").alias("_s")).where("_s <> ''").distinct().withColumn("_out", F.lit(True))
    flagged = rows.withColumn("_s", norm("source")).join(out, "_s", "left")
    grouped = flagged.groupBy("key").agg(F.min("name").alias("name"), F.min(F.coalesce("_out", F.lit(False))).alias("all_out"))
    got = resolve_serving(grouped.select(*_as_label("name")), exact, common, v).where("match_method = 'unresolved'").select(F.col("label").alias("name"))
    return grouped.join(got, "name", "left_semi").select("key", "name", F.when(F.col("all_out"), "non_botanical").otherwise("botanical").alias("kind"))


def thin_names(identities: DataFrame) -> DataFrame:
    """Accepted species with at most one common name: ``(canonical_id, n_commons, n_synonyms)``."""
    sure = ~_ambiguous() & ~F.col("resolution_status").eqNullSafe("genus_level")
    n = F.coalesce(F.size("common_names"), F.lit(0))
    return identities.where(sure & (n <= 1)).select("canonical_id", n.alias("n_commons"), F.coalesce(F.size("scientific_synonyms"), F.lit(0)).alias("n_synonyms"))


def seed_presence(identities: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seeds(species)`` -> ``(species, presence, canonical_ids)``: present as a record of its own, absorbed in others, or absent."""
    own = identities.where("accepted_name is not null").select(species_key("accepted_name").alias("key"), "canonical_id").groupBy("key").agg(F.max("canonical_id").alias("own"))
    names = identities.select("canonical_id", F.explode(F.array_compact(F.concat(F.array("accepted_name"), "scientific_synonyms", "original_parsed_names"))).alias("name")).where(is_binomial("name"))
    any_ = names.groupBy(species_key("name").alias("key")).agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))
    j = seeds.select("species").distinct().withColumn("key", species_key("species")).join(own, "key", "left").join(any_, "key", "left")
    presence = F.when(F.col("own").isNotNull(), "present").when(F.size("ids") > 0, "absorbed").otherwise("absent")
    return j.select("species", presence.alias("presence"), F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.coalesce("ids", F.array().cast("array<string>"))).alias("canonical_ids"))


#: What an entry of the reference corpus may expect.
EXPECTED = ("resolved", "ambiguous", "unrecognised", "genus_level", "missing_species", "policy_dependent")


def corpus_regression(corpus: DataFrame, identities: DataFrame, exact: DataFrame, common: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``corpus(query, expected_status, expected_identity)`` held against the serving resolver; ``failure`` is null where it
    passes.

    An expected identity is an id or an accepted name; none accepts any.  A ``policy_dependent`` or ``missing_species`` entry
    fails if it is confidently resolved; a ``genus_level`` one must resolve to a record of that status.  An empty or null
    query, or a status outside the list, is malformed.
    """
    got = resolve_serving(corpus.select(*_as_label("query")), exact, common, v).select(F.col("label").alias("_q"), "canonical_id", "match_method")
    records = identities.select(F.col("canonical_id").alias("_id"), norm("accepted_name").alias("_name"), F.col("resolution_status").alias("_status") if "resolution_status" in identities.columns else F.lit(None).cast("string").alias("_status"))
    j = corpus.join(got, F.col("query").eqNullSafe(F.col("_q")), "left").join(records, F.col("canonical_id") == F.col("_id"), "left")
    status = F.when(F.col("canonical_id").isNotNull(), "resolved").when(F.col("match_method") == "ambiguous", "ambiguous").otherwise("unrecognised")
    j = j.withColumn("status", status)
    want, sure = F.col("expected_status"), F.col("status") == "resolved"
    same = F.col("expected_identity").isNull() | (F.col("canonical_id") == F.col("expected_identity")) | (F.col("_name") == norm("expected_identity"))
    failure = (
        F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "malformed_query").when(~F.coalesce(want.isin(*EXPECTED), F.lit(False)), "malformed_status")
        .when((want == "policy_dependent") & sure, "confident_where_policy_decides").when((want == "missing_species") & sure, "resolved_though_missing")
        .when((want == "genus_level") & ~(sure & F.coalesce(F.col("_status") == "genus_level", F.lit(False))), "not_genus_level")
        .when(want.isin("resolved", "ambiguous", "unrecognised") & (F.col("status") != want), "wrong_status").when((want == "resolved") & ~F.coalesce(same, F.lit(False)), "wrong_identity")
    )
    return j.select("query", "expected_status", "status", "canonical_id", failure.alias("failure"))


def changed_cells(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Old rows that the new table lacks or holds with other values (nulls equal): edits may only add."""
    columns = old.columns
    same = None
    n = new.select(*[F.col(c).alias(f"_{c}") for c in columns])
    for c in columns:
        e = old[c].eqNullSafe(n[f"_{c}"])
        same = e if same is None else same & e
    return old.join(n, same, "left_anti").select(*keys)


Test = Callable[[Column], Column]


def _any(of: Test, test: Test) -> Test:
    """Whether the test holds of some element of what ``of`` makes of a value."""
    return lambda x: F.exists(of(x), lambda y: test(y))


def _field(name: str, test: Test) -> Test:
    return lambda x: test(x[name])


def _named(name: str) -> Test:
    return lambda key: F.lower(key) == name


def _walk(kind: T.DataType, path: str, forbidden: frozenset[str], pattern: str) -> Iterator[tuple[str, str, Test]]:
    """(path, what, test) of everything below a value of this type that may leak; ``test`` tells it of such a value.

    Arrays add ``[]`` to a path and maps ``.*``; a test below them is an ``exists`` over the elements, however deep they nest."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            here = f"{path}.{f.name}".lstrip(".")
            if f.name.lower() in forbidden:
                yield here, "key", lambda x: x.isNotNull()
            for below, what, test in _walk(f.dataType, here, forbidden, pattern):
                yield below, what, _field(f.name, test)
    elif isinstance(kind, T.ArrayType):
        for below, what, test in _walk(kind.elementType, f"{path}[]", forbidden, pattern):
            yield below, what, _any(lambda x: x, test)
    elif isinstance(kind, T.MapType):
        if isinstance(kind.keyType, T.StringType):
            for name in sorted(forbidden):
                yield f"{path}.{name}", "key", _any(F.map_keys, _named(name))
        for side, where, of in ((kind.keyType, f"{path}.*key", F.map_keys), (kind.valueType, f"{path}.*", F.map_values)):
            for below, what, test in _walk(side, where, forbidden, pattern):
                yield below, what, _any(of, test)
    elif isinstance(kind, T.StringType):
        yield path, "value", lambda x: x.rlike(pattern)


def leaks(df: DataFrame, forbidden: set[str], pattern: str) -> DataFrame:
    """``(path, what, n)``: where ``df`` holds a forbidden key, or a text that matches the pattern, and in how many rows.

    The walk over the schema enters structs, arrays and maps in any nesting, map keys too; each place is one condition on a row,
    so one pass over the data with one partial aggregate answers all.  A field of a struct is a key wherever the struct is not
    null, a key of a map only where a map has it.  Names are compared without case.  Nothing found, or no rows, gives no rows.
    """
    names = frozenset(x.lower() for x in forbidden)
    found: list[tuple[str, str, Column]] = []
    for f in df.schema.fields:
        if f.name.lower() in names:
            found.append((f.name, "key", F.lit(True)))
        found += [(path, what, test(F.col(f"`{f.name}`"))) for path, what, test in _walk(f.dataType, f.name, names, pattern)]
    if not found:
        return df.sparkSession.createDataFrame([], "path string, what string, n long")
    counted = df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(f"n{i}") for i, (_, _, test) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(what).alias("what"), F.col(f"n{i}").alias("n")) for i, (path, what, _) in enumerate(found)])
    return counted.select(F.inline(rows)).where("n > 0")


def check_no_leaks(df: DataFrame, forbidden: set[str], pattern: str) -> None:
    """Fail closed if ``leaks`` finds anything; the error names at most twenty places."""
    found = leaks(df, forbidden, pattern).orderBy("path", "what").limit(20).collect()
    if found:
        raise ValueError("leaks at " + ", ".join(f"{r['path']} ({r['what']}, {r['n']} rows)" for r in found))
