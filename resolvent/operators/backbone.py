"""Building and maintaining the identity backbone: dispositions, patches, merges and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEFAULT, Vocabulary, canonical_of, folded_distance, is_scientific, name_parts, norm, slug
from ..session import cut_lineage
from . import scan

#: Fixed order of statuses when a group picks its representative.
STATUS_ORDER = ("accepted", "synonym-resolved", "owner-resolved", "typo-corrected", "genus_level", "species_ambiguous", "trade_ambiguous")
NAME_ARRAYS = ("original_parsed_names", "scientific_synonyms", "trade_synonyms", "common_names")


#: Ranks of species and below.
SPECIES_RANKS = ("SPECIES", "SUBSPECIES", "VARIETY", "FORM")


def name_usages(usages: DataFrame) -> DataFrame:
    """``usages(name, canonical, rank, status, accepted)`` of an authority -> ``(name, own, targets)``: the name itself if a
    usage of exactly that name accepts it, and the different names that its other usages accept, without authors."""
    same = (F.lower(F.trim("canonical")) == F.lower(F.trim("name"))) & F.col("rank").isin(*SPECIES_RANKS)
    to = F.nullif(canonical_of("accepted"), F.lit(""))
    return usages.where(same).withColumn("_to", to).groupBy("name").agg(
        F.expr("min(canonical) FILTER (WHERE status = 'ACCEPTED')").alias("own"), F.array_sort(F.collect_set("_to")).alias("targets"),
    )


def _against_authority(names: DataFrame, matches: DataFrame, usages: DataFrame) -> DataFrame:
    return names.select("name").distinct().join(matches, "name", "left").join(name_usages(usages), "name", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def classify_authority(names: DataFrame, matches: DataFrame, usages: DataFrame) -> DataFrame:
    """``names(name)`` against ``matches(name, match_type, status, rank, usage_key, canonical, accepted_canonical)`` and
    ``usages`` (see ``name_usages``): accepted, synonym, typo or unknown.

    A match that is none, of a higher rank, doubtful or without a key falls back on the usages; a synonym of several names
    stays without an accepted one.  A fuzzy match is a suggestion with its edit distance, never applied.
    """
    m = _against_authority(names, matches, usages)
    kind = F.coalesce("match_type", F.lit("NONE"))
    back = kind.isin("NONE", "HIGHERRANK") | F.col("usage_key").isNull() | ~F.coalesce(F.col("rank").isin(*SPECIES_RANKS), F.lit(False)) | F.col("status").eqNullSafe("DOUBTFUL")
    n = F.size("targets")
    typo, synonym = ~back & (kind == "FUZZY"), ~back & (kind != "FUZZY") & F.col("status").eqNullSafe("SYNONYM")
    disposition = F.when(back, F.when(F.col("own").isNotNull(), "accepted").when(n > 0, "synonym").otherwise("unknown")).when(typo, "typo").when(synonym, "synonym").otherwise("accepted")
    accepted = F.when(back, F.coalesce("own", F.when(n == 1, F.get("targets", F.lit(0))))).when(typo, None).when(synonym, F.coalesce("accepted_canonical", "canonical")).otherwise(F.col("canonical"))
    ambiguous = back & F.col("own").isNull() & (n > 1)
    return m.select(
        "name", disposition.alias("disposition"), accepted.alias("accepted"), ambiguous.alias("ambiguous"), F.when(ambiguous, F.col("targets")).alias("candidates"),
        F.when(typo, F.col("canonical")).alias("suggested"), F.when(typo, folded_distance("name", F.coalesce("canonical", F.lit("")))).alias("distance"),
        F.when(back & (F.col("own").isNotNull() | (n > 0)), F.concat(kind, F.lit("+nameusage"))).otherwise(kind).alias("match_type"),
    )


def recheck(names: DataFrame, matches: DataFrame, usages: DataFrame) -> DataFrame:
    """An owner's names once more against the authority: confirmed, synonym or not_found, with what it suggests."""
    m = _against_authority(names, matches, usages)
    n = F.size("targets")
    same = F.lower(F.trim("canonical")) == F.lower(F.trim("name"))
    sure = F.coalesce((F.col("match_type") == "EXACT") & (F.col("status") == "ACCEPTED") & F.col("rank").isin(*SPECIES_RANKS) & same, F.lit(False))
    synonym = F.col("usage_key").isNotNull() & F.col("status").eqNullSafe("SYNONYM")
    status = F.when(sure, "confirmed").when(synonym, "synonym").when(F.col("own").isNotNull(), "confirmed").when(n > 0, "synonym").otherwise("not_found")
    accepted = F.when(sure, F.col("canonical")).when(synonym, F.coalesce("accepted_canonical", "canonical")).otherwise(F.coalesce("own", F.when(n == 1, F.get("targets", F.lit(0)))))
    open_ = ~sure & ~synonym & F.col("own").isNull()
    return m.select(
        "name", status.alias("status"), accepted.alias("accepted"), F.when(open_ & (n > 1), F.col("targets")).alias("candidates"),
        F.when((status == "not_found") & F.col("match_type").isin("FUZZY", "HIGHERRANK"), F.col("canonical")).alias("suggested"),
    )


#: Decisions on unknown names in order of precedence, and the bucket each leads to.
TRIAGE = {"resolved": "resolved", "common_resolved": "resolved", "species_ambiguous": "species_ambiguous", "genus_level": "genus_level", "non_botanical": "non_botanical", "unresolvable": "unresolvable"}


def triage(unknown: DataFrame, decisions: DataFrame) -> DataFrame:
    """``unknown(name)`` under ``decisions(name, decision, value)``: of several decisions the first in the order of ``TRIAGE``
    holds, and a name without one is a common name.  Raises if a decision's name is not unknown."""
    check_subset(decisions, unknown, "name")
    rank = F.array_position(F.array(*map(F.lit, TRIAGE)), F.col("decision"))
    first = decisions.where(rank > 0).groupBy("name").agg(F.min_by(F.struct("decision", "value"), F.struct(rank, "value")).alias("d"))
    bucket = F.element_at(F.create_map(*[F.lit(x) for pair in TRIAGE.items() for x in pair]), F.col("d.decision"))
    j = unknown.select("name").distinct().join(first, "name", "left").withColumn("bucket", F.coalesce(bucket, F.lit("common_name")))
    return j.select(
        "name", "bucket", F.when(F.col("bucket") == "resolved", F.col("d.value")).alias("accepted_name"), F.when(F.col("bucket").isin("genus_level", "non_botanical"), F.col("d.value")).alias("identity"),
        F.coalesce(F.col("d.decision") == "common_resolved", F.lit(False)).alias("outside_authority"),
    )


def dispose(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Authority results with human decisions laid over: ``decisions(name, action, target)`` with accept, correct (a typo's
    suggestion, if no target is given), ambiguous, trade_ambiguous, exclude or genus.

    Gives ``group_key`` and ``resolution_status``; an excluded name has none, and a typo without a decision stays unknown."""
    j = results.join(decisions, "name", "left")
    act = F.coalesce("action", F.lit(""))
    unsure = act.isin("ambiguous", "trade_ambiguous") | ((act == "") & F.col("ambiguous"))
    chosen = F.when(act.isin("accept", "genus"), F.col("target")).when(act == "correct", F.coalesce("target", "suggested")).when(act == "", F.col("accepted"))
    key = F.when(act == "exclude", None).when(unsure, F.concat(F.lit("amb:"), "name")).otherwise(F.coalesce(chosen, F.concat(F.lit("unk:"), "name")))
    status = (
        F.when(act == "exclude", "excluded").when(act == "accept", "owner-resolved").when(act == "genus", "genus_level").when(act == "correct", "typo-corrected").when(act == "trade_ambiguous", "trade_ambiguous")
        .when(unsure, "species_ambiguous").when(F.col("accepted").isNull(), "trade_ambiguous").when(F.col("disposition") == "accepted", "accepted").otherwise("synonym-resolved")
    )
    return j.select("name", key.alias("group_key"), status.alias("resolution_status"), "candidates")


def group_records(disposed: DataFrame) -> DataFrame:
    """One record per group: the status of its best member, its names, and how many; ambiguous groups have no accepted name."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("resolution_status"))
    g = disposed.where("group_key is not null").groupBy("group_key").agg(
        F.min_by("resolution_status", F.struct(rank, "name")).alias("resolution_status"), F.array_sort(F.collect_set("name")).alias("original_parsed_names"),
        F.count("*").alias("n_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"),
    )
    ambiguous = F.col("resolution_status").isin("species_ambiguous", "trade_ambiguous")
    return g.select("group_key", F.when(~ambiguous, F.col("group_key")).alias("accepted_name"), "resolution_status", ambiguous.alias("ambiguity_flag"), "original_parsed_names", "n_names", "candidates")


def allot_ids(names: DataFrame, used: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``canonical_id``, which no other row gets and ``used(canonical_id)`` does not have.

    A name's base is its slug.  The first name of a free base, by name, takes it as it is; the others of a base take the smallest
    numbers from 2 up that are free, in order of name.  Which numbers are taken before is a running sum over the base's used
    ones, so neither many names of one base nor many used ids meet in one task.  ``names`` has different values in ``name``;
    other columns go along.
    """
    based = names.withColumn("_base", slug(name))
    ids = used.select("canonical_id").distinct()
    firsts = based.groupBy(F.col("_base").alias("_of")).agg(F.min(name).alias("_first")).join(ids.select(F.col("canonical_id").alias("_of")), "_of", "left_anti")
    rows = based.join(firsts, (F.col("_base") == F.col("_of")) & (F.col(name) == F.col("_first")), "left").drop("_of")
    own = rows.where("_first is not null").drop("_first").withColumn("canonical_id", F.col("_base"))
    rest = rows.where("_first is null").drop("_first")
    # Numbers of the bases in question that are taken, by the used ids and by what was given just now.
    taken = ids.unionByName(own.select("canonical_id")).select(F.regexp_extract("canonical_id", "^(.*)-([1-9][0-9]*)$", 1).alias("_base"), F.regexp_extract("canonical_id", "^(.*)-([1-9][0-9]*)$", 2).try_cast("long").alias("u"))
    taken = taken.where("u >= 2").distinct().join(rest.select("_base").distinct(), "_base", "left_semi")
    # Of the free numbers from 2 up the i-th is i + 1 plus the taken ones u_j, the j-th, with u_j - j - 1 < i.
    gaps = scan.carried(scan.ordered(taken, ["_base"], ["u"]), ["_base"], F.lit(1), "j", "sum").select("_base", (F.col("u") - F.col("j") - 1).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("n"))
    asked = scan.carried(scan.ordered(rest.select("_base", F.col(name).alias("n")), ["_base"], ["n"]), ["_base"], F.lit(1), "at", "sum").select("_base", "at", F.lit(0).alias("kind"), "n")
    both = scan.carried(scan.ordered(gaps.unionByName(asked), ["_base"], ["at", "kind", "n"]), ["_base"], "kind", "before", "sum").where("kind = 0")
    given = both.select(F.col("n").alias("_n"), F.concat("_base", F.lit("-"), (F.col("at") + 1 + F.col("before")).cast("string")).alias("canonical_id"))
    numbered = rest.join(given, rest[name] == given["_n"]).drop("_n")
    return own.unionByName(numbered).drop("_base")


def with_ids(records: DataFrame, name: str = "group_key") -> DataFrame:
    """Adds ``canonical_id`` to records without ids: the slug, and ``-2``, ``-3`` ... for later records of one slug in order of
    name; a number that is another record's slug is passed over."""
    return allot_ids(records, records.sparkSession.createDataFrame([], "canonical_id string"), name)


def _arrays(prefix: str = "") -> list:
    out = []
    for c in NAME_ARRAYS:
        out.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c))
    return out


def merge_records(identities: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges(absorb_id, keep_id, drop_name)``: the absorbed record's names join the kept record's, its accepted one as a
    synonym if it is scientific and not dropped; an edge with a missing end is skipped.

    Chains end at their last keeper.  A round doubles the length of chains followed, and its result is cut from its lineage;
    a chain that has not ended when its length is the number of edges is a cycle, which raises, as does an id that is
    absorbed by several.
    """
    ids = identities.select("canonical_id")
    edges = edges if "drop_name" in edges.columns else edges.withColumn("drop_name", F.lit(False))
    live = edges.join(ids, edges["absorb_id"] == ids["canonical_id"], "left_semi").join(ids, edges["keep_id"] == ids["canonical_id"], "left_semi").select("absorb_id", "keep_id", F.coalesce("drop_name", F.lit(False)).alias("drop_name"))
    if not live.groupBy("absorb_id").count().where("count > 1").isEmpty():
        raise ValueError("an id is absorbed by several")
    target = live = cut_lineage(live)
    for _ in range(live.count().bit_length() + 1):
        if not target.where("absorb_id = keep_id").isEmpty():
            raise ValueError("the merges have a cycle")
        nxt = target.select(F.col("absorb_id").alias("keep_id"), F.col("keep_id").alias("_far"))
        step = target.join(nxt, "keep_id", "left")
        if step.where("_far is not null").isEmpty():
            break
        target = cut_lineage(step.select("absorb_id", F.coalesce("_far", "keep_id").alias("keep_id"), "drop_name"))
    else:
        raise ValueError("the merges have a cycle")
    moved = identities.join(target, identities["canonical_id"] == target["absorb_id"], "left").withColumn("_to", F.coalesce("keep_id", "canonical_id"))
    own = F.col("keep_id").isNotNull() & ~F.coalesce("drop_name", F.lit(False)) & F.coalesce(is_scientific("accepted_name"), F.lit(False))
    moved = moved.withColumn("scientific_synonyms", F.when(own, F.array_append("scientific_synonyms", F.col("accepted_name"))).otherwise(F.col("scientific_synonyms")))
    merged = moved.groupBy("_to").agg(F.expr("max(accepted_name) FILTER (WHERE keep_id IS NULL)").alias("accepted_name"), (F.count("*") - 1).alias("n_absorbed"), *_arrays())
    return merged.withColumnRenamed("_to", "canonical_id").withColumn("scientific_synonyms", F.array_except("scientific_synonyms", F.array("accepted_name")))


def merge_converged(identities: DataFrame, pinned: DataFrame) -> DataFrame:
    """Records that share an accepted name become one: the survivor is an owner-mapped record if any, then the smallest id.

    Records without an accepted name stay apart."""
    flagged = identities.join(pinned.select("canonical_id").distinct().withColumn("_pin", F.lit(1)), "canonical_id", "left")
    key = F.coalesce(F.lower("accepted_name"), F.concat(F.lit("~"), "canonical_id"))
    g = flagged.withColumn("_key", key).groupBy("_key").agg(
        F.min_by(F.struct("canonical_id", "accepted_name"), F.struct(F.coalesce("_pin", F.lit(2)), "canonical_id")).alias("s"), (F.count("*") - 1).alias("n_absorbed"), *_arrays(),
    )
    out = g.select("s.canonical_id", "s.accepted_name", "n_absorbed", *NAME_ARRAYS)
    return out.withColumn("scientific_synonyms", F.array_except("scientific_synonyms", F.array("accepted_name")))


def upsert(identities: DataFrame, delta: DataFrame, ledger: DataFrame | None = None, v: Vocabulary = DEFAULT) -> DataFrame:
    """``delta(accepted_name, parsed_names, common_names)`` merged into ``identities``, compared by accepted name without case.

    A known record gets the parsed names it lacks, the scientific ones of them as synonyms too, and the common names; an unknown
    name becomes a record with a new id (see ``allot_ids``), which is none of ``identities`` or of ``ledger(canonical_id)``, the
    ids ever given.  Adds ``inserted``, ``n_added`` (common names) and ``n_parsed`` (parsed names).  A name that occurs twice in
    the delta, also in other case, is one; a null name is ignored.
    """
    empty = F.array().cast("array<string>")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, empty)))))
    d = delta.where("accepted_name is not null").groupBy(F.lower("accepted_name").alias("_k")).agg(F.min("accepted_name").alias("_name"), every(F.col("parsed_names")).alias("_parsed"), every(F.col("common_names")).alias("_common"))
    d = cut_lineage(d)
    keyed = identities.withColumn("_k", F.lower("accepted_name"))
    new = d.join(keyed.select("_k"), "_k", "left_anti")
    ids = identities.select("canonical_id")
    new = allot_ids(new.withColumnRenamed("_name", "accepted_name"), ids if ledger is None else ids.unionByName(ledger.select("canonical_id")), "accepted_name")
    blank = {c: empty for c in NAME_ARRAYS}
    both = keyed.select("_k", "canonical_id", "accepted_name", *NAME_ARRAYS).withColumn("inserted", F.lit(False)).unionByName(new.select("_k", "canonical_id", "accepted_name").withColumns(blank).withColumn("inserted", F.lit(True)))
    j = both.join(d.select("_k", F.col("_parsed").alias("_p"), F.col("_common").alias("_c")), "_k", "left").withColumns({c: F.coalesce(c, empty) for c in (*NAME_ARRAYS, "_p", "_c")})
    fresh = F.array_except("_p", "original_parsed_names")
    names = F.filter(fresh, lambda x: is_scientific(x, v.vernacular) & (x != F.col("accepted_name")))
    grown = lambda c, more: F.array_sort(F.array_union(c, more))
    return j.select(
        "canonical_id", "accepted_name", "inserted", F.size(F.array_except("_c", "common_names")).cast("long").alias("n_added"), F.size(fresh).cast("long").alias("n_parsed"),
        grown("original_parsed_names", fresh).alias("original_parsed_names"), grown("scientific_synonyms", names).alias("scientific_synonyms"), "trade_synonyms", grown("common_names", F.col("_c")).alias("common_names"),
    )


def merge_report(identities: DataFrame, edges: DataFrame) -> DataFrame:
    """What becomes of each of the ``edges`` of ``merge_records``: ``(absorb_id, keep_id, absorbed_name, kept_name, status)``, the
    status being ``merged`` or ``skipped`` where one of the two records is missing."""
    name = lambda c: identities.select(F.col("canonical_id").alias(c), F.col("accepted_name").alias(f"{c}_name"), F.lit(True).alias(f"{c}_there"))
    j = edges.select("absorb_id", "keep_id").join(name("absorb_id"), "absorb_id", "left").join(name("keep_id"), "keep_id", "left")
    status = F.when(F.col("absorb_id_there") & F.col("keep_id_there"), "merged").otherwise("skipped")
    return j.select("absorb_id", "keep_id", F.col("absorb_id_name").alias("absorbed_name"), F.col("keep_id_name").alias("kept_name"), status.alias("status"))


#: What a patch sets, beside names: columns of a patched record.
_STATE = (
    ("accepted_name", "string"), ("genus", "string"), ("species", "string"), ("infra", "string"), ("accepted_rank", "string"), ("usage_key", "string"), ("scientific_synonyms", "array<string>"), ("common_names", "array<string>"),
    ("resolution_status", "string"), ("ambiguity_flag", "boolean"), ("candidates", "array<string>"), ("authority_synonym", "string"), ("adjudication", "string"), ("note", "string"), ("review_date", "string"),
)
_OUTCOMES = "array<struct<place: bigint, outcome: string>>"
PATCH_SCHEMA = "place long, action string, by string, target string, value string, names array<string>, note string, date string"


def _applied(state: Column, p: Column) -> Column:
    """A record's state after one patch."""
    is_ = lambda a: p["action"] == a
    old = {c: state[c] for c, _ in _STATE}
    empty, none = F.array().cast("array<string>"), F.lit(None)
    names = F.coalesce(p["names"], empty)
    parts = name_parts(p["value"])
    with_synonym = lambda x: F.when(x.isNull() | F.array_contains(old["scientific_synonyms"], F.coalesce(x, F.lit(""))), old["scientific_synonyms"]).otherwise(F.array_sort(F.array_append(old["scientific_synonyms"], x)))
    adopts = is_("adopt") & ~old["accepted_name"].eqNullSafe(p["value"])
    keeps = is_("keep_synonym") & ~old["accepted_name"].eqNullSafe(p["value"])
    adds, removes = is_("add_common"), is_("remove_common")
    commons = F.when(adds, F.array_sort(F.array_union(old["common_names"], names))).when(removes, F.array_except(old["common_names"], names)).otherwise(old["common_names"])
    pick = lambda c, adopted, unsure: F.when(is_("adopt"), adopted).when(is_("ambiguous"), unsure).otherwise(old[c])
    new = old | {
        "accepted_name": pick("accepted_name", p["value"], none), "genus": pick("genus", parts["genus"], none), "species": pick("species", parts["species"], none), "infra": pick("infra", parts["infra"], none),
        "accepted_rank": pick("accepted_rank", parts["rank"], none), "usage_key": pick("usage_key", none, none), "scientific_synonyms": F.when(adopts, with_synonym(old["accepted_name"])).when(keeps, with_synonym(p["value"])).otherwise(old["scientific_synonyms"]),
        "common_names": commons, "resolution_status": F.when(is_("ambiguous"), "trade_ambiguous").otherwise(old["resolution_status"]), "ambiguity_flag": old["ambiguity_flag"] | is_("ambiguous"),
        "candidates": F.when(is_("ambiguous"), names).otherwise(old["candidates"]), "authority_synonym": F.when(is_("keep_synonym"), p["value"]).otherwise(old["authority_synonym"]),
        "adjudication": F.when(p["action"].isin("adopt", "keep_synonym", "ambiguous"), p["action"]).otherwise(old["adjudication"]), "note": F.coalesce(p["note"], old["note"]), "review_date": F.coalesce(p["date"], old["review_date"]),
    }
    same = F.when(is_("adopt"), ~adopts).when(adds, F.size(F.array_except(names, old["common_names"])) == 0).when(removes, ~F.arrays_overlap(names, old["common_names"])).when(is_("note"), F.lit(True)).otherwise(F.lit(False))
    idle = same & (p["note"].isNull() | old["note"].eqNullSafe(p["note"])) & (p["date"].isNull() | old["review_date"].eqNullSafe(p["date"])) & ~p["created"]
    done = F.array_append(state["outcomes"], F.struct(p["place"].alias("place"), F.when(p["created"], "created").when(idle, "skipped").otherwise("applied").alias("outcome")))
    return F.struct(*[F.when(idle, old[c]).otherwise(new[c].cast(kind)).alias(c) for c, kind in _STATE], done.cast(_OUTCOMES).alias("outcomes"))


def _targets(identities: DataFrame, patches: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(place, id)`` of the patches that have a record, and ``(canonical_id, accepted_name, since)`` of the records to create.

    A name means the record that got it last before the patch: as its accepted name at first, by an adoption or by being created.
    Adoptions may aim at names that earlier ones gave, so names are found round by round until they no longer change."""
    by_name = patches.where("by = 'name'").withColumn("k", F.lower("target"))
    ids = identities.select("canonical_id")
    used = ids if ledger is None else ids.unionByName(ledger.select("canonical_id"))
    at_id = patches.where("by = 'id'").join(ids, patches["target"] == ids["canonical_id"], "left_semi").select("place", "action", "value", F.col("target").alias("id"))
    gives = lambda found: found.where("id is not null and action = 'adopt'").select(F.lower("value").alias("k"), "id", F.col("place").alias("since"))
    first = identities.where("accepted_name is not null").groupBy(F.lower("accepted_name").alias("k")).agg(F.max("canonical_id").alias("id")).withColumn("since", F.lit(-1).cast("long"))

    def resolve(known: DataFrame) -> DataFrame:
        at = known.select(F.col("k").alias("_k"), "id", "since")
        seen = by_name.join(at, (F.col("k") == F.col("_k")) & (F.col("since") < F.col("place")), "left")
        return cut_lineage(seen.groupBy("place", "action", "k", "target", "value").agg(F.max_by("id", "since").alias("id")))

    adopted = cut_lineage(gives(at_id))
    for _ in range(patches.count() + 2):
        known = first.unionByName(adopted)
        lost = resolve(known).where("id is null and action = 'add_common'").groupBy("k").agg((F.min("place") - 1).alias("since"), F.min_by("target", "place").alias("accepted_name"))
        created = cut_lineage(allot_ids(lost, used, "accepted_name"))
        found = resolve(known.unionByName(created.select("k", F.col("canonical_id").alias("id"), "since")))
        now = cut_lineage(gives(at_id).unionByName(gives(found)))
        if now.exceptAll(adopted).isEmpty() and adopted.exceptAll(now).isEmpty():
            break
        adopted = now
    else:
        raise ValueError("the patches' names do not settle")
    return found.where("id is not null").select("place", "id").unionByName(at_id.select("place", "id")), created


def patch(identities: DataFrame, patches: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A log of patches (``PATCH_SCHEMA``; ``place`` tells them apart and orders them) over ``identities``: the records, and a
    report ``(place, action, target, canonical_id, outcome)``.

    Actions: ``adopt`` (``value`` becomes the accepted name, the old one a synonym; name parts and rank follow it, the authority's
    key goes), ``keep_synonym`` (``value`` is the authority's name and a synonym), ``ambiguous`` (the name and all that follows
    it go, ``names`` are the candidates), ``add_common`` and ``remove_common`` (``names``) and ``note``; a note and a date are
    stamped by each.  A target is an accepted name (``by`` = ``name``, without case) or an id (``id``); ``add_common`` on a name
    that no record has creates one with a new id.  A record's patches are folded in order by one aggregate, so a later one sees
    what an earlier one did.  Outcomes: ``applied``, ``created``, ``skipped`` (nothing to change) and ``not_found``.  Records
    without patches stay as they are; columns of ``_STATE`` that ``identities`` lacks are added as nulls, the flag as false.
    """
    patches = cut_lineage(patches.select(*[F.col(x.split()[0]) for x in PATCH_SCHEMA.split(", ")]))
    found, created = _targets(identities, patches, ledger)
    found = cut_lineage(found)
    kept = [c for c in identities.columns if c not in dict(_STATE)]
    state = {c: F.col(c).cast(kind) if c in identities.columns else F.lit(None).cast(kind) for c, kind in _STATE}
    state |= {c: F.coalesce(state[c], F.array().cast("array<string>")) for c in ("scientific_synonyms", "common_names")}
    state["ambiguity_flag"] = F.coalesce(state["ambiguity_flag"], F.lit(False))
    records = identities.select(*kept, F.struct(*[x.alias(c) for c, x in state.items()], F.array().cast(_OUTCOMES).alias("outcomes")).alias("_state"))
    parts = name_parts("accepted_name")
    born = {c: F.lit(None) for c, _ in _STATE} | {
        "accepted_name": F.col("accepted_name"), "genus": parts["genus"], "species": parts["species"], "infra": parts["infra"], "accepted_rank": parts["rank"], "scientific_synonyms": F.array(), "common_names": F.array(),
        "resolution_status": F.lit("owner-common-mapped"), "ambiguity_flag": F.lit(False),
    }
    extra = {c: F.col("canonical_id") if c == "canonical_id" else F.array("accepted_name") if c == "original_parsed_names" else F.array() if c in NAME_ARRAYS else F.lit(None) for c in kept}
    types = dict(identities.dtypes)
    new = created.select(*[x.cast(types[c]).alias(c) for c, x in extra.items()], F.struct(*[born[c].cast(kind).alias(c) for c, kind in _STATE], F.array().cast(_OUTCOMES).alias("outcomes")).alias("_state"))
    makes = created.select(F.col("since") + 1).toDF("_made")
    logged = patches.join(found, "place").join(makes, F.col("place") == F.col("_made"), "left")
    each = F.struct("place", "action", "value", "names", "note", "date", F.col("_made").isNotNull().alias("created"))
    logs = logged.groupBy(F.col("id").alias("canonical_id")).agg(F.array_sort(F.collect_list(each)).alias("_log"))
    folded = records.unionByName(new).join(logs, "canonical_id", "left").withColumn("_state", F.when(F.col("_log").isNull(), F.col("_state")).otherwise(F.aggregate("_log", F.col("_state"), _applied)))
    folded = cut_lineage(folded.drop("_log"))
    outcomes = folded.select("canonical_id", F.inline("_state.outcomes"))
    report = patches.select("place", "action", "target").join(outcomes, "place", "left").select("place", "action", "target", "canonical_id", F.coalesce("outcome", F.lit("not_found")).alias("outcome"))
    return folded.select(*kept, *[F.col(f"_state.{c}").alias(c) for c, _ in _STATE]), report


def check_accounting(kept: int, excluded: int, total: int) -> None:
    """Fail closed unless every input is either kept or excluded."""
    if kept + excluded != total:
        raise ValueError(f"{kept} kept and {excluded} excluded are not {total}")


def check_same_set(left: DataFrame, right: DataFrame, column: str) -> None:
    """Fail closed unless both have the same values."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError(f"the values of {column} differ")


def check_subset(left: DataFrame, right: DataFrame, column: str) -> None:
    """Fail closed unless every value on the left is on the right."""
    if not left.join(right, column, "left_anti").isEmpty():
        raise ValueError(f"values of {column} are missing on the right")


def alias_pool(keys: Column, corrected: Column, accepted: Column, trade: Column, v: Vocabulary = DEFAULT) -> Column:
    """Struct of ``scientific`` and ``common``: parsed keys and corrected names, without the accepted name and trade names."""
    empty = F.array().cast("array<string>")
    every = F.array_union(F.coalesce(keys, empty), F.coalesce(corrected, empty))
    pool = F.array_sort(F.array_except(every, F.array_append(F.coalesce(trade, empty), F.coalesce(accepted, F.lit("")))))
    return F.struct(F.filter(pool, lambda a: is_scientific(a, v.vernacular)).alias("scientific"), F.filter(pool, lambda a: ~is_scientific(a, v.vernacular)).alias("common"))


def flip_names(identities: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """Records whose ``authority_name`` differs from their accepted one: the authority's becomes accepted, and the old one is
    a synonym (if scientific), the trade name and what is displayed; ids never change."""
    flip = F.col("authority_name").isNotNull() & F.col("accepted_name").isNotNull() & (F.col("authority_name") != F.col("accepted_name"))
    without = F.array_except("scientific_synonyms", F.array("authority_name"))
    synonyms = F.when(is_scientific("accepted_name", v.vernacular), F.array_union(without, F.array("accepted_name"))).otherwise(without)
    accepted = F.when(flip, F.col("authority_name")).otherwise(F.col("accepted_name"))
    out = identities.withColumns({"_syn": F.when(flip, F.array_sort(synonyms)).otherwise(F.col("scientific_synonyms")), "_acc": accepted, "trade_primary_name": F.when(flip, F.col("accepted_name"))})
    out = out.withColumn("canonical_display_name", F.coalesce("trade_primary_name", "_acc"))
    return out.drop("scientific_synonyms", "accepted_name").withColumnsRenamed({"_syn": "scientific_synonyms", "_acc": "accepted_name"})


def enrichment(results: DataFrame) -> DataFrame:
    """``results(ord, name, disposition, accepted, ambiguous)`` -> one row per accepted name that accepted or unambiguous
    synonym names give: ``via`` the disposition seen first, and the names."""
    rows = results.where("accepted is not null and (disposition = 'accepted' or (disposition = 'synonym' and not ambiguous))")
    return rows.groupBy(F.col("accepted").alias("accepted_name")).agg(F.min_by("disposition", "ord").alias("via"), F.array_sort(F.collect_set("name")).alias("parsed_names"))


def mapping_round(mappings: DataFrame, corrections: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mappings(common_name, accepted)`` without excluded names and with corrected targets, all compared by key:
    ``(accepted, common_names, n_corrected)`` per target, and the excluded mappings."""
    rows = mappings.withColumn("_key", norm("common_name"))
    out = exclusions.select(norm("common_name").alias("_key")).distinct()
    fixed = corrections.groupBy(norm("common_name").alias("_key")).agg(F.max("accepted").alias("_fixed"))
    kept = rows.join(out, "_key", "left_anti").join(fixed, "_key", "left")
    grouped = kept.groupBy(F.coalesce("_fixed", "accepted").alias("accepted")).agg(F.array_sort(F.collect_set("common_name")).alias("common_names"), F.count_if(F.col("_fixed").isNotNull()).alias("n_corrected"))
    return grouped, rows.join(out, "_key", "left_semi").drop("_key")


def adopt(records: DataFrame, adoptions: DataFrame, expected: int) -> DataFrame:
    """``adoptions(name, accepted)`` laid over ``records(name, accepted_name)``; raises unless exactly ``expected`` are adopted."""
    j = records.join(adoptions.select("name", F.col("accepted").alias("_new")), "name", "left")
    n = j.where("_new is not null").count()
    if n != expected:
        raise ValueError(f"{n} names adopted, not {expected}")
    return j.withColumn("accepted_name", F.coalesce("_new", "accepted_name")).withColumn("adopted", F.col("_new").isNotNull()).drop("_new")
