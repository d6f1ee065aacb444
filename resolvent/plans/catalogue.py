"""The reference concepts on the driver's tables: part names are identities, line items are catalogue rows.

Names such as "blue anvil" become a two-word scientific name (noun first) with synonyms and common names; titles,
types, suppliers and small decision tables are derived by fixed rules, the same on both sides of every comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..session import for_application, table

#: Small dimension tables of the queries, as rows.
TYPE_MAP = [("STANDARD", "MP", ""), ("MEDIUM", "RE", ""), ("LARGE", "WD", "SE"), ("SMALL", "OE", "")]
OUT_OF_SCOPE = ["promo"]
PINS = [("gear", "hot-gear")]
PHASES = ["dry-solid", "aqueous", "oil", "emulsion", "suspension-dispersion", "application-dependent"]


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", F.split("p_name", " ")[0].alias("adj"), F.split("p_name", " ")[1].alias("noun"))


def identities(spark: SparkSession, sf: str) -> DataFrame:
    n = names(spark, sf)
    cap = F.concat(F.upper(F.substring("noun", 1, 1)), F.substr("noun", F.lit(2)))
    return n.select(
        F.concat_ws("-", "adj", "noun").alias("rec_ord"), F.concat_ws("-", "adj", "noun").alias("canonical_id"),
        F.concat_ws(" ", cap, "adj").alias("accepted_name"), F.array("p_name").alias("original_parsed_names"),
        F.array(F.concat(F.col("noun"), F.lit("us "), F.col("adj"))).alias("scientific_synonyms"),
        F.when(F.col("adj") == "blue", F.array(F.concat(F.col("noun"), F.lit(" azure")))).otherwise(F.array().cast("array<string>")).alias("trade_synonyms"),
        F.array(F.concat("p_name", F.lit(" seed")), F.col("noun"), F.concat("adj", "noun"), F.concat(F.col("noun"), F.lit(" root"))).alias("common_names"),
    )


def indices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The exact and common index of the identities, from the application's artifacts."""
    return index.IndexStore(spark, for_application(spark, "indices")).open(identities(spark, sf), pins(spark))


def _case(default, cases: dict[str, object]):
    """A value per record, by its id."""
    out = None
    for k, x in cases.items():
        hit = F.col("canonical_id") == k
        x = x if not isinstance(x, str) and x is not None else F.lit(x)
        out = F.when(hit, x) if out is None else out.when(hit, x)
    return out.otherwise(default)


#: Provenance of records, by id; the others have that of their adjective or a plain one.
PROVENANCE = {
    "red-rod": '{"enriched_by": "w1"}', "red-bolt": '{"enriched_by": []}', "red-ring": None, "red-plate": "text", "red-gear": '{"note": 1}',
    "blue-rod": '{"accepted_outside_authority": true, "resolved_by": "owner"}', "blue-gear": '{"accepted_outside_authority": true, "resolved_by": "Authority", "query_date": "2024-01-01"}',
    "blue-bolt": '{"accepted_outside_authority": true, "authority": "a", "recheck": {"query_date": "2024-01-01"}}',
}
PROVENANCE_OF = {"red": '{"enriched_by": ["w1"]}', "blue": '{"accepted_outside_authority": true, "resolved_by": "owner", "review_date": "2024-02-01"}'}
PLAIN_PROVENANCE = '{"authority": "a", "query_date": "2024-01-01"}'
#: Fields of records that differ from what the name says, by id.
ACCEPTED = {"old-bolt": None, "old-rod": "rod Old 3", "old-plate": "Anvil red", "cold-anvil": "Anvil × cold"}
AUTHORITY = {**ACCEPTED, "old-gear": "Gear antiqua"}
STATUS = {"old-bolt": "trade_ambiguous", "old-ring": "species_ambiguous", "hot-gear": "genus_level", "new-gear": "genus_level"}
RANK = {"hot-bolt": "CLADE", "hot-gear": "VARIETY", "new-gear": "GENUS", "hot-plate": None}
DISPLAY = {"old-bolt": None, "old-ring": None, "cold-ring": "Cold ring", "cold-gear": "Trade gear", "cold-rod": "Rod cold"}
TRADE = {"cold-gear": "Trade gear", "cold-rod": "Rod cold", "cold-plate": "Other plate"}


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The identities as full records, with a few that each audit must find; one record is there twice."""
    i = identities(spark, sf).withColumn("adj", F.split("canonical_id", "-")[0]).withColumn("noun", F.split("canonical_id", "-")[1])
    cap = F.initcap("noun")
    own = F.col("accepted_name")
    out = i.select(
        "rec_ord", "canonical_id", _case(own, ACCEPTED).alias("accepted_name"), _case(own, AUTHORITY).alias("authority_accepted_name"), "original_parsed_names",
        _case(F.array(F.concat(cap, F.lit("us "), F.col("adj"))), {"cold-bolt": F.array(F.lit("bad Synonym"), F.lit("Boltus cold")), "new-rod": F.array(F.lit("Rod old"), F.lit("Gizmo novus"), F.lit("Holy basil"))}).alias("scientific_synonyms"),
        "trade_synonyms", _case(F.col("common_names"), {"new-plate": F.array().cast("array<string>"), "new-anvil": F.array(F.lit("anvil"))}).alias("common_names"),
        _case(F.lit("SPECIES"), RANK).alias("accepted_rank"), _case(cap, {"hot-ring": None}).alias("genus"), F.col("adj").alias("species"), _case(F.lit(None).cast("string"), {"hot-rod": "x"}).alias("infraspecific_epithet"),
        _case(F.lit("accepted"), STATUS).alias("resolution_status"), _case(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROVENANCE_OF.items() for x in kv]), F.col("adj")), F.lit(PLAIN_PROVENANCE)), PROVENANCE).alias("provenance"),
        _case(F.lit(None).cast("string"), TRADE).alias("trade_primary_name"), _case(_case(own, AUTHORITY), DISPLAY).alias("canonical_display_name"),
    )
    return out.unionByName(out.where("canonical_id = 'new-bolt'"))


def pins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PINS, "key string, pin string")


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` with ``title`` and ``latin``: six shapes of title, and a scientific name for every fourth part."""
    adj, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    cap = F.concat(F.upper(F.substring(noun, 1, 1)), F.substr(noun, F.lit(2)))
    k = F.pmod("p_partkey", F.lit(6))
    title = (
        F.when(k == 0, F.concat_ws(" ", cap, adj)).when(k == 1, F.col("p_name")).when(k == 2, F.concat_ws(" ", noun, F.lower("p_type")))
        .when(k == 3, F.concat(F.lit("Promo ("), cap, F.lit(" "), adj, F.lit(") "), F.col("p_name"))).when(k == 4, F.concat(adj, F.lit(" powder"))).otherwise(F.concat("p_name", F.lit(" - "), F.col("p_brand")))
    )
    return table(spark, sf, "part").withColumn("title", title).withColumn("latin", F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.concat_ws(" ", cap, adj)))


def type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_MAP, "map_type string, base string, overlays string")


def out_of_scope(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in OUT_OF_SCOPE], "substr string")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as catalogue rows: supplier, type, title, part of the plant (by return flag) and identity."""
    t = titles(spark, sf).select("p_partkey", "p_name", "p_type", "title")
    rows = table(spark, sf, "lineitem").join(t, F.col("l_partkey") == F.col("p_partkey"))
    known = F.when(F.pmod("p_partkey", F.lit(6)) != 4, F.replace("p_name", F.lit(" "), F.lit("-")))
    return rows.select(F.col("l_suppkey").alias("supplier_id"), F.col("l_orderkey"), "l_linenumber", F.col("p_type").alias("type"), "title", F.col("l_returnflag").alias("part"), known.alias("canonical_id"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Decision cells by brand (product) and type (role), with phase, tag, category and ladders."""
    k = F.pmod(F.crc32(F.concat_ws("|", "p_brand", "p_type").cast("binary")), F.lit(60)).cast("int")
    base = table(spark, sf, "part").select("p_brand", "p_type").distinct().withColumn("k", k)
    codes = F.array(*[F.lit(c) for c in ("MP", "RE", "OE", "SD")])
    return base.select(
        F.col("p_brand").alias("product"), F.col("p_type").alias("role"), "k", F.get(F.array(*[F.lit(p) for p in PHASES]), F.pmod("k", F.lit(6))).alias("phase"),
        F.get(F.array(*[F.lit(x) for x in ("NND", "DISP", "MD", "ASK")]), F.pmod("k", F.lit(4))).alias("tag"),
        F.get(F.array(*[F.lit(x) for x in ("1", "2", "4B", "5", "6")]), F.pmod("k", F.lit(5))).alias("category"),
        F.slice(codes, F.lit(1), F.pmod("k", F.lit(3)).cast("int")).alias("preferred"), F.slice(codes, F.lit(3), F.pmod("k", F.lit(2)).cast("int")).alias("conditional"),
        F.concat(F.lit("Use it for "), F.lower("p_type"), F.lit("  goods.")).alias("rec"), F.when(F.pmod("k", F.lit(3)) == 0, F.concat(F.lit("use it for "), F.lower("p_type"))).otherwise("Grain size matters").alias("reason"),
    )


def cell_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats of the cells: a tier (one outside the usual three), a behaviour and a note for three of four codes."""
    c = cells(spark, sf).select("product", "role", "k")
    rows = c.select("product", "role", "k", F.posexplode(F.array(*[F.lit(x) for x in ("MP", "RE", "OE", "SD")])).alias("i", "code")).where(F.pmod(F.col("k") + F.col("i"), F.lit(4)) != 3)
    tier = F.get(F.array(*[F.lit(x) for x in ("ok", "warn", "avoid", "see text")]), F.pmod(F.col("k") + 2 * F.col("i"), F.lit(4)))
    behaviour = F.get(F.array(*[F.lit(x) for x in ("Dry-solid, water-soluble", "Oil liquid", "water-soluble", "phase matched", "unresolved")]), F.pmod(F.col("k") + F.col("i"), F.lit(5)))
    return rows.select("product", "role", "code", tier.alias("tier"), behaviour.alias("behaviour"), F.when(F.pmod(F.col("k"), F.lit(2)) == 0, F.concat(F.lit("Check the grade of "), F.col("code"), F.lit(". Then ask."))).alias("note"))
