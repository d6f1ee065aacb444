"""Name indices over an identity table: exact by rank, common names as an inverted index, derived keys with a guard.

An identity table has ``rec_ord, canonical_id, accepted_name, original_parsed_names, scientific_synonyms,
trade_synonyms, common_names``; the last four are arrays of strings.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT, Vocabulary, norm, part_strip

#: Rank and label of each kind of exact name.
METHODS = (("accepted_name", 0, "accepted_name_exact"), ("original_parsed_names", 1, "original_parsed_name_exact"), ("scientific_synonyms", 2, "scientific_synonym_exact"), ("trade_synonyms", 3, "trade_synonym_exact"))


def exact_index(identities: DataFrame) -> DataFrame:
    """``(key, rank, method, canonical_id)``, unique by key: the lowest rank wins, then the earliest record and value."""
    rows = None
    for name, rank, method in METHODS:
        values = F.array("accepted_name") if name == "accepted_name" else F.col(name)
        part = identities.select("rec_ord", "canonical_id", F.posexplode(values).alias("val_ord", "value")).select("rec_ord", "canonical_id", "val_ord", norm("value").alias("key"), F.lit(rank).alias("rank"), F.lit(method).alias("method"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.where("key <> ''").groupBy("key").agg(F.min_by(F.struct("rank", "method", "canonical_id"), F.struct("rank", "rec_ord", "val_ord")).alias("b"))
    return best.select("key", "b.rank", "b.method", "b.canonical_id")


def common_index(identities: DataFrame) -> DataFrame:
    """``(key, cids)``: each common name's key with the sorted ids that bear it."""
    rows = identities.select("canonical_id", F.explode("common_names").alias("c")).select(norm("c").alias("key"), "canonical_id")
    return rows.where("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set("canonical_id")).alias("cids"))


def derived_keys(identities: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``(key, derived)``: keys of at least three characters that stripping makes of common names, with their ids."""
    rows = identities.select("canonical_id", F.explode("common_names").alias("c")).select("canonical_id", norm("c").alias("raw"), norm(part_strip("c", v)).alias("key"))
    return rows.where((F.length("key") >= 3) & (F.col("key") != F.col("raw"))).groupBy("key").agg(F.array_sort(F.collect_set("canonical_id")).alias("derived"))


def guarded_common_index(identities: DataFrame, pins: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``(key, cids, origin, all_cids)`` of common and derived keys together.

    A derived key that names one identity is added if the key is new (``derived``); one that names several is pinned if
    ``pins(key, pin)`` has one of them (``pinned``, also over a raw key), else it is held back (``quarantined``): such a row
    keeps the raw key's ids, or none.
    """
    both = common_index(identities).join(derived_keys(identities, v), "key", "full_outer").join(pins, "key", "left")
    every = F.array_sort(F.array_union(F.coalesce("cids", F.array().cast("array<string>")), F.coalesce("derived", F.array().cast("array<string>"))))
    many = F.col("derived").isNotNull() & (F.size(every) > 1)
    pinned = many & F.coalesce(F.array_contains(every, F.col("pin")), F.lit(False))
    origin = F.when(pinned, "pinned").when(many, "quarantined").when(F.col("cids").isNull(), "derived").otherwise("raw")
    ids = F.when(pinned, F.array("pin")).when(F.col("cids").isNotNull(), F.col("cids")).when(~many, F.col("derived"))
    return both.select("key", ids.alias("cids"), origin.alias("origin"), every.alias("all_cids"))


def serving_common(identities: DataFrame, pins: DataFrame, v: Vocabulary = DEFAULT) -> DataFrame:
    """``(key, cids)`` as resolvers use it: without held-back keys that are no raw keys."""
    return guarded_common_index(identities, pins, v).where("cids is not null").select("key", "cids")


#: Columns of an identity table that the indices are made of.
SOURCE = ("rec_ord", "canonical_id", "accepted_name", "original_parsed_names", "scientific_synonyms", "trade_synonyms", "common_names")
#: Raised when the indices of the same records come out otherwise, so that older artifacts are not read.
FORMAT = 1


def version_of(identities: DataFrame, pins: DataFrame, v: Vocabulary = DEFAULT) -> str:
    """A digest of the records, pins and vocabulary: sums of row hashes, so one pass and no order."""
    sums = lambda df, cols: df.agg(*[F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)], F.count(F.lit(1)).alias("n")).first()
    told = (FORMAT, tuple(sums(identities, SOURCE)), tuple(sums(pins, ("key", "pin"))), repr(v))
    return hashlib.md5(repr(told).encode()).hexdigest()


class IndexStore:
    """Versioned artifacts of the exact and common index under a shared folder, made once for each state of the records.

    A version is a digest of what the indices are made of, so a wrong or stale index cannot be opened.  Its tables are bucketed and
    sorted by key: a resolver shuffles its names by key to the same buckets and reads the index where it lies.  A build writes to
    a folder of its own and publishes it last, by creating a manifest that must not exist; a build that fails publishes nothing,
    so the next one starts anew, and of two at once the first to publish is read by both.
    """

    #: Kinds of artifact, with their columns.
    TABLES = {"exact": "key STRING, rank INT, method STRING, canonical_id STRING", "common": "key STRING, cids ARRAY<STRING>"}
    _known: dict[tuple[str, str], str] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def published(self, version: str) -> tuple[str, int] | None:
        """Folder and number of buckets of a version, if there is one."""
        at, fs = self._fs(f"{self.root}/{version}/manifest.json")
        if not fs.exists(at):
            return None
        told = json.loads(self.spark.read.text(at.toString(), wholetext=True).first()[0])
        return told["folder"], told["buckets"]

    def _publish(self, version: str, folder: str, buckets: int) -> None:
        at, fs = self._fs(f"{self.root}/{version}/manifest.json")
        try:
            out = fs.create(at, False)
        except Exception:
            if not fs.exists(at):
                raise
            return  # another build was first
        out.write(bytearray(json.dumps({"folder": folder, "buckets": buckets}).encode()))
        out.close()

    def build(self, identities: DataFrame, pins: DataFrame, version: str, v: Vocabulary = DEFAULT) -> None:
        """Write and publish a version."""
        folder = f"{self.root}/{version}/{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for kind, df in (("exact", exact_index(identities)), ("common", serving_common(identities, pins, v))):
            name = f"building_{uuid.uuid4().hex}"
            try:
                df.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").format("parquet").option("path", f"{folder}/{kind}").saveAsTable(name)
            finally:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
        self._publish(version, folder, buckets)

    def open(self, identities: DataFrame, pins: DataFrame, v: Vocabulary = DEFAULT) -> tuple[DataFrame, DataFrame]:
        """The exact and common index of these records, built if this version was never published."""
        version = version_of(identities, pins, v)
        if self.published(version) is None:
            self.build(identities, pins, version, v)
        folder, buckets = self.published(version)
        return self._table("exact", version, folder, buckets), self._table("common", version, folder, buckets)

    def _table(self, kind: str, version: str, folder: str, buckets: int) -> DataFrame:
        name, place = f"resolvent_{kind}_{version}", (self.spark.sparkContext.applicationId, f"{folder}/{kind}")
        if self._known.get(place) != name or not self.spark.catalog.tableExists(name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.spark.sql(f"CREATE TABLE {name} ({self.TABLES[kind]}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place[1]}'")
            self._known[place] = name
        return self.spark.table(name)
