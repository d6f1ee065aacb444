"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints are bit majorities over the XXH64 hashes of word shingles.  Two fingerprints link if they
differ in at most ``radius`` bits.  Candidates come from structured bit masks: bit i gets a non-zero
vector m(i) of radius + 1 bits, and the table of each non-zero vector v keeps the bits whose m(i) has odd
parity with v.  Any ``radius`` vectors leave some v orthogonal to all of them, so every pair within the
radius agrees in some table: no pair is missed.

Equal fingerprints are one node from the start, so copies never form pairs.  A bucket yields a spanning
forest of its links, not all of them, and a bucket beyond ``SPLIT`` fingerprints is dealt anew, in Spark, by radius + 1
groups of the bits that its mask leaves out (a pair within the radius agrees on at least one group).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, padded, pieces, runs, spread, utf8, xxh64
from ._bloom import parted, row_key
from ._spark import durable, tidy, tune
from .components import components

#: Word separators of the contract: space and the controls 9 to 13.
_WORD = np.ones(256, np.uint8)
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_SPREAD = np.array([sum(((x >> b) & 1) << (8 * b) for b in range(8)) for x in range(256)], np.uint64)
#: Fingerprints of a bucket that are compared without a further split.
SPLIT = 8192


def shingle_hashes(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each document's shingles; the second array says where each document begins."""
    starts, ends, _, first = runs(_WORD[buf], off)
    lens = ends - starts
    # The words of each document joined by single spaces, all in one buffer.
    at = np.cumsum(lens + 1) - (lens + 1)
    norm = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    norm[spread(at, lens)] = LOWER[buf[spread(starts, lens)]]
    counts = np.diff(first)
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    index = spread(first[:-1], shingles)
    last = index + np.minimum(np.repeat(counts, shingles), size) - 1
    return xxh64(padded(norm), at[index], at[last] + lens[last]), np.concatenate([[0], np.cumsum(shingles)])


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each document: the bits that over half of its hashes have."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not full.size:
        return out
    parts = -(-n[full] // 255)  # so that counts fit in a byte
    cuts = np.repeat(first[:-1][full], parts) + 255 * spread(np.zeros(len(full), np.int64), parts)
    begins = np.cumsum(parts) - parts
    octets = h.view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(full), 64), bool)
    for k in range(8):
        held = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(held, begins, axis=0, dtype=np.int64) > n[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, key, text)`` of every row; ``key`` is the hash of both."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), row_key(docs).alias("key"), text.alias("text"))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text_hash, key, fp long)``; a text without words has fingerprint 0."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(3))
            fps = [majority(*shingle_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)) for i, j in pieces(off)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate([*fps, np.zeros(0, np.uint64)]).view(np.int64))], ["doc_id", "text_hash", "key", "fp"])

    return keyed_texts(docs).mapInArrow(tidy(run), "doc_id long, text_hash long, key long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks: 2^(radius + 1) - 1 of them, each of about half the bits."""
    values = (1 << (radius + 1)) - 1
    vectors = [i * 7 % values + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, values + 1)]


def _near(a: np.ndarray, b, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _forest(fps: np.ndarray, radius: int):
    """Links that connect what all links within distance ``radius`` in one bucket connect."""
    rest = fps
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            x = queue.pop()
            near = _near(rest, x, radius)
            if near.any():
                found = rest[near]
                yield np.full(len(found), x, np.uint64), found
                queue.extend(found)
                rest = rest[~near]


def _bucket_links(table: np.ndarray, key: np.ndarray, fps: np.ndarray, radius: int):
    """Links in sorted, complete buckets: small ones together by lag, large ones one by one."""
    edge = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
    begins = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([begins, [len(fps)]]))
    small = sizes <= 32
    left = np.repeat(np.where(small, sizes, 0), sizes) - spread(np.zeros(len(sizes), np.int64), sizes)  # rows to the bucket's end
    for lag in range(1, int(left.max(initial=1))):
        at = np.flatnonzero(left > lag)
        at = at[_near(fps[at], fps[at + lag], radius)]
        yield fps[at], fps[at + lag]
    for i in np.flatnonzero(~small):
        yield from _forest(fps[begins[i] : begins[i] + sizes[i]], radius)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _split_masks(mask: int, radius: int) -> list[int]:
    """The mask with one of radius + 1 groups of the bits that it leaves out; none where it leaves out too few.

    A pair within the radius differs in at most ``radius`` groups, so it agrees on all bits of some group."""
    left = [i for i in range(64) if not (mask >> i) & 1]
    return [mask | sum(1 << i for i in left[k :: radius + 1]) for k in range(radius + 1)] if len(left) > radius else []


def links(nodes: DataFrame, radius: int = 3, split: int = SPLIT) -> DataFrame:
    """``nodes(fp)``, distinct -> ``(a, b)``: links whose components are those of all pairs within ``radius``.

    A bucket beyond ``split`` is dealt anew by larger masks, in Spark, until it is no longer one or only a radius of bits is
    left out, so no task holds a larger one."""
    level = {(k,): m for k, m in enumerate(masks(radius))}
    out = big = None
    while True:
        table = F.array(*[F.struct(F.lit("-".join(map(str, v))).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for v, m in level.items()])
        if out is None:
            keyed = nodes.select("fp", F.explode(table).alias("t")).select("t.v", "t.key", "fp")
        else:
            own = F.filter(table, lambda t: t["v"].startswith(F.concat(F.col("v"), F.lit("-"))))
            keyed = big.select("fp", F.explode(own).alias("t")).select("t.v", "t.key", "fp")
        sizes = durable(keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("big", F.col("n") > split))
        names = {r["v"] for r in sizes.where("big").select("v").distinct().collect()}  # names of tables, not of buckets
        deeper = {(*v, k): m2 for v, m in level.items() if "-".join(map(str, v)) in names for k, m2 in enumerate(_split_masks(m, radius))}
        again = F.col("big") & F.col("v").isin(*{"-".join(map(str, v[:-1])) for v in deeper}) if deeper else F.lit(False)
        dealt = keyed.join(sizes, ["v", "key"])
        done = _bucket_forests(dealt.where(~again), radius)
        out = done if out is None else out.unionByName(done)
        if not deeper:
            return out
        big, level = durable(dealt.where(again).select("v", "fp")), deeper


def _bucket_forests(keyed: DataFrame, radius: int) -> DataFrame:
    """``keyed(v, key, fp)``, buckets of bounded size -> their links."""

    def run(batches):
        held, table = [np.zeros(0, np.int64)] * 2, np.zeros(0, np.int64)
        for b in _with_end(batches):
            cut = len(table)
            if b is not None:
                code = np.asarray(b.column(0)).astype(np.int64)
                now = [np.asarray(b.column(i)).astype(np.int64) for i in (1, 2)]
                table, held = np.concatenate([table, code]), [np.concatenate([x, y]) for x, y in zip(held, now)]
                if len(table):
                    other = np.flatnonzero((table != table[-1]) | (held[0] != held[0][-1]))
                    cut = int(other[-1]) + 1 if other.size else 0  # the last bucket may go on
            if cut:
                for x, y in _bucket_links(table[:cut], held[0][:cut], held[1][:cut].view(np.uint64), radius):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
                table, held = table[cut:], [x[cut:] for x in held]

    rows = keyed.select(F.xxhash64("v").alias("v"), "key", "fp")
    return rows.repartition("v", "key").sortWithinPartitions("v", "key").mapInArrow(tidy(run), "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def classes(docs: DataFrame, size: int = 3, radius: int = 3, split: int = SPLIT) -> DataFrame:
    """``(doc_id, text_hash, key, fp, root, component_id)`` per row; ``root`` is a fingerprint that names the component."""
    base = durable(fingerprints(docs, size))
    nodes = base.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius, split))
    placed = durable(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Cut, so that both sides of the join are plain and AQE can split a giant component's.
    least = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = placed.join(least, "root").select("fp", "root", "component_id")
    return base.join(named, "fp")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, split: int = SPLIT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    Null and empty texts, and texts of separators only, have fingerprint zero and link like any other.
    Rows that repeat a doc_id stay rows of their own; a null doc_id stays null and names a component only if the
    component has no other (its component_id is null then).  Other columns are ignored; an empty table gives no rows.
    """
    return classes(docs, size, radius, split).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stay when one document of each component does: the one with the
    smallest doc_id (nulls last), of rows that repeat it the one with the smallest text hash, and of rows that repeat both
    the one whose columns have the smallest hash."""
    return one_of_each(docs, durable(classes(docs, size, radius).select("doc_id", "text_hash", "key", "root")))


def one_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one of each root of ``placed(doc_id, text_hash, key, root)`` does.

    Only rows that may go are moved."""
    keep = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "key")).alias("k")).select("root", F.col("k.key").alias("kept"))
    keep = durable(keep)
    gone = durable(placed.join(keep, "root").where("key <> kept").select("key").distinct())
    some, rest = parted(docs, gone)
    name = _free("key", docs.columns)
    kept = rest.unionByName(some.withColumn(name, row_key(some)).join(gone.withColumnRenamed("key", name), name, "left_anti").drop(name))
    twice = durable(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").join(gone, "key", "left_anti"))
    if twice.isEmpty():
        return kept
    some, rest = parted(kept, twice)
    flagged = some.withColumn(name, row_key(some)).join(twice.select(F.col("key").alias(name), F.lit(True).alias(f"{name}_twice")), name, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = flagged.where(F.col(f"{name}_twice")).groupBy(name).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*")
    return rest.unionByName(flagged.where(F.col(f"{name}_twice").isNull()).select(*columns)).unionByName(one)


def _free(name: str, columns: list[str]) -> str:
    while name in columns or f"{name}_twice" in columns:
        name = f"_{name}"
    return name
