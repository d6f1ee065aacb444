"""Near copies by SimHash, held against the exact sets: texts whose sets of word shingles have a Jaccard similarity of at
least ``SIMILARITY``.

Texts with equal sets are one node from the start.  Each node has a SimHash fingerprint, the bit majorities over its set's
hashes; fingerprints that differ in at most ``RADIUS`` bits link, all of them by ``simhash.links``, and the nodes of a
component of fingerprints are a bucket.  Most pairs of similarity 0.8 differ in more bits (10 of 64 on average), so the nodes
of each band of a MinHash signature, ``BANDS`` bands of ``ROWS`` values, are buckets too: a pair of similarity 0.8 shares no band
with probability 0.00007, a more similar one with less.  In either kind the exact sets decide.  First every node is compared with its buckets' least node, on the exact sets; what these links
connect needs no further look.  Then, in buckets that still have several components, all nodes of different components
are compared exactly.  The nodes of the bucket's largest component are at home and need no comparison with each other: they and
the others are cut into blocks of about ``BLOCK`` nodes by hash, and each block of others is compared with each block, so one
unlike node among a million costs a million comparisons, not their square.  Each pair of blocks is one bounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import mix, pieces, utf8
from ._bloom import parted
from ._spark import durable, tidy, tune
from .components import components
from .simhash import keyed_texts, links, majority, one_of_each, shingle_hashes

#: Words of a shingle, least similarity, differing bits of linked fingerprints, bands and values of a band.
SIZE, SIMILARITY, RADIUS, BANDS, ROWS = 5, 0.8, 3, 24, 5
#: Nodes of a block of a bucket.
BLOCK = 256
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_XOR, _ODD = _SEEDS[::2], _SEEDS[1::2] | np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted; the second array says where each document begins."""
    h, first = shingle_hashes(buf, off, size)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(first)))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each set and its band keys [documents, BANDS]; sets without shingles are alike."""
    n = np.diff(first)
    node, keys = np.zeros(len(n), np.uint64), np.zeros((len(n), BANDS), np.uint64)
    full = np.flatnonzero(n)
    if full.size:
        at = first[:-1][full]
        node[full] = mix(np.add.reduceat(mix(h), at) + n[full].astype(np.uint64))
        for band in range(BANDS):
            key = np.full(full.size, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mix(key * np.uint64(3) ^ np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], at))
            keys[full, band] = key
    return node, keys


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def forest(sets: list[np.ndarray], roots: list[int], similarity: float = SIMILARITY):
    """(i, j) links that connect what all pairs of at least this Jaccard similarity connect, beyond what equal roots do.

    Every node is compared with all nodes that it is not yet connected to, over an index of their values."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    _, part = np.unique(np.array(roots), return_inverse=True)
    mark = np.zeros(len(values), bool)
    for x in range(n):
        other = np.flatnonzero((part != part[x]) & (np.arange(n) > x) & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-9))
        if not other.size:
            continue
        mark[ids[begins[x] : begins[x] + sizes[x]]] = True
        at = np.repeat(begins[other] - (np.cumsum(sizes[other]) - sizes[other]), sizes[other]) + np.arange(int(sizes[other].sum()))
        common = np.add.reduceat(mark[ids[at]], np.cumsum(sizes[other]) - sizes[other], dtype=np.int64)
        mark[ids[begins[x] : begins[x] + sizes[x]]] = False
        for y in other[common >= similarity * (sizes[x] + sizes[other] - common) - 1e-9].tolist():
            if part[y] != part[x]:
                yield x, y
                part[part == part[y]] = part[x]


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``docs(node, text)`` -> ``(node, shingles binary)``."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in pieces(off):
                h, first = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
                data = [h[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(data, pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(tidy(run), "node long, shingles binary")


def _checked(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b, x binary, y binary)`` whose sets are similar."""

    def run(batches):
        for b in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _links(blocks: DataFrame, similarity: float) -> DataFrame:
    """``blocks(key, i, j, node, root, shingles)`` -> exact links within each (key, i, j), which is bounded."""

    def run(batches):
        def compare(group):
            if len({r for r, _ in group.values()}) > 1:
                nodes = list(group)
                found = [(nodes[i], nodes[j]) for i, j in forest([np.frombuffer(group[x][1], np.uint64) for x in nodes], [group[x][0] for x in nodes], similarity)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        now, group = None, {}
        for b in batches:
            for key, i, j, node, root, data in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (key, i, j) != now:
                    yield from compare(group)
                    now, group = (key, i, j), {}
                group[node] = (root, data)
        yield from compare(group)

    by = ["key", "i", "j"]
    return blocks.select(*by, "node", "root", "shingles").repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), "a long, b long")


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes; one without edges is its own root."""
    return nodes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def node_links(keyed: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``keyed(node, key)`` and ``sets(node, shingles)`` -> ``(a, b)``: links whose components are those of all similar pairs
    that share a key."""
    stars = durable(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"))
    member = durable(keyed.join(stars, "key").select("key", "node", "least", "n"))
    # Cut, so that the join with the least nodes' sets, which a large bucket makes hot, has two plain sides.
    pairs = durable(member.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    near = durable(_checked(pairs.join(x, "a").join(y, "b"), similarity))
    roots = durable(_rooted(member.select("node").distinct(), near))
    # Buckets that hold several components: one row per block that a node is compared in.
    placed = durable(member.join(roots, "node").select("key", "node", "root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = durable(parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("home"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("home.root").alias("home"), F.col("home.n").alias("n_home"), (F.col("all") - F.col("home.n")).alias("n_away")))
    return near.unionByName(_links(durable(paired_blocks(placed, open_, block)).join(sets, "node"), similarity))


def paired_blocks(placed: DataFrame, open_: DataFrame, block: int = BLOCK) -> DataFrame:
    """``placed(key, node, root)`` and ``open_(key, home, n_home, n_away)`` -> ``(key, node, root, i, j)``: the pairs of blocks that
    nodes are compared in.  Blocks of others are numbered from 0, blocks at home from -1 down."""
    count = lambda c: F.ceil(F.col(c) / block).cast("int")
    j = placed.join(open_, "key").withColumn("away", F.col("root") != F.col("home"))
    j = j.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("away"), count("n_away")).otherwise(count("n_home"))).cast("int"))
    others = F.sequence(F.lit(0), count("n_away") - 1)
    rows = j.select("key", "node", "root", "own", "away", F.explode(F.when(F.col("away"), F.concat(others, F.sequence(F.lit(-1), -count("n_home")))).otherwise(others)).alias("k"))
    own = F.when(F.col("away"), F.col("own")).otherwise(-1 - F.col("own"))
    return rows.select("key", "node", "root", F.least(own, "k").alias("i"), F.greatest(own, "k").alias("j"))


def fingerprint_buckets(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``nodes(node, fp)`` -> ``(node, key)``: nodes share a key if their fingerprints link within ``radius`` bits, through others
    too."""
    prints = durable(nodes.select("fp").distinct())
    roots = components(links(prints, radius)).select(F.col("node").alias("fp"), "root")
    return nodes.select("node", "fp").join(roots, "fp", "left").select("node", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("key"))


def classes(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text_hash, key, root)`` per row; equal roots are near copies or linked by some.
    With 0 ``bands``, fingerprints alone propose.

    Texts without words, null and empty ones too, share one root; repeated rows get a row and a root each; an empty table gives no
    rows, and other columns are ignored."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(3))
            for i, j in pieces(off):
                h, first = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
                node, keys = signatures(h, first)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(3)), pa.array(node.view(np.int64)), pa.array(majority(h, first).view(np.int64)), held], ["doc_id", "text_hash", "key", "node", "fp", "keys"])

    named = keyed_texts(docs)
    base = durable(named.mapInArrow(tidy(run), "doc_id long, text_hash long, key long, node long, fp long, keys array<long>"))
    # One row of each node stands for it.
    nodes = durable(base.groupBy("node").agg(F.min("key").alias("of"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    full = nodes.where("node <> 0")
    every = durable(fingerprint_buckets(full, radius)).unionByName(full.select("node", F.explode(F.slice("keys", 1, bands)).alias("key")))
    shared = durable(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keyed = durable(every.join(shared, "key"))
    wanted = durable(nodes.join(keyed.select("node").distinct(), "node").select("node", "of"))
    some, _ = parted(named, wanted.select("of"))  # only their texts are moved
    sets = durable(_sets_of(some.join(wanted, F.col("key") == F.col("of")).dropDuplicates(["node"]), size))
    roots = components(node_links(keyed, sets, similarity))
    placed = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return base.select("doc_id", "text_hash", "key", "node").join(durable(placed), "node").select("doc_id", "text_hash", "key", "root")


def representatives(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stay when one document of each component does, chosen as by
    ``simhash.representatives``.  A text of fewer words than a shingle is one shingle; texts without words are copies."""
    return one_of_each(docs, durable(classes(docs, size, similarity, radius)))
