"""Substring dedup by level-wise doubling.

A window of ``window`` words repeats only if each shorter window inside it does.  So short windows are counted first, about
``SHORTEST`` words long; those that two documents have are alone extended to twice the length (a word less where the wanted
length is odd), counted again, and so on, until none survives or the wanted length is reached.  Each level counts only what the
one before left over, and only the windows that survive the last one are moved with their places.

At the first level only the short window of smallest hash inside each longer one is counted: equal windows choose the same one,
so none is missed, and about a quarter of the positions are counted.  A Bloom filter tells the next level which windows survived;
where the first level's survivors are too many for one of 8 MB, an exact join does, and beyond that size the filters of later
levels let more pass, which the last level sorts out.  Windows are compared by 96-bit hashes of their words.

Copies of a whole text are settled before: all but those of smallest doc_id lose all words, and only one row of each text
takes part in the levels, however many copies it has.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom, _copies
from ._arrow import hash_spans, mix, padded, pieces, runs, spread, utf8
from ._spark import release, tune, written

#: Most surviving windows of the first level that a filter holds; beyond, they are joined.
FILTERED = 1 << 23
#: Shortest length, in words, of the first level.
SHORTEST = 5
_SPACES = np.ones(256, np.uint8)
_SPACES[[*range(0x09, 0x0E), 0x20]] = 0
#: Odd multipliers of the polynomial hashes, fixed values.
_A, _B, _PART = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F


def _hashes(h: np.ndarray, at: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of the ``size`` words from each of the words ``at``."""
    out, b = np.zeros(len(at), np.uint64), np.uint64(base)
    for k in range(size):
        out *= b
        out += h[at + k]
    return mix(out)


def _once(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One value for each pair of document and hash."""
    return mix(x ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


class _Text:
    """Words of some documents of an Arrow batch, hashed, and the windows that lie in one document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.starts, self.ends, _, self.first = runs(_SPACES[buf], off)
        self.h = hash_spans(padded(buf), self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def inside(self, size: int) -> np.ndarray:
        """Words at which a window of ``size`` words begins that ends in the same document."""
        n = max(0, len(self.h) - size + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 : size - 1 + n])

    def chosen(self, size: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, smallest hash of the windows of ``part`` words inside) of every window of ``size`` words."""
        at = self.inside(size)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        each = _hashes(self.h, np.arange(len(self.h) - part + 1), part, _PART)
        return at, _smallest(each, size - part + 1)[at]

    def extended(self, sizes: list[int], blooms: list[np.ndarray], wanted) -> np.ndarray:
        """Begins of the windows of the last of ``sizes`` whose parts survived all levels before; ``wanted(doc, hash)`` says it of
        the first level, ``blooms`` of the later ones."""
        if len(sizes) == 1:
            return self.inside(sizes[0])
        at, part = self.chosen(sizes[1], sizes[0])
        at = at[wanted(self.doc[at], part)]
        for size, double, bloom in zip(sizes[1:], sizes[2:], blooms):
            ok = np.zeros(len(self.h) + 1, bool)
            ok[at[_bloom.passes(bloom, _hashes(self.h, at, size, _A))]] = True
            inside = self.inside(double)
            at = inside[ok[inside] & ok[inside + double - size]]
        return at


def _joined(buf: np.ndarray, t: _Text, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of the documents joined by one space each, and where each document begins therein."""
    kept = np.flatnonzero(keep)
    docs = t.doc[kept]
    glue = np.zeros(len(kept), np.int64)
    if len(kept):
        glue[:-1] = docs[1:] == docs[:-1]
    size = t.ends[kept] - t.starts[kept]
    begins = np.cumsum(size + glue) - (size + glue)
    out = np.full(int((size + glue).sum()), 0x20, np.uint8)
    out[spread(begins, size)] = buf[spread(t.starts[kept], size)]
    total = np.zeros(len(t.first), np.int64)
    np.add.at(total, docs + 1, size + glue)
    return out.tobytes(), np.cumsum(total)


def _digests(buf: np.ndarray, t: _Text, keep: np.ndarray) -> list[str]:
    joined, at = _joined(buf, t, keep)
    view = memoryview(joined)
    return [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2, key, text)``; doc_id and the text's hash h1 name a row but for its repetitions."""
    h1, h2 = _copies.text_hashes(docs["text"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), docs["text"].cast("string").alias("text"))
    return rows.select("doc_id", "h1", "h2", F.xxhash64("doc_id", "h1").alias("key"), "text")


def _measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2, key, n_words, sha, later)`` per row: words and digest of the whole text."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(4))
            for i, j in pieces(off):
                own = buf[off[i] : off[j]]
                t = _Text(own, off[i : j + 1] - off[i])
                sha = _digests(own, t, np.ones(len(t.h), bool))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(4)), pa.array(np.diff(t.first)), pa.array(sha, pa.string())], ["doc_id", "h1", "h2", "key", "n_words", "sha"])

    light, _ = written(_rows(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, key long, n_words long, sha string"), "words")
    return written(_copies.with_later(light), "marked")[0]


def _chosen(b: pa.RecordBatch, held, text: int):
    """(columns, text buffer, offsets) of the batch's rows that may be first rows of their text."""
    some = b.filter(pa.array(_copies.maybe_first(held, b.column(3).to_numpy(zero_copy_only=False)) & b.column(0).is_valid().to_numpy(zero_copy_only=False)))
    return some, *utf8(some.column(text))


def sizes_of(window: int) -> list[int]:
    """Lengths of the levels, up to ``window``: each is half of the next, rounded up, and the first has ``SHORTEST`` words at least."""
    out = [window]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _texts(b: pa.RecordBatch, held, text: int):
    """(rows of the batch that may be first rows of their text, number of the first row, documents) a piece at a time."""
    some = b.filter(pa.array(_copies.maybe_first(held, b.column(3).to_numpy(zero_copy_only=False)) & b.column(0).is_valid().to_numpy(zero_copy_only=False)))
    buf, off = utf8(some.column(text))
    for i, j in pieces(off):
        yield some, i, _Text(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _short_repeats(rows: DataFrame, held, size: int, part: int) -> DataFrame:
    """``(part)``: the chosen short windows that two documents have, counted once a document."""

    def run(batches):
        for b in batches:
            for _, _, t in _texts(b, held, 4):
                at, part_ = t.chosen(size, part)
                _, once = np.unique(_once(t.doc[at], part_), return_index=True)
                own, n = np.unique(part_[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int32))], ["part", "n"])

    counted = rows.mapInArrow(run, "part long, n int").groupBy("part").agg(F.sum("n").alias("n"))
    return written(counted.where("n > 1").select("part"), "parts")[0]


def _emit(some: pa.RecordBatch, i: int, t: _Text, at: np.ndarray, size: int, places: bool) -> pa.RecordBatch:
    """Windows as ``(a, b, doc_id)``, once for each piece, or with places as ``(doc_id, h1, at, a, b)``."""
    a, b = _hashes(t.h, at, size, _A).view(np.int64), (_hashes(t.h, at, size, _B) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    if places:
        doc = pa.array(t.doc[at] + i)
        return pa.RecordBatch.from_arrays([some.column(0).take(doc), some.column(1).take(doc), pa.array((at - t.first[t.doc[at]]).astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "h1", "at", "a", "b"])
    own = some.column(0).to_numpy(zero_copy_only=False)[t.doc[at] + i]
    order = np.lexsort((own, b, a))
    a, b, own = a[order], b[order], own[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    last = np.append(first[1:], True) if len(a) else first
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(own[first]), pa.array(own[last])], ["a", "b", "least", "most"])


_COUNTED, _PLACED = "a long, b int, least long, most long", "doc_id long, h1 long, at int, a long, b int"


class _Levels:
    """The levels over the rows of one table: which windows survived so far."""

    def __init__(self, rows: DataFrame, held, sizes: list[int], filtered: int):
        self.rows, self.held, self.sizes, self.blooms, self.short = rows, held, sizes, [], None
        if len(sizes) > 1:
            parts = _short_repeats(rows, held, sizes[1], sizes[0])
            self.n = parts.count()
            spark = rows.sparkSession
            if self.n <= filtered:
                self.short = spark.sparkContext.broadcast(_bloom.build(parts, _bloom.bits_for(self.n)))
            else:
                self.listed = self._listed(parts)
            release(spark)

    def _listed(self, parts: DataFrame) -> DataFrame:
        """The rows with the chosen short windows of theirs that survived, by an exact join."""
        held, (part, size) = self.held, self.sizes[:2]

        def select(batches):
            for b in batches:
                for some, i, t in _texts(b, held, 4):
                    at, own = t.chosen(size, part)
                    _, once = np.unique(_once(t.doc[at], own), return_index=True)
                    doc = pa.array(t.doc[at[once]] + i)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(doc), some.column(1).take(doc), pa.array(own[once].view(np.int64))], ["doc_id", "h1", "part"])

        chosen = self.rows.mapInArrow(select, "doc_id long, h1 long, part long").join(parts, "part")
        lists = chosen.groupBy("doc_id", "h1").agg(F.collect_set("part").alias("parts"))
        return written(self.rows.join(lists, ["doc_id", "h1"]).select("doc_id", "h1", "h2", "key", "text", "parts"), "listed")[0]

    def windows(self, level: int, places: bool, kept: np.ndarray | None = None) -> DataFrame:
        """The windows of a level whose parts survived; with ``kept``, a filter, only those it may hold."""
        held, short, sizes, blooms = self.held, self.short, self.sizes[: level + 1], self.rows.sparkSession.sparkContext.broadcast((list(self.blooms), kept))

        def run(batches):
            earlier, last = blooms.value
            for b in batches:
                for some, i, t in _texts(b, held, 4):
                    if short is not None or len(sizes) == 1:
                        wanted = lambda doc, own: _bloom.passes(short.value, own)
                    else:
                        lists = some.column(5).slice(i, int(t.doc[-1]) + 1 if len(t.doc) else 0)
                        row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                        allowed = _once(row, np.asarray(lists.flatten()).astype(np.int64).view(np.uint64))
                        wanted = lambda doc, own, allowed=allowed: np.isin(_once(doc, own), allowed)
                    at = t.extended(sizes, earlier, wanted)
                    if last is not None:
                        at = at[_bloom.passes(last, _hashes(t.h, at, sizes[-1], _A))]
                    yield _emit(some, i, t, at, sizes[-1], places)

        source = self.rows if short is not None or len(sizes) == 1 else self.listed
        return source.mapInArrow(run, _PLACED if places else _COUNTED)

    def survivors(self, level: int) -> DataFrame:
        """``(a, b, least)``: the windows of a level that two documents have, with the smallest doc_id."""
        counted = self.windows(level, False).groupBy("a", "b").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        return written(counted.where("least < most").select("a", "b", "least"), f"level-{self.sizes[level]}")[0]



def repeats(docs: DataFrame, marked: DataFrame, window: int, filtered: int = FILTERED) -> DataFrame:
    """``(doc_id, h1, starts array<int>)`` of first rows of a text: where their windows begin that an earlier document has too."""
    spark, rows, sizes = docs.sparkSession, _rows(docs), sizes_of(window)
    levels = _Levels(rows, _copies.first_filter(marked), sizes, filtered)
    level = min(1, len(sizes) - 1)
    found = levels.survivors(level)
    while level < len(sizes) - 1 and not found.isEmpty():
        levels.blooms.append(_bloom.build(found.select("a"), _bloom.bits_for(found.count())))
        level += 1
        found = levels.survivors(level)
        release(spark)
    kept = _bloom.build(found.select("a"), _bloom.bits_for(found.count()))
    # A window that very many documents share is one row of ``found``; AQE splits the join.
    later = levels.windows(level, True, kept).join(found, ["a", "b"]).where("doc_id > least")
    return written(later.groupBy("doc_id", "h1").agg(F.collect_list("at").alias("starts")), "starts")[0]


def _covered(t: _Text, row: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in one of the windows that begin at the given words of the given documents."""
    edge = np.zeros(len(t.h) + 1, np.int64)
    at = t.first[row] + starts
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _shortened(docs: DataFrame, removed: DataFrame, window: int) -> DataFrame:
    """``(doc_id, h1, n_removed, kept, text)`` of the documents that ``removed`` names: digest of what is left, and the
    words that are left joined by one space.  Only texts that may be among them move."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(2))
            first, values = np.asarray(b.column(3).offsets).astype(np.int64), np.asarray(b.column(3).values).astype(np.int64)
            for i, j in pieces(off):
                own = buf[off[i] : off[j]]
                t = _Text(own, off[i : j + 1] - off[i])
                gone = _covered(t, np.repeat(np.arange(j - i), np.diff(first[i : j + 1])), values[first[i] : first[j]], window)
                joined, at = _joined(own, t, ~gone)
                left = [joined[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                n = np.add.reduceat(np.append(gone, False), np.minimum(t.first[:-1], len(gone)), dtype=np.int64) if j > i else np.zeros(0, np.int64)
                n[np.diff(t.first) == 0] = 0
                sha = [hashlib.sha256(x).hexdigest() for x in left]
                cols = [b.column(0)[i:j], b.column(1)[i:j], pa.array(n), pa.array(sha, pa.string()), pa.array([x.decode() for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h1", "n_removed", "kept", "text"])

    name = ["doc_id", "h1"]
    rows, key = _rows(docs), F.xxhash64("doc_id", "h1").alias("key")
    keys = removed.select(key)
    held = docs.sparkSession.sparkContext.broadcast(_bloom.build(keys, _bloom.bits_for(keys.count())))
    some = rows.where(_bloom.likely(held)(F.col("key"))).join(removed, name).select(*name, "text", "starts")
    return some.mapInArrow(run, "doc_id long, h1 long, n_removed long, kept string, text string").dropDuplicates(name)


def report(docs: DataFrame, window: int = 13, filtered: int = FILTERED) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if it lies in a window of ``window`` words that starts in a document of smaller doc_id too; ``kept_sha256`` is
    the digest of the words that stay, joined by one space.  Null and empty texts have no words.  Equal doc_ids are not earlier
    than each other, and rows that repeat doc_id and text get one result each; a null doc_id is neither earlier nor later than
    another, so such rows keep their words.  Texts of fewer words than a window stay, copies too.  Columns other than the two
    are ignored; an empty table gives no rows.
    """
    marked, changed = _decided(docs, window, filtered)
    own = marked.join(changed.drop("text"), ["doc_id", "h1"], "left")
    whole = F.col("later") & (F.col("n_words") >= window)
    return own.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def _decided(docs: DataFrame, window: int, filtered: int) -> tuple[DataFrame, DataFrame]:
    """The measured rows, and of the documents that lose some words what is left."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marked = _measured(docs)
    removed = repeats(docs, marked.select("key", "later"), window, filtered)
    return marked, _shortened(docs, removed, window)


def clean(docs: DataFrame, window: int = 13, filtered: int = FILTERED) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)``; texts that lose words become the words that stay, joined by one
    space, empty if none does, and the others stay byte for byte.  See ``report`` for what goes and for the edges."""
    marked, changed = _decided(docs, window, filtered)
    gone = marked.where("later").where(F.col("n_words") >= window).select("doc_id", "h1", F.lit("").alias("left_"))
    left = changed.select("doc_id", "h1", F.col("text").alias("left_")).unionByName(gone.distinct())
    h1, _ = _copies.text_hashes(docs["text"])
    names = {c: f"__{c}" for c in ("doc_id", "h1", "left_")}
    while set(names.values()) & set(docs.columns):
        names = {c: f"_{n}" for c, n in names.items()}
    keyed = docs.withColumns({names["doc_id"]: docs["doc_id"].cast("long"), names["h1"]: h1})
    out = keyed.join(left.select(*[F.col(c).alias(n) for c, n in names.items()]), [names["doc_id"], names["h1"]], "left")
    return out.withColumn("text", F.coalesce(names["left_"], F.col("text").cast("string"))).select(*docs.columns)
