"""Line deduplication by winnowing over line hashes.

A text's lines are its parts between line ends, cut again behind sentence ends, and parts of more than ``LONG`` words
once more at words that a hash of their neighbourhood picks, so that a passage is found wherever it begins or ends
inside a line; parts without words do not count.  Lines are equal if their words are.  Windows are content-defined: from
each line the shortest run of lines with ``min_words`` words, forwards and backwards.  Every run of that many words that
occurs twice is exactly covered by windows that occur twice: a match is extended both ways by the windows that overlap it,
up to its last line, and deleting every later window deletes every later run.

Winnowing keeps this cheap: each window selects the smallest line hash in it as its fingerprint.  Equal windows select
equal fingerprints, so only windows whose fingerprint was selected more than once anywhere are compared.  A Bloom filter
tells them where the repeated fingerprints are few enough for one of 8 MB; beyond that an exact join does.  Their hashes
are counted first, so that only windows that occur twice are moved with their places.  Of equal windows the first by (doc_id, position) stays; its later occurrences are found by an aggregate and an equi-join, never
in pairs.  Texts are moved only for documents that lose something.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bloom
from ._arrow import hash_spans, mix, padded, pieces, runs, spread, utf8
from ._spark import durable, release, tidy, tune

#: Words of the shortest run that is deleted when it repeats.
MIN_WORDS = 25
#: Parts of more words than LONG are cut again, in front of one word in CUT (a power of two).
LONG, CUT = 16, 8
#: Most repeated fingerprints that a filter holds; beyond, they are joined.
FILTERED = 1 << 23
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_WORD = np.ones(256, np.uint8)
_WORD[[*range(0x09, 0x0E), 0x20]] = 0
_END = np.zeros(256, bool)
_END[[0x21, 0x2E, 0x3F]] = True


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006 (kept per process)
    """Powers of a base, 0 to n, modulo 2^64."""
    if len(kept.get(base, ())) <= n:
        p = np.full(max(n + 1, 1 << 18), base, np.uint64)
        p[0] = 1
        kept[base] = np.cumprod(p, dtype=np.uint64)
    return kept[base][: n + 1]


def _run_hashes(h: np.ndarray, s: np.ndarray, e: np.ndarray, base: int) -> np.ndarray:
    """Hash of each run h[s:e]: a polynomial of its values, whatever stands before it."""
    n = len(h)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, n)[:-1], dtype=np.uint64)])
    return mix((prefix[e] - prefix[s]) * _powers(pow(base, -1, 1 << 64), n)[s] + (e - s).astype(np.uint64))


def split_lines(buf: np.ndarray, off: np.ndarray):
    """(starts, ends, words, first, hashes) of the lines; ``first`` says at which line each document begins."""
    w_starts, w_ends, _, w_first = runs(_WORD[buf], off)
    n = len(w_starts)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(len(off), np.int64), np.zeros(0, np.uint64)
    h = hash_spans(padded(buf), w_starts, w_ends)
    cut = np.zeros(n, bool)
    cut[w_first[w_first < n]] = True
    ends_at = np.flatnonzero((buf == 0x0A) | (buf == 0x0D))
    behind = np.searchsorted(w_starts, ends_at)
    cut[behind[behind < n]] = True
    cut[1:] |= _END[buf[w_ends[:-1] - 1]] & (buf[np.minimum(w_ends[:-1], len(buf) - 1)] == 0x20)
    at = np.flatnonzero(cut)
    words = np.diff(np.append(at, n))
    # Cut long parts in front of the words that the hash of two neighbours picks.
    long = words > LONG
    inner = spread(at[long] + 1, words[long] - 1)
    inner = inner[(mix(h[inner - 1] * np.uint64(3) ^ h[inner]) & np.uint64(CUT - 1)) == 0]
    if inner.size:
        cut[inner] = True
        at = np.flatnonzero(cut)
        words = np.diff(np.append(at, n))
    last = at + words
    return w_starts[at], w_ends[last - 1], words, np.searchsorted(at, w_first), _run_hashes(h, at, last, _BASES[2])


def windows(h: np.ndarray, words: np.ndarray, first: np.ndarray, least: int):
    """(document, start, end, fingerprint, two hashes) of the distinct content-defined windows."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)  # behind the last line
    ok = end <= first[1:][doc]
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    ok2 = begin >= first[:-1][doc]
    back, behind = begin[ok2], line[ok2] + 1
    new = ~ok[back] | (end[back] != behind)  # not a forward window already
    s, e = np.concatenate([line[ok], back[new]]), np.concatenate([end[ok], behind[new]])
    size = e - s
    fp = np.zeros(len(s), np.uint64)
    level, k = h, 0
    depth = np.zeros(len(s), np.int64)
    depth[size > 0] = np.floor(np.log2(size[size > 0])).astype(np.int64)
    while len(s) and k <= depth.max():
        at = np.flatnonzero(depth == k)
        fp[at] = np.minimum(level[s[at]], level[e[at] - (1 << k)])
        if len(level) <= 1 << k:
            break
        level = np.minimum(level[: len(level) - (1 << k)], level[1 << k :])
        k += 1
    return doc[s] if len(s) else s, s, e, fp, _run_hashes(h, s, e, _BASES[0]), _run_hashes(h, s, e, _BASES[1])


def _pair(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(x ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def line_hashes(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``(doc_id, key, sha, h array<long>, words array<int>)``: hash and words of each document's lines, and the SHA-256 of its
    text if asked for; ``key`` tells documents apart that repeat a doc_id."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(2))
            for i, j in pieces(off):
                own = buf[off[i] : off[j]]
                _, _, words, first, h = split_lines(own, off[i : j + 1] - off[i])
                text = memoryview(own)
                sha = [hashlib.sha256(text[x:y]).hexdigest() for x, y in zip((off[i:j] - off[i]).tolist(), (off[i + 1 : j + 1] - off[i]).tolist())] if digest else [None] * (j - i)
                cols = [b.column(0)[i:j], b.column(1)[i:j], pa.array(sha, pa.string()), _lists(h.view(np.int64), first), _lists(words.astype(np.int32), first)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "sha", "h", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bloom.row_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, key long, sha string, h array<long>, words array<int>")


def _read_lines(b: pa.RecordBatch, h: int, words: int):
    first = np.asarray(b.column(h).offsets).astype(np.int64)
    values = np.asarray(b.column(h).values).astype(np.int64).view(np.uint64)[first[0] : first[-1]]
    count = np.asarray(b.column(words).values).astype(np.int64)[first[0] : first[-1]]
    return values, count, first - first[0]


def _selected(h, words, first, min_words):
    """(document, fingerprint, times) of the fingerprints that each document selects; 2 where it has the line itself twice."""
    doc, _, _, fp, _, _ = windows(h, words, first, min_words)
    chosen, new = np.unique(_pair(doc, fp), return_index=True)
    held, times = np.unique(_pair(np.repeat(np.arange(len(first) - 1), np.diff(first)), h), return_counts=True)
    again = times[np.searchsorted(held, chosen)] > 1 if len(doc) else np.zeros(0, bool)
    return doc[new], fp[new], again.astype(np.int64) + 1


def _candidates(rows: np.ndarray, ids: pa.Array, h, words, first, min_words, wanted) -> pa.RecordBatch:
    """The windows whose fingerprint is wanted; ``at`` is a window's first line, times 2^32, and its number of lines."""
    doc, s, e, fp, ha, hb = windows(h, words, first, min_words)
    keep = np.flatnonzero(wanted(doc, fp, ha))
    doc, s, e = doc[keep], s[keep], e[keep]
    cols = [pa.array(rows[doc]), ids.take(pa.array(doc)), pa.array((s - first[doc] << 32) | (e - s)), pa.array(ha[keep].view(np.int64)), pa.array(hb[keep].view(np.int64))]
    return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "at", "ha", "hb"])


_CANDIDATE = "row long, doc_id long, at long, ha long, hb long"


def repeated_lines(named: DataFrame, min_words: int = MIN_WORDS, filtered: int = FILTERED) -> DataFrame:
    """``named(row, doc_id, key, h, words)`` -> ``(key, spans array<long>)``: the windows of later repeated runs, for the
    documents that have any."""
    spark = named.sparkSession

    def count(batches):
        for b in batches:
            h, words, first = _read_lines(b, 0, 1)
            _, fp, n = _selected(h, words, first, min_words)
            own, back = np.unique(fp, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(back, weights=n, minlength=len(own)).astype(np.int64))], ["fp", "n"])

    # A fingerprint that one document alone selects matters only if that document repeats it itself.
    counted = named.select("h", "words").mapInArrow(tidy(count), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    often = durable(counted.where("n > 1").select("fp"))  # cut, so that AQE can split a join with it
    n_often = often.count()
    if n_often <= filtered:
        held = spark.sparkContext.broadcast(_bloom.build(often, _bloom.bits_for(n_often)))

        def tally(batches):
            for b in batches:
                h, words, first = _read_lines(b, 0, 1)
                _, _, _, fp, ha, _ = windows(h, words, first, min_words)
                own, n = np.unique(ha[_bloom.passes(held.value, fp)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["ha", "n"])

        # Only windows whose hash occurs twice are worth their places.
        twice = durable(named.select("h", "words").mapInArrow(tidy(tally), "ha long, n long").groupBy("ha").agg(F.sum("n").alias("n")).where("n > 1").select("ha"))
        n_twice = twice.count()
        again = spark.sparkContext.broadcast(_bloom.build(twice, _bloom.bits_for(n_twice)) if n_twice <= filtered else None)

        def compare(batches):
            def wanted(_, fp, ha):
                ok = _bloom.passes(held.value, fp)
                return ok if again.value is None else ok & _bloom.passes(again.value, ha)

            for b in batches:
                h, words, first = _read_lines(b, 2, 3)
                yield _candidates(np.asarray(b.column(0)), b.column(1), h, words, first, min_words, wanted)

        found = named.select("row", "doc_id", "h", "words").mapInArrow(tidy(compare), _CANDIDATE)
    else:

        def select(batches):
            for b in batches:
                doc, fp, _ = _selected(*_read_lines(b, 1, 2), min_words)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0))[doc]), pa.array(fp.view(np.int64))], ["row", "fp"])

        def compare_listed(batches):
            for b in batches:
                h, words, first = _read_lines(b, 2, 3)
                allow, _, allow_first = _read_lines(b, 4, 4)
                allowed = _pair(np.repeat(np.arange(b.num_rows), np.diff(allow_first)), allow)
                yield _candidates(np.asarray(b.column(0)), b.column(1), h, words, first, min_words, lambda doc, fp, _: np.isin(_pair(doc, fp), allowed))

        chosen = named.select("row", "h", "words").mapInArrow(tidy(select), "row long, fp long")
        wanted = chosen.join(often, "fp").groupBy("row").agg(F.collect_set("fp").alias("fps"))
        found = named.join(wanted, "row").select("row", "doc_id", "h", "words", "fps").mapInArrow(tidy(compare_listed), _CANDIDATE)
    candidates = durable(found)
    del often
    release(spark)
    place = F.struct(F.col("doc_id"), F.col("row"), F.col("at"))
    first = durable(candidates.groupBy("ha", "hb").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("ha", "hb", "first"))
    later = candidates.join(first, ["ha", "hb"]).where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    spans = later.groupBy("row").agg(F.collect_list("at").alias("spans"))  # a document's own windows
    # Rows that repeat doc_id and text are one document: its first row's lines hold.
    own_row = named.groupBy("doc_id", "key").agg(F.min("row").alias("row")).select("row", "key")
    out = durable(own_row.join(spans, "row").select("key", "spans"))
    del candidates, first, later, spans, own_row
    release(spark)
    return out


def _break(gap: bytes, last: bool = False) -> int:
    """Offset of the first (the last) line end in a gap between words, or -1."""
    a, b = (gap.rfind(b"\n"), gap.rfind(b"\r")) if last else (gap.find(b"\n"), gap.find(b"\r"))
    return max(a, b) if last or min(a, b) < 0 else min(a, b)


def _without(text: bytes, starts: list[int], ends: list[int], drop: list[int]) -> bytes:
    """The text without some of its lines, each with the spaces around it inside its line.

    A line end stays where something of its line does.
    """
    out, at, gone, n = [], 0, set(drop), len(starts)
    for k in drop:
        before = ends[k - 1] if k else 0
        head = _break(text[before : starts[k]], last=True)
        begin = before + head + 1 if head >= 0 else (0 if not k else starts[k])
        out.append(text[at : max(at, begin)])
        behind = starts[k + 1] if k + 1 < n else len(text)
        stop = _break(text[ends[k] : behind])
        at = behind
        if stop >= 0:
            at = ends[k] + stop
            i = k
            while i and _break(text[ends[i - 1] : starts[i]]) < 0:
                i -= 1
            if all(x in gone for x in range(i, k)):
                at += 2 if text[at : at + 2] == b"\r\n" else 1
    out.append(text[at:])
    return b"".join(out)


def _dropped(spans: list[int]) -> list[int]:
    return sorted({k for x in spans for k in range(x >> 32, (x >> 32) + (x & 0xFFFFFFFF))})


#: Figures that are added, in this order; incoming columns of these names are replaced.
FIGURES = ("n_lines", "n_deleted", "words_deleted")


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def _shortened(docs: DataFrame, found: DataFrame, figures: bool) -> DataFrame:
    """The rows of ``docs`` that lose lines, without them, and with the three figures if asked for."""
    added = FIGURES if figures else ()
    columns = [c for c in docs.columns if c not in added]
    spans, key = _free("spans", docs.columns), _free("key", docs.columns)
    joined = docs.withColumn(key, _bloom.row_key(docs)).join(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), key).select(*columns, spans).withColumn("text", F.col("text").cast("string"))
    at = columns.index("text")

    def run(batches):
        for b in batches:
            texts, counts = [], []
            for text, own in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist()):
                raw = (text or "").encode()
                starts, ends, words, _, _ = split_lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                drop = _dropped(own)
                texts.append(_without(raw, starts.tolist(), ends.tolist(), drop).decode())
                counts.append((len(starts), len(drop), int(words[drop].sum())))
            cols = [pa.array(texts, pa.string()) if c == at else b.column(c) for c in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(added)))], [*columns, *added])

    return joined.mapInArrow(tidy(run), joined.drop(spans).withColumns({c: F.lit(0).cast("long") for c in added}).schema)


def _hashed(docs: DataFrame, digest: bool = False) -> DataFrame:
    return durable(line_hashes(docs, digest).withColumn("row", F.monotonically_increasing_id()))


def changes(docs: DataFrame, min_words: int = MIN_WORDS, figures: bool = True) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: the rows that lose lines, with their texts shortened and ``n_lines``, ``n_deleted`` and
    ``words_deleted`` added if asked for, and the rows that stay as they are, without figures."""
    tune(docs.sparkSession)
    found = repeated_lines(_hashed(docs), min_words)
    some, rest = _bloom.parted(docs, found.select("key"))
    key = _free("key", docs.columns)
    left = some.withColumn(key, _bloom.row_key(some)).join(found.select(F.col("key").alias(key)), key, "left_anti").drop(key)
    return _shortened(some, found, figures), rest.unionByName(left)


def clean(docs: DataFrame, min_words: int = MIN_WORDS, length: str | None = None) -> DataFrame:
    """All rows of ``docs``, all columns kept, with later repeated runs deleted from ``text``; the column named by ``length``
    gets the new length of texts that change."""
    changed, same = changes(docs, min_words, figures=False)
    if length and length in docs.columns:
        changed = changed.withColumn(length, F.length("text").cast(docs.schema[length].dataType))
    return same.withColumn("text", F.col("text").cast("string")).unionByName(changed)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` with later repeated runs deleted from ``text``, and ``n_lines``, ``n_deleted`` and
    ``words_deleted`` added (incoming columns of these names are replaced); other columns are kept.

    Runs of fewer than ``min_words`` words stay, and so do texts without a repeated run, byte for byte.  Null and
    empty texts stay as they are, with no lines.  Rows that repeat doc_id and text are one document and get one
    result; of other equal texts the one with the smallest doc_id (null first) stays.  A text can become empty.
    """
    changed, same = changes(docs, min_words)
    same = same.drop(*[c for c in FIGURES if c in same.columns]).withColumn("text", F.col("text").cast("string"))
    at = same.columns.index("text")

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(at))
            n = [np.diff(split_lines(buf[off[i] : off[j]], off[i : j + 1] - off[i])[3]) for i, j in pieces(off)]
            none = pa.array(np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)), none, none], [*b.schema.names, *FIGURES])

    schema = same.withColumns({c: F.lit(0).cast("long") for c in FIGURES}).schema
    return same.mapInArrow(tidy(run), schema).unionByName(changed)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, n_lines, n_deleted, words_deleted, text_sha256`` of what stays.

    The texts are read once, for their lines and digests, and again only where they change."""
    tune(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    named = _hashed(rows, digest=True)
    found = repeated_lines(named, min_words)
    some, _ = _bloom.parted(rows, found.select("key"))
    digest: Column = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    changed = _shortened(some, found, True).select(F.col("doc_id").cast("long").alias("doc_id"), *FIGURES, digest)
    zero = F.lit(0).cast("long")
    same = named.select("doc_id", "key", F.size("h").cast("long").alias("n_lines"), zero.alias("n_deleted"), zero.alias("words_deleted"), F.col("sha").alias("text_sha256")).join(found.select("key"), "key", "left_anti").drop("key")
    return same.unionByName(changed)
