"""Lexical retrieval packing: windows filled with the BM25 neighbours of a seed document.

Documents lie in shards of bounded size, one after the other within each input partition.  Corpus statistics
(number of documents, mean length, document frequency of every term) are counted over all documents first; terms are
64-bit hashes of pre-tokens.  Terms that one document alone has find no neighbour and need no entry; the frequencies of the
others are broadcast where they are at most ``MOST_TERMS``, 12 bytes a term.  Where there are more, every shard is one group: the
terms that it has in two documents or more, which are all that its scores depend on, are joined with their frequencies, and
the shard's documents and its frequencies meet there.  Both ways give the same pieces.  Each shard then builds an inverted
index with BM25 impacts.  All terms of a seed document are the query; its unused neighbours fill the seed's window greedily by
score, and the best one that is too long is cut to fill the rest.  What is left when a shard has no unused document becomes
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import pieces, spread, utf8
from ._bpe import load
from ._spark import durable, row_base, tidy, tune

#: Ids and documents of one shard, BM25's two constants, most terms whose frequencies are broadcast.
SHARD_IDS, SHARD_DOCS, K1, B, MOST_TERMS = 3_000_000, 8192, 1.2, 0.75, 1 << 23
#: Terms in more than one in so many documents of a shard are a row of impacts each, instead of a posting list.
DENSE = 12


def _doc_terms(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency), sorted, of the pre-tokens' numbers (below 2^32)."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    key = np.sort(doc << 32 | at)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new] >> 32, key[new] & 0xFFFFFFFF, np.diff(np.append(new, len(key)))


def corpus_statistics(docs: DataFrame, path: str) -> tuple[int, float, DataFrame]:
    """Documents, their mean number of pre-tokens, and ``(term, n)``: the terms that several documents have, with their number."""

    def run(batches):
        bpe, state = load(path), {}
        n_docs = n_words = 0

        def flush():
            seen, own = state.pop("seen"), state.pop("names")
            at = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(own[at].view(np.int64)), pa.array(seen[at])], ["kind", "term", "n"])

        for b in batches:
            buf, off = utf8(b.column(0))
            for i, j in pieces(off):
                p = bpe.split(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                held = bpe.generation
                if state and bpe.table.n > bpe.CACHE:
                    yield flush()
                at = bpe.index(p)
                if state and bpe.generation != held:
                    raise RuntimeError("the cache began anew under its counts")
                n = np.bincount(_doc_terms(at, p.first)[1], minlength=bpe.table.n)
                if state:
                    n[: len(state["seen"])] += state["seen"]
                state.update(seen=n, names=bpe.names)
                n_docs, n_words = n_docs + j - i, n_words + len(p.starts)
        if state:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), pa.array([0, 0]), pa.array([n_docs, n_words])], ["kind", "term", "n"])

    counted = durable(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")))
    total = {r["kind"]: r["n"] for r in counted.where("kind > 0").collect()}  # two rows
    n_docs = total.get(1, 0)
    return n_docs, total.get(2, 0) / max(1, n_docs), counted.where("kind = 0 and n > 1").select("term", "n")


def _gathered(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A counted number of terms, sorted, and their frequencies."""
    rows = terms.select("term", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    term, df = rows["term"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int32)
    order = np.argsort(term)
    return term[order], df[order]


def _idf(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)


def _looked_up(own: np.ndarray, terms: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Frequency of each term; one that is not in the sorted ``terms`` has one document."""
    at = np.searchsorted(terms, own)
    known = (terms[np.minimum(at, len(terms) - 1)] == own) if len(terms) else np.zeros(len(own), bool)
    out = np.ones(len(own), np.int64)
    out[known] = df[at[known]]
    return out


class Shard:
    """An inverted index with BM25 impacts over some documents; ``term`` numbers the terms from 0."""

    def __init__(self, doc, term, tf, n_docs: int, lengths, idf, mean: float, dense: int = DENSE):
        self.n = n_docs
        impact = idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean, 1e-9)))).astype(np.float32)
        self.doc_first = np.searchsorted(doc, np.arange(n_docs + 1))
        df = np.bincount(term, minlength=len(idf))
        wide = np.flatnonzero(df * dense > n_docs)
        self.row = np.full(len(idf), -1)
        self.row[wide] = np.arange(len(wide))
        self.impacts = np.zeros((len(wide), n_docs), np.float32)
        own = self.row[term]
        self.impacts[own[own >= 0], doc[own >= 0]] = impact[own >= 0]
        self.term = term
        thin = np.flatnonzero(own < 0)
        thin = thin[np.argsort(term[thin], kind="stable")]
        self.post_doc, self.post_impact = doc[thin], impact[thin]
        self.post_first = np.concatenate([[0], np.cumsum(np.where(self.row < 0, df, 0))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document of the shard for all terms of the seed."""
        query = self.term[self.doc_first[seed] : self.doc_first[seed + 1]]
        rows = self.row[query]
        rare = query[rows < 0]
        begins = self.post_first[rare]
        at = spread(begins, self.post_first[rare + 1] - begins)
        return np.bincount(self.post_doc[at], weights=self.post_impact[at], minlength=self.n) + np.add.reduce(self.impacts[rows[rows >= 0]], axis=0)


def pack_shard(lengths: np.ndarray, shard: Shard, window: int):
    """Yield sequences, each a list of (document, start, length), that hold every id of the shard once."""
    n = len(lengths)
    start = np.zeros(n, np.int64)
    for d in np.flatnonzero(lengths >= window).tolist():
        while lengths[d] - start[d] >= window:
            yield [(d, int(start[d]), window)]
            start[d] += window
    left = lengths - start
    unused, seed = left > 0, 0
    open_window: list[tuple[int, int, int]] = []
    while True:
        while seed < n and not unused[seed]:
            seed += 1
        if seed == n:
            break
        filled, space = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        unused[seed] = False
        if space:
            score = shard.scores(seed)
            score[~unused] = -1.0
            near = np.flatnonzero(score >= 0)
            want = min(len(near), 64)
            while space and len(near):
                top = near[np.argpartition(-score[near], want - 1)[:want]] if want < len(near) else near
                top = top[np.lexsort((top, -score[top]))]
                for d in top.tolist():
                    if left[d] <= space:
                        filled.append((d, int(start[d]), int(left[d])))
                        space -= int(left[d])
                        unused[d] = False
                        if not space:
                            break
                if space:
                    rest = top[unused[top]]
                    if len(rest):  # the nearest that is too long fills the window with its first part
                        d = int(rest[0])
                        filled.append((d, int(start[d]), space))
                        start[d] += space
                        left[d] -= space
                        space = 0
                    else:
                        near = near[unused[near]]
        if space:
            open_window = filled
            break
        yield filled
    # What a shard leaves: no document is unused, and one window is open.
    rest = sum(k for *_, k in open_window)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out, need = [], size
        while need:
            d, s, k = open_window.pop(0)
            take = min(k, need)
            out.append((d, s, take))
            need -= take
            if take < k:
                open_window.insert(0, (d, s + take, k - take))
        yield out
        rest -= size


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class _Open:
    """The shard that is being gathered: documents with their ids and terms."""

    def __init__(self, path: str, end_id: int, window: int):
        self.bpe, self.end_id, self.window = load(path), end_id, window
        self.clear()

    def clear(self) -> None:
        self.names: list[pa.Array] = []
        self.parts: list[tuple] = []
        self.n_docs = self.n_ids = 0

    def add(self, doc_ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> None:
        bpe, p = self.bpe, self.bpe.split(buf, off)
        at = bpe.index(p)
        k = bpe.counts[at].astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(k)])[p.first]
        flat = bpe.flat[spread(bpe.first[at], k)]
        ids = np.insert(flat, begins[1:], np.uint16(self.end_id))
        doc, term, tf = _doc_terms(at, p.first)
        self.names.append(doc_ids)
        self.parts.append((np.diff(begins) + 1, ids, np.diff(p.first), doc.astype(np.int32), bpe.names[term], tf.astype(np.float32)))
        self.n_docs, self.n_ids = self.n_docs + len(doc_ids), self.n_ids + len(ids)

    @property
    def room(self) -> int:
        """No fewer than the sequences that the shard becomes."""
        return self.n_docs + self.n_ids // self.window + 64

    def repeated(self) -> np.ndarray:
        """The terms that two documents of the shard have."""
        own, n = np.unique(np.concatenate([x[4] for x in self.parts]), return_counts=True)
        return own[n > 1]

    def packed(self, first: int, idf_of, mean: float, keep_ids: bool):
        """Batches of pieces; sequences are numbered from ``first``."""
        ident = pa.concat_arrays(self.names)
        n_ids = np.concatenate([x[0] for x in self.parts])
        ids = np.concatenate([x[1] for x in self.parts])
        bases = np.cumsum([0, *(len(x[0]) for x in self.parts)])
        doc = np.concatenate([x[3] + np.int32(k) for x, k in zip(self.parts, bases)])
        own, term = np.unique(np.concatenate([x[4] for x in self.parts]), return_inverse=True)
        shard = Shard(doc, term, np.concatenate([x[5] for x in self.parts]), len(n_ids), np.concatenate([x[2] for x in self.parts]), idf_of(own), mean)
        begin = np.cumsum(n_ids) - n_ids
        rows, pay = [], []

        def batch():
            x = np.array(rows, np.int64)
            cols = [ident.take(pa.array(x[:, 0])), pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(x[:, 3]), pa.array(n_ids[x[:, 0]]), pa.array(x[:, 4]), pa.array(x[:, 5])]
            return pa.RecordBatch.from_arrays(cols + ([pa.array(pay, pa.list_(pa.int32()))] if keep_ids else []), _PIECE + (["ids"] if keep_ids else []))

        for number, sequence in enumerate(pack_shard(n_ids, shard, self.window), first):
            at = 0
            for d, s, k in sequence:
                own_ids = ids[begin[d] + s : begin[d] + s + k].astype("<u4")
                rows.append((d, s, k, zlib.crc32(own_ids.tobytes()), number, at))
                if keep_ids:
                    pay.append(own_ids.astype(np.int32))
                at += k
            if len(rows) >= 20_000:
                yield batch()
                rows, pay = [], []
        if rows:
            yield batch()


def _shards(batches, shard: _Open, most_docs: int, most_ids: int, keep: bool = False):
    """Fill the shard from the batches; yields (first number of its sequences, with ``keep`` the rows that it is made of) when it
    is full."""
    number, held = row_base(), []

    for b in batches:
        buf, off = utf8(b.column(1))
        for i, j in pieces(off):
            shard.add(b.column(0)[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i])
            if keep:
                held.append(b.slice(i, j - i))
            if shard.n_docs >= most_docs or shard.n_ids >= most_ids:
                yield number, held
                number += shard.room
                shard.clear()
                held = []
    if shard.n_docs:
        yield number, held


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS, keep_ids: bool = False, most_terms: int = MOST_TERMS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, if asked for, ``ids``.

    A document is its ids and ``end_id``; each id lies in exactly one piece.  Sequences hold exactly ``window`` ids, or a
    power of two.  A null or empty text is the end id alone.  Rows that repeat a document are packed each; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, mean, terms = corpus_statistics(rows, path)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    if terms.count() <= most_terms:
        held = spark.sparkContext.broadcast(_gathered(terms))

        def run(batches):
            shard = _Open(path, end_id, window)
            for number, _ in _shards(batches, shard, shard_docs, shard_ids):
                yield from shard.packed(number, lambda own: _idf(n_docs, _looked_up(own, *held.value)), mean, keep_ids)

        return rows.mapInArrow(tidy(run), schema)

    def members(batches):
        for number, held in _shards(batches, _Open(path, end_id, window), shard_docs, shard_ids, keep=True):
            for b in held:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number)), *b.columns], ["shard", "doc_id", "text"])

    def repeated(batches):
        shard = _Open(path, end_id, window)
        for number, _ in _shards(batches, shard, shard_docs, shard_ids):
            own = shard.repeated()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own.view(np.int64))], ["shard", "term"])

    def one(own: pa.Table, known: pa.Table) -> pa.Table:
        shard = _Open(path, end_id, window)
        for b in own.sort_by("at").combine_chunks().to_batches():  # in the order of the other way
            buf, off = utf8(b.column(2))
            for i, j in pieces(off):
                shard.add(b.column(1)[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i])
        term, df = known["term"].to_numpy().astype(np.int64).view(np.uint64), known["n"].to_numpy().astype(np.int64)
        order = np.argsort(term)
        return pa.Table.from_batches(shard.packed(own["shard"][0].as_py(), lambda x: _idf(n_docs, _looked_up(x, term[order], df[order])), mean, keep_ids))

    placed = rows.mapInArrow(tidy(members), "shard long, doc_id long, text string").withColumn("at", F.monotonically_increasing_id())
    known = rows.mapInArrow(tidy(repeated), "shard long, term long").join(terms, "term")
    return placed.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(one, schema)
