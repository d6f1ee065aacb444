"""Toxicity with noisy-channel deobfuscation.

Every token, of any length, is a character lattice: a sign stands for the letters it resembles, a letter of another
script for the one it looks like, a mask for any letter, a repeated letter may be one, separators may go or end a word,
and letters spelled one by one are one token.  Viterbi decoding under a character trigram model, counted over the words
of all documents, finds the likeliest word.  Tokens whose lattice has one path alone, their own letters, need no search.

The restored text is scored by a lexicon of words and word beginnings with a positive lower confidence bound
of their log-odds between toxic and clean training documents, and a logistic fit of a document's strongest
entries, on training rows that the lexicon has not seen.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, Table, hash_spans, padded, pieces, runs, spread, utf8
from ._labels import fold, logistic, training_labels
from ._spark import durable, tidy, tune

#: Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Letters of other scripts that look like Latin ones.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ɡ": "g",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "κ": "k", "ν": "v", "ι": "i",
}
#: Letters spelled one by one that are read as one word alone, and that may be part of one; bytes of a token that may be the
#: rest of it; decoded forms kept per worker.
SPELLED, FEW, REST, KEPT = 3, 2, 3, 30_000
#: Channel costs of a separator inside a token: that it goes, that it ends a word; the first pair where all its letters stand alone.
ALONE, INSIDE = (0.1, 4.0), (4.5, 0.5)
#: Training rows of each class at most; entries of the model, the strongest; deviations of the confidence bound.
MOST_LABELS, MOST_ENTRIES, BOUND = 12_000, 1 << 16, 1.64
#: Figures of a document that the logistic fit weighs.
EVIDENCE = 6
#: Bytes of the word beginnings that are entries beside whole words.
PREFIXES = (4, 5, 6, 7, 8, 10)

#: Bytes that are worked on at once: many arrays of a number for each byte.
PIECE = 1 << 18

# Classes of bytes: 0 white space, 1 letter, 2 looks like a letter, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[ord(c) for c in LOOKS]] = 2
# Bytes that a token's core begins and ends with, beside letters: digits and the signs that end no sentence.
_SOLID = np.zeros(256, bool)
_SOLID[0x30:0x3A] = _SOLID[[ord("$"), ord("@")]] = True
# Lead bytes of Greek, Cyrillic and full-width letters.
_FOREIGN = np.zeros(256, bool)
_FOREIGN[[0xC9, *range(0xCE, 0xD5), 0xEF]] = True
# Symbols of the character model: 0 boundary, 1 to 26 letters, 27 any other letter.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0xC0:0x100] = 27
_N = 28


# -- the character model ------------------------------------------------------------------------


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts [28, 28, 28] of character trigrams over the words of all documents."""

    def run(batches):
        total = np.zeros(_N**3, np.int64)
        for b in batches:
            buf, off = utf8(b.column(0))
            for i, j in pieces(off, PIECE):
                own = buf[off[i] : off[j]]
                own = own[(own < 0x80) | (own >= 0xC0)]  # one symbol for each character
                x = np.concatenate([np.zeros(2, np.int32), _SYMBOL[own], np.zeros(1, np.int32)])
                code = (x[:-2] * _N + x[1:-1]) * _N + x[2:]
                # A trigram inside or at the edge of a word; across a gap, only the boundary counts as context.
                code = np.where((x[1:-1] == 0) & (x[:-2] != 0), x[2:], code)
                total += np.bincount(code, minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 28^3 rows
    out = np.zeros(_N**3, np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(_N, _N, _N)


def costs(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log P(c | a, b), each order smoothed by the one below."""
    c = counts.astype(np.float64).copy()
    c[:, 0, 0] = 0  # gaps longer than one
    one = (c.sum((0, 1)) + 1) / (c.sum() + _N)
    two = (c.sum(0) + weight * one) / (c.sum((0, 2))[:, None] + weight)
    three = (c + weight * two[None]) / (c.sum(2, keepdims=True) + weight)
    return -np.log(three)


@functools.lru_cache(maxsize=1 << 14)
def _options(ch: str, drawn: int, separator: tuple[float, float]) -> list[tuple[int, str, float]]:
    """(symbol, character, channel cost) of what a character may stand for; symbol -1: nothing is written."""
    if "\uff21" <= ch <= "\uff5a":  # full width
        ch = chr(ord(ch) - 0xFEE0).lower()
    once = [(-1, "", 2.5 if drawn == 2 else 0.2)] if drawn > 1 else []  # a double letter may well be meant
    if "a" <= ch <= "z":
        return [(ord(ch) - 96, ch, 0.0), *once]
    if ch in LOOKS:
        letters = LOOKS[ch]
        return [(ord(c) - 96, c, 0.5 + math.log(len(letters))) for c in letters] + [(-1, "", 9.0), *once]
    if ch in ALIKE:
        return [(27, ch, 0.0), (ord(ALIKE[ch]) - 96, ALIKE[ch], 0.5), *once]
    if ord(ch) >= 128:
        return [(27, ch, 0.0), *once]
    return [(-1, "", separator[0]), (0, " ", separator[1])]


def restore(token: str, cost: np.ndarray, nested: list | None = None, tails: dict | None = None) -> str:
    """The likeliest word behind a lower-cased token, by Viterbi search of its character lattice; linear in its length.

    Letters stay; a letter or sign like the one before may be a repetition of it; a sign is one of the letters that it
    resembles, or nothing; a separator is nothing, or ends a word (a space in the result).  Of paths of equal cost the
    result that sorts first stays; in a token with several masks, which is searched over all pairs of symbols at once, one of
    them stays, always the same.  Paths are kept as linked tails, so a long token costs no more for each character.  ``nested`` is
    ``cost.tolist()`` and ``tails`` an empty dict, for callers that restore many tokens.
    """
    alone = not any(a.isalpha() and b.isalpha() for a, b in zip(token, token[1:]))
    separator = ALONE if alone else INSIDE
    masks = len(token) - len(token.rstrip("*"))
    if token.count("*") > max(1, masks):
        return _restore_masked(token, cost, separator)[1].strip()
    table = cost.tolist() if nested is None else nested  # Python's own floats are the faster ones here
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    before, drawn = "", 1
    for ch in token[: len(token) - masks] if masks > 1 else token:
        drawn = drawn + 1 if ch == before else 1
        options = _options(ch, min(drawn, 3), separator)
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (so_far, tail) in states.items():
            for symbol, c, channel in options:
                if symbol < 0:
                    key, total, out = (a, b), so_far + channel, tail
                elif symbol == 0:
                    if b == 0:
                        continue
                    key, total, out = (0, 0), so_far + channel + table[a][b][0], (tail, c)
                else:
                    key, total, out = (b, symbol), so_far + channel + table[a][b][symbol], (tail, c)
                held = new.get(key)
                if held is None or total < held[0] or (total == held[0] and _text(out) < _text(held[1])):
                    new[key] = (total, out)
        states, before = new, ch
    if masks > 1:  # what masks at the end stand for depends on the last two symbols before them alone
        tails, ends = {} if tails is None else tails, []
        for (a, b), (total, tail) in states.items():
            if (a, b, masks) not in tails:
                tails[a, b, masks] = _restore_masked("*" * masks, cost, separator, (a, b))
            more, text = tails[a, b, masks]
            ends.append((total + more, _text(tail) + text))
        return min(ends)[1].strip()
    return min((total + table[a][b][0], _text(tail)) for (a, b), (total, tail) in states.items())[1].strip()


def _restore_masked(token: str, cost: np.ndarray, separator: tuple[float, float], state: tuple[int, int] = (0, 0)) -> tuple[float, str]:
    """The same search over all pairs of symbols at once, for tokens with several masks: cost and text; ``state`` has the symbols
    before."""
    dist = np.full((_N, _N), np.inf)
    dist[state] = 0.0
    steps, before, drawn = [], "", 1
    for ch in token:
        drawn = drawn + 1 if ch == before else 1
        # From (a, b) to (b, symbol): the best a, and what is written; or (a, b) stays and nothing is written.
        new, back, written = np.full((_N, _N), np.inf), np.full((_N, _N), -2), {}
        for symbol, c, channel in _options(ch, min(drawn, 3), separator):
            if symbol < 0:
                better = dist + channel < new
                new[better], back[better] = (dist + channel)[better], -1
                continue
            through = dist + cost[:, :, symbol]
            best = through.argmin(0)
            total = through[best, np.arange(_N)] + channel
            written[symbol] = c
            if symbol == 0:  # a word ends: all of them meet in (0, 0)
                b = int(total[1:].argmin()) + 1
                if total[b] < new[0, 0]:
                    new[0, 0], back[0, 0] = total[b], _N * (b + 1) + best[b]
                continue
            better = total < new[:, symbol]
            new[better, symbol], back[better, symbol] = total[better], best[better]
        steps.append((back, written))
        dist, before = new, ch
    final = dist + cost[:, :, 0]
    a, b = divmod(int(final.argmin()), _N)
    least = float(final[a, b])
    out = []
    for back, written in reversed(steps):
        k = int(back[a, b])
        if k == -1:
            continue
        out.append(written[b])
        a, b = (k % _N, k // _N - 1) if k >= _N else (k, a)
    return least, "".join(reversed(out))


def _text(tail: tuple) -> str:
    out = []
    while tail:
        tail, c = tail
        out.append(c)
    return "".join(reversed(out))


# -- words ---------------------------------------------------------------------------------------


class Restorer:
    """Words of documents, with disguised tokens restored; decoded forms are kept per worker process."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.nested, self.kept, self.tails = cost, cost.tolist(), {}, {}

    def _restored(self, token: str) -> list[bytes]:
        if token not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = [w.encode() for w in restore(token, self.cost, self.nested, self.tails).split()]
        return self.kept[token]

    def words(self, buf: np.ndarray, off: np.ndarray):
        """(padded buffer, starts, ends, document) of all words.

        Letter runs of plain tokens are words.  A token's core, from its first to its last letter, digit, $ or @, is replaced by
        what it restores to if it has more than one path.  A token with further signs around its core (``**iot``, ``idio*``) may
        be a word with its ends masked or one in punctuation, so it gives the word restored from all of it beside the core's.
        Letters spelled one by one are a word; of two of them, or with a short token before or behind, the joined forms are
        words beside the tokens.
        """
        kind, n = _CLASS[buf], len(buf)
        low = LOWER[buf]
        at = np.flatnonzero((buf == 0xC3)[:-1]) if n else np.zeros(0, np.int64)
        up = at[(buf[at + 1] >= 0x80) & (buf[at + 1] < 0x9F) & (buf[at + 1] != 0x97)] if len(at) else at
        low[up + 1] += 0x20
        starts, ends, _, first = runs((kind > 0).astype(np.uint8), off)
        token_doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        letter = kind == 1
        begin, end, some = _between(letter | _SOLID[buf], starts, ends)
        count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        double = np.zeros(n, bool)
        if n > 1:
            double[1:] = (low[1:] == low[:-1]) & letter[1:]
        # More than one path: signs or separators, letters twice in a row, letters of other scripts.
        paths = count(~letter | double | (_FOREIGN[buf] & letter))
        odd = some & (paths[end] - paths[begin] > 0)
        # Signs that look like letters around a core.
        wide, behind, _ = _between(kind < 3, starts, ends) if n else (starts, ends, some)
        masked = np.flatnonzero(some & ((wide < begin) | (behind > end)))
        # Letters spelled one by one: several tokens of one character in a row.
        lone = some & (ends - starts == 1)
        spelled = np.zeros(len(starts), bool)
        data = low.tobytes()
        written = lambda k: data[starts[k] : ends[k]].decode("utf-8", "replace")
        joined: list[tuple[int, str]] = []
        if lone.any():
            s, e, _, _ = runs(lone.astype(np.uint8), first)
            for i, j in zip(s.tolist(), e.tolist()):
                if j - i >= SPELLED:
                    joined.append((i, " ".join(map(written, range(i, j)))))
                    spelled[i:j] = True
                if j - i >= FEW:
                    own = "".join(map(written, range(i, j)))
                    left = written(i - 1) if i > first[token_doc[i]] and ends[i - 1] - starts[i - 1] <= REST else ""
                    right = written(j) if j < first[token_doc[i] + 1] and ends[j] - starts[j] <= REST else ""
                    joined += [(i, x) for x in sorted({own, left + own, own + right, left + own + right} - ({own} if j - i >= SPELLED else set()))]
        odd &= ~spelled
        hidden = np.flatnonzero(odd | spelled)
        if len(hidden):
            kind = kind.copy()
            kind[spread(starts[hidden], ends[hidden] - starts[hidden])] = 0
        ws, we, _, wfirst = runs((kind == 1).astype(np.uint8), off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(wfirst))
        at = np.flatnonzero(odd)
        b, e = np.concatenate([begin[at], wide[masked]]), np.concatenate([end[at], behind[masked]])
        if not len(b) and not joined:
            return padded(low), ws, we, doc
        # Each distinct form once.
        _, one, which = np.unique(hash_spans(padded(low), b, e), return_index=True, return_inverse=True)
        forms = [self._restored(data[i:j].decode("utf-8", "replace")) for i, j in zip(b[one].tolist(), e[one].tolist())]
        forms += [self._restored(x) for _, x in joined]
        which = np.concatenate([which, len(one) + np.arange(len(joined))])
        of = np.concatenate([token_doc[at], token_doc[masked], token_doc[np.array([i for i, _ in joined], np.int64)]])
        lens = np.array([len(w) for f in forms for w in f], np.int64)
        n_words = np.array([len(f) for f in forms], np.int64)
        extra = np.frombuffer(b"".join(w for f in forms for w in f), np.uint8)
        pick = spread((np.cumsum(n_words) - n_words)[which], n_words[which])
        e = np.cumsum(lens) + n
        owner = np.concatenate([doc, np.repeat(of, n_words[which])])
        order = np.argsort(owner, kind="stable")
        return padded(np.concatenate([low, extra])), np.concatenate([ws, (e - lens)[pick]])[order], np.concatenate([we, e[pick]])[order], owner[order]


def _between(good: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the first to behind the last good byte of each token, and whether it has one; empty where it has none."""
    n = len(good)
    if not len(starts):
        return starts, ends, np.zeros(0, bool)
    place = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    last = np.maximum.accumulate(np.where(good, place, place.dtype.type(-1)))
    head = np.minimum.accumulate(np.where(good, place, place.dtype.type(n))[::-1])[::-1]
    begin, end = head[starts].astype(np.int64), last[ends - 1].astype(np.int64) + 1
    some = (begin < end) & (begin < ends)
    return np.where(some, begin, starts), np.where(some, end, starts), some


_RESTORERS: dict[str, Restorer] = {}


def _restorer(held) -> Restorer:
    """One restorer per broadcast model (its name and costs) and worker process."""
    name, cost = held.value
    if name not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[name] = Restorer(cost)
    return _RESTORERS[name]


def entry_hashes(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word as entries of the lexicon: the whole, and its beginnings (0 where it is no longer)."""
    out = [hash_spans(pad, starts, ends, 1)]
    for k in PREFIXES:
        h = hash_spans(pad, starts, np.minimum(ends, starts + k), 2)
        h[ends - starts <= k] = 0
        out.append(h)
    return out


# -- lexicon and scores --------------------------------------------------------------------------


def lexicon(train: DataFrame, held, totals: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``train(text, y)`` -> hashes and weights of the entries whose log-odds are surely positive."""

    def run(batches):
        restorer = _restorer(held)
        for b in batches:
            buf, off = utf8(b.column(0))
            y = np.asarray(b.column(1)).astype(np.int64)
            for i, j in pieces(off, PIECE):
                pad, starts, ends, doc = restorer.words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                h = np.concatenate(entry_hashes(pad, starts, ends))
                d = np.tile(doc, 1 + len(PREFIXES))
                d, h = d[h != 0], h[h != 0]
                order = np.lexsort((d, h))
                d, h = d[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                d, h = d[new], h[new]
                cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                toxic = np.add.reduceat(y[i:j][d], cut) if len(cut) else cut
                n = np.diff(np.append(cut, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], ["entry", "toxic", "clean"])

    counts = train.select("text", "y").mapInArrow(tidy(run), "entry long, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    bound = F.log(a / (totals[1] + 1.0)) - F.log(b / (totals[0] + 1.0)) - BOUND * F.sqrt(1 / a + 1 / b)
    top = counts.where("a > 1").select("entry", bound.alias("weight")).where("weight > 0.2").orderBy(F.desc("weight"), "entry").limit(MOST_ENTRIES).collect()  # bounded
    return np.array([r["entry"] for r in top], np.int64).view(np.uint64), np.array([r["weight"] for r in top])


def evidence(buf: np.ndarray, off: np.ndarray, restorer: Restorer, table: Table, weights: np.ndarray) -> np.ndarray:
    """[documents, EVIDENCE]: strongest entry, sum of the three strongest words, log number and share of words with an
    entry, log number of strong words, log sum over distinct words."""
    pad, starts, ends, doc = restorer.words(buf, off)
    n = len(off) - 1
    out = np.zeros((n, EVIDENCE))
    if not len(starts):
        return out
    best = np.full(len(starts), -1.0)
    for h in entry_hashes(pad, starts, ends):
        at = table.find(np.where(h == 0, np.uint64(1), h))
        best = np.maximum(best, np.where((at >= 0) & (h != 0), weights[np.maximum(at, 0)] if len(weights) else 0.0, -1.0))
    hit = np.flatnonzero(best > 0)
    word = hash_spans(pad, starts[hit], ends[hit], 1)
    order = np.lexsort((word, -best[hit], doc[hit]))
    hit, word = hit[order], word[order]
    d, w = doc[hit], best[hit]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (word[1:] != word[:-1])
    rank_base = np.concatenate([[0], np.cumsum(new)])
    first = np.searchsorted(d, np.arange(n))
    rank = rank_base[:-1] - rank_base[first[d]] if len(d) else d
    top = new & (rank < 3)
    np.maximum.at(out[:, 0], d, w)
    np.add.at(out[:, 1], d[top], w[top])
    hits, words = np.bincount(d, minlength=n), np.bincount(doc, minlength=n)
    out[:, 2], out[:, 3] = np.log1p(hits), hits / np.maximum(words, 1)
    out[:, 4] = np.log1p(np.bincount(d[w > 1.5], minlength=n))
    out[:, 5] = np.log1p(np.bincount(d[new], weights=w[new], minlength=n))
    return out


_SCORE = "__toxicity_score"


def annotated(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, column: str = "toxic", most: int = MOST_LABELS, name: str = _SCORE) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with their score in the column ``name``, which ``docs`` does not have.

    Only labels whose fold is not ``held`` are learnt, at most ``most`` of each class.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen, weight = training_labels(labels, column, modulus, held, most)
    if len(weight) < 2:
        return docs.withColumn(name, F.lit(float(next(iter(weight))) if weight else 0.0))
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, costs(trigram_counts(rows))))
    picked = durable(chosen)  # at most 2 x most rows of two numbers
    apart = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0  # a fifth fits the logistic part
    train = durable(rows.join(F.broadcast(picked) if most <= MOST_LABELS else picked, "doc_id").select("doc_id", "text", "y", apart.alias("apart")))
    totals = {r["y"]: r["count"] for r in train.where("not apart").groupBy("y").count().collect()}
    entries, strengths = lexicon(train.where("not apart"), model, {0: totals.get(0, 0), 1: totals.get(1, 0)})
    lex = spark.sparkContext.broadcast((entries, strengths))

    def reader():
        table = Table(12)
        if len(lex.value[0]):
            table.add(lex.value[0], np.arange(len(lex.value[0])))
        restorer, weights = _restorer(model), lex.value[1]

        def read(column: pa.Array) -> np.ndarray:
            buf, off = utf8(column)
            x = [evidence(buf[off[i] : off[j]], off[i : j + 1] - off[i], restorer, table, weights) for i, j in pieces(off, PIECE)]
            return np.concatenate([*x, np.zeros((0, EVIDENCE))])

        return read

    def measure(batches):
        read = reader()
        for b in batches:
            x = read(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * EVIDENCE), pa.array(x.reshape(-1)))], ["y", "x"])

    fit_rows = train.where("apart")
    if fit_rows.select("y").distinct().count() < 2:
        fit_rows = train
    seen = fit_rows.select("text", "y").mapInArrow(tidy(measure), "y int, x array<double>").groupBy("y", "x").count().collect()  # at most 2 x most rows
    if not seen:  # no labelled document is in the table
        return docs.withColumn(name, F.lit(0.0))
    x = np.array([r["x"] for r in seen])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    beta = logistic(x / scale, np.array([float(r["y"]) for r in seen]), np.array([r["count"] * weight[r["y"]] for r in seen]), ridge=0.1)

    def score(batches):
        read = reader()
        for b in batches:
            s = 1 / (1 + np.exp(-np.clip((read(b.column(b.num_columns - 1)) / scale) @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.round(s, 6))], [*b.schema.names[:-1], name])

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(tidy(score), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, column: str = "toxic", threshold: float = 0.3, most: int = MOST_LABELS) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``labels(doc_id, toxic)`` -> ``(doc_id, held_out, score, predicted)``, one row per
    row of ``docs``.

    Null and empty texts have no words and score like a text without entries.  With no labels, or of one class only,
    every score is the share of label 1 (0 without labels, or if no labelled document is in ``docs``).  Repeated rows
    are scored each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = F.col(_SCORE)
    return annotated(rows, labels, modulus, held, column, most).select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is below ``threshold``.

    Null and empty texts have no words and stay; repeated rows share their score; an empty table gives no rows, and without
    labels of both classes the share of label 1 is every score."""
    name = _SCORE
    while name in docs.columns:
        name = f"_{name}"
    return annotated(docs, labels, name=name).where(F.col(name) < threshold).drop(name)
