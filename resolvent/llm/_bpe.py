"""Pre-tokens and ids of the word-level BPE tokenizer file, without a Python object per token.

Documents of ASCII and Latin-1 letters are split by byte classes in numpy, exactly as the file's
normaliser (NFC, white space, lower case) and pre-tokenizer would; every other document, and any that
holds a special string or odd control, goes through the library's own normaliser and pre-tokenizer.  Ids
come from the library's BPE model, once per distinct pre-token and worker.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from ._arrow import LOWER, Table, hash_spans, padded, runs, spread

#: Byte classes: 0 white space, 1 letter, 2 digit, 3 other, 4 lead byte of a Latin-1 letter, 5 not handled here.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(0x1C, 0x20), *range(0x80, 0x100)]] = 5
_CLASS[[*range(0x09, 0x0E), 0x20]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0xC3] = 4
#: Second bytes of the Latin-1 letters that 0xC3 leads; 0x97 and 0xB7 are signs.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """Pre-tokens of a run of documents: byte spans in one padded buffer, and where documents begin."""

    __slots__ = ("pad", "starts", "ends", "first")

    def __init__(self, pad, starts, ends, first):
        self.pad, self.starts, self.ends, self.first = pad, starts, ends, first

    def hashes(self) -> np.ndarray:
        return hash_spans(self.pad, self.starts, self.ends)


def _contractions(low: np.ndarray, starts, ends, kinds, first):
    """Move the s, t, m, d, re, ve or ll behind a lone apostrophe from its word to the apostrophe."""
    at = np.flatnonzero((kinds[:-1] == 3) & (kinds[1:] == 1) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]))
    at = at[low[starts[at]] == 0x27]
    if not at.size:
        return starts, ends, first
    doc = np.searchsorted(first, at, side="right")
    at = at[at + 1 < first[np.minimum(doc, len(first) - 1)]]
    a = low[starts[at + 1]]
    b = np.where(ends[at + 1] - starts[at + 1] > 1, low[np.minimum(starts[at + 1] + 1, len(low) - 1)], 0)
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
    take = np.where(one, 1, np.where(two, 2, 0))
    starts, ends = starts.copy(), ends.copy()
    ends[at] += take
    starts[at + 1] += take
    keep = ends > starts
    gone = np.concatenate([[0], np.cumsum(~keep)])
    return starts[keep], ends[keep], first - gone[first]


class WordBPE:
    """The tokenizer file at ``path`` with a bounded cache of pre-token ids per worker process."""

    #: Distinct pre-tokens held before the cache starts anew, and how often it has.
    CACHE = 1_500_000
    generation = 0

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self._check()
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special_bytes = {name.encode(): i for name, i in self.special.items()}
        self.model, alphabet = self.tok.model, byte_alphabet()
        self.to_level = [alphabet[b] for b in range(256)]
        self.from_level = {ord(c): b for b, c in alphabet.items()}
        self.reset()

    def _check(self) -> None:
        """Raise unless the file splits texts as this module does: probes of each rule, against the library's own split."""
        given = "Ab cÉ\t12 3x it's WE'LL ''s --- a_b  $5.0\n\u00d7z\u00df!?"
        kind = json.loads(self.tok.to_str())
        if (kind.get("model") or {}).get("type") != "BPE" or self.tok.normalizer is None or self.tok.pre_tokenizer is None:
            raise ValueError("the tokenizer file is no word-level BPE with a normaliser and a pre-tokenizer")
        wanted = ["ab", "cé", "1", "2", "3", "x", "it", "'s", "we", "'ll", "''", "s", "---", "a", "_", "b", "$", "5", ".", "0", "×", "zß", "!?"]
        if [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(given))] != ["".join(byte_alphabet()[b] for b in w.encode()) for w in wanted]:
            raise ValueError("the tokenizer file splits texts by other rules")

    def reset(self) -> None:
        self.table, self.first, self.flat, self.used = Table(16), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint16), 0
        self.counts, self.names = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.uint64)
        self.generation += 1

    # -- pre-tokens ---------------------------------------------------------------------------

    def _library(self, text: str) -> bytes:
        """Pre-tokens of any text as the library splits it, joined by line feeds (which none contains)."""
        out: list[bytes] = []
        rest = text
        while rest:
            at, name = min(((k, s) for s in self.special if (k := rest.find(s)) >= 0), default=(len(rest), ""), key=lambda x: (x[0], -len(x[1])))
            if at:
                norm = self.tok.normalizer.normalize_str(rest[:at])
                out += [bytes(self.from_level[ord(c)] for c in piece) for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
            if name:
                out.append(name.encode())
            rest = rest[at + len(name) :]
        return b"\n".join(out)

    def split(self, buf: np.ndarray, off: np.ndarray) -> Pieces:
        """Pre-tokens of documents given by bytes and offsets (starting at 0)."""
        kind = _CLASS[buf]
        lead = np.flatnonzero(kind == 4)
        odd = kind == 5
        if lead.size:
            nxt = np.minimum(lead + 1, len(buf) - 1)
            good = _SECOND[buf[nxt]]
            kind[lead] = 1
            kind[nxt[good]] = 1
            odd[nxt[good]] = False
            odd[lead[~good]] = True
        low = LOWER[buf]
        if lead.size:
            second = nxt[good & (buf[nxt] < 0x9F)]
            low[second] += 0x20
        # Documents that need the library: odd bytes or special strings.
        marks = np.flatnonzero(odd)
        bad = set((np.searchsorted(off, marks, side="right") - 1).tolist()) if marks.size else set()
        text = buf.tobytes()
        for s in self.special:
            at = text.find(s.encode())
            while at >= 0:
                bad.add(int(np.searchsorted(off, at, side="right")) - 1)
                at = text.find(s.encode(), at + 1)
        if bad:
            parts, kinds, lens = [], [], []
            for i in range(len(off) - 1):
                a, b = off[i], off[i + 1]
                if i in bad:
                    own = np.frombuffer(self._library(text[a:b].decode()), np.uint8)
                    parts.append(own)
                    kinds.append(np.where(own == 0x0A, 0, 9).astype(np.uint8))
                else:
                    parts.append(low[a:b])
                    kinds.append(kind[a:b])
                lens.append(len(parts[-1]))
            low, kind, off = np.concatenate(parts), np.concatenate(kinds), np.concatenate([[0], np.cumsum(lens)])
        starts, ends, kinds, first = runs(kind, off, single=2)
        starts, ends, first = _contractions(low, starts, ends, kinds, first)
        return Pieces(padded(low), starts, ends, first)

    # -- ids ----------------------------------------------------------------------------------

    def ids_of(self, piece: bytes) -> list[int]:
        """Ids of one pre-token (its normalised UTF-8 bytes)."""
        if piece in self.special_bytes:
            return [self.special_bytes[piece]]
        text = piece.decode("latin-1")
        if not (piece.isascii() and text.isprintable()):  # printable ASCII stands for itself
            text = "".join([self.to_level[b] for b in piece])
        return [t.id for t in self.model.tokenize(text)]

    def index(self, p: Pieces) -> np.ndarray:
        """Cache index of each pre-token, looking ids up where they are new."""
        if self.table.n > self.CACHE:
            self.reset()
        h = p.hashes()
        at = self.table.find(h)
        new = np.flatnonzero(at < 0)
        if new.size:
            fresh, where = np.unique(h[new], return_index=True)
            data, places = p.pad.tobytes(), new[where]
            ids = [self.ids_of(data[i:j]) for i, j in zip(p.starts[places].tolist(), p.ends[places].tolist())]
            n, base = np.array([len(x) for x in ids], np.int32), self.table.n
            while base + len(ids) > len(self.first):
                self.first, self.counts, self.names = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.counts, self.names))
            total = int(n.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = list(chain.from_iterable(ids))
            self.first[base : base + len(ids)] = self.used + np.cumsum(n) - n
            self.counts[base : base + len(ids)], self.names[base : base + len(ids)] = n, fresh
            self.used += total
            self.table.add(fresh, np.arange(base, base + len(ids)))
            at[new] = self.table.find(h[new])
        return at

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of all documents and where each document's begin."""
        p = self.split(buf, off)
        at = self.index(p)
        n = self.counts[at]
        begins = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return self.flat[spread(self.first[at], n)], begins[p.first]


_LOADED: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """The tokenizer at ``path``, once per process."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]
