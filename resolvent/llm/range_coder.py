"""Adaptive context-mixing range coder for 16-bit token ids, over many independent blocks in lockstep.

A block of ``BLOCK`` ids is coded from reset models.  Every id is coded under a linear mixture of three adaptive
predictions, P(x) = w2 [x = p2] + w1 [x = p1] + w0 P0(x):

* order 2 and order 1 predict the id that last followed the two previous ids (the previous id), p2 and p1, from
  direct-mapped tables with three levels of confidence;
* order 0 has the frequencies of the block's ids so far, and a fixed falling prior over all 65,536 ids for those it has
  not, weighted by the share of new ids since the last renewal.  Frequencies are renewed at the steps of ``RENEW``.

The weights are adaptive counts per state (both confidences, and whether the two predictions agree).  Order 0 lays
ids out in order of the renewal that found them, then of the id, and new ones by the prior behind; an id's parts of the
mixture are one interval there, whose width is its mixed probability in units of 2^-32.  The coder is a 64-bit range
coder that emits 16-bit words and carries into words already written.

Blocks share nothing: numpy codes all blocks of a group together, and any block can be decoded and verified alone;
its header has its number of ids, its words and the CRC-32 of its ids.  The encoder knows all ids, so it derives what
the tables hold at every step by sorting, and only the range arithmetic runs step by step; what it wrote is put together
at the end, carries included.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block (at most 2,048), blocks coded together, blocks modelled together, log2 of the slots of a table.
BLOCK, GROUP, CHUNK, SLOT_BITS = 2048, 4096, 64, 11
#: Ids after which a block's frequencies and weights are renewed.
RENEW = [32, 96, 256, 512, 1024, 1536]
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"RCB2"
_TOP = np.uint64(1 << 48)
_16, _32, _40, _48, _ID = np.uint64(16), np.uint64(32), np.uint64(40), np.uint64(48), np.uint64(0xFFFF)
#: Order 0 has PARTS parts of 2^12 units; the prior has 2^18 units, that is 64 parts, times the share of new ids.
PARTS, PRIOR, SHARES, WEIGHTS = 4096, 1 << 18, 64, 256
MASS = PARTS << 12
#: Marks an id that order 0 has not.
_NEW = 0xFFFF


def _prior() -> np.ndarray:
    """Exclusive cumulative units of the prior: one for each id, the rest falling as 1 / (id + 512)."""
    share = 1.0 / (np.arange(1 << 16) + 512.0)
    units = 1 + np.floor(share / share.sum() * (PRIOR - (1 << 16))).astype(np.int64)
    units[0] += PRIOR - units.sum()
    return np.concatenate([[0], np.cumsum(units)])


_CUM = _prior()
_UNITS = np.diff(_CUM)
#: Begin (from bit 40) and width (from bit 16) of each id in the prior.
_SPAN = (_CUM[:-1] << 40 | _UNITS << 16).astype(np.uint64)
#: The id at each unit of the prior.
_FIND = np.repeat(np.arange(1 << 16, dtype=np.uint16), _UNITS)
_HASH = (np.uint32(0x9E3779B1), np.uint32(0xC2B2AE35))


def _states() -> np.ndarray:
    """Initial counts [32, 3] of order 2, order 1 and order 0; 0 for what cannot occur."""
    s = np.arange(32)
    c2, c1, agree = s >> 2 & 3, s & 3, s >> 4
    one = np.array([0, 1, 4, 8])[c1] * ~((agree == 1) & (c2 > 0))
    return np.stack([np.array([0, 3, 12, 20])[c2], one, np.full(32, 10)], 1).astype(np.int32)


_COUNTS = _states()


def _weights(counts: np.ndarray) -> np.ndarray:
    """Weights of order 2 (bits 0 to 7), order 1 (bits 8 to 15) and order 0 (from bit 16, at least 1) per lane and state."""
    two, one = counts[..., 0], counts[..., 1]
    total = two + one + counts[..., 2]
    two, one = two * (WEIGHTS - 1) // total, one * (WEIGHTS - 1) // total
    return (two | one << 8 | (WEIGHTS - two - one) << 16).astype(np.uint32).reshape(-1)


def _slots(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of order 1 and order 2 behind the ids p and, before it, q (uint32)."""
    shift = np.uint32(32 - SLOT_BITS)
    a = p * _HASH[0]
    return a >> shift, (a + q * _HASH[1]) >> shift


def _entries(x: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """What a table holds at each step: the last position with the same slot and, from bit 12, its confidence; 0 if none."""
    lanes, steps = x.shape
    key = np.sort((slot << np.uint32(12)) | np.arange(steps, dtype=np.uint32), axis=1)
    at = (key & np.uint32(0xFFF)).astype(np.uint16)
    flat = at + (np.arange(lanes) * steps)[:, None]
    ids = x.reshape(-1).take(flat)
    key >>= np.uint32(12)
    same = key[:, 1:] == key[:, :-1]
    hit = np.zeros((lanes, steps + 1), bool)  # one column ahead
    np.logical_and(same, ids[:, 1:] == ids[:, :-1], out=hit[:, 2:])
    confidence = hit[:, 1:-1].view(np.uint8) + (hit[:, 1:-1] & hit[:, :-2]) + np.uint8(1)
    entry = np.zeros((lanes, steps), np.uint16)
    np.multiply(confidence.astype(np.uint16) << np.uint16(12) | at[:, :-1], same, out=entry[:, 1:])
    out = np.empty(lanes * steps, np.uint16)
    out[flat] = entry
    return out.reshape(lanes, steps)


def _order0(counts: np.ndarray, seen: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of each entry, in parts, from the counts [lanes, entries] of the ``seen`` ids."""
    end = np.cumsum(counts, axis=1, dtype=np.int32)
    end *= (PARTS - SHARES * share).astype(np.int32)[:, None]
    end //= np.int32(seen)
    width = end.copy()
    width[:, 1:] -= end[:, :-1]
    return end - width, width


def _share(new: np.ndarray, steps: int, seen: int) -> np.ndarray:
    """Share of new ids (of SHARES) where so many of the last ``steps`` ids were; leaves each id seen a part."""
    return np.clip(new * (SHARES * 7 // 8) // steps + 1, 1, min(SHARES - 8, (PARTS - seen) // SHARES))


def _epochs(steps: int) -> list[tuple[int, int]]:
    bounds = [0, *[e for e in RENEW if e < steps], steps]
    return list(zip(bounds, bounds[1:]))


def _intervals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width [lanes, steps] (uint32) of every id's interval, in units of 2^-32."""
    lanes, steps = x.shape
    before = np.zeros((lanes, steps + 2), np.uint32)
    before[:, 2:] = x
    slot1, slot2 = _slots(before[:, 1:-1], before[:, :-2])
    entry1, entry2 = _entries(x, slot1), _entries(x, slot2)
    # Each distinct id's entry in order 0 and the epoch that it is found in.
    epochs = _epochs(steps)
    row, lane32 = (np.arange(lanes) * steps)[:, None], (np.arange(lanes) * 32)[:, None]
    order = np.argsort(x, axis=1, kind="stable")
    sorted_at = (order + row).reshape(-1)
    ids = x.reshape(-1).take(sorted_at).reshape(lanes, steps)
    cut = np.ones((lanes, steps), bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=cut[:, 1:])
    starts = np.flatnonzero(cut)
    lane = starts // steps
    found = np.searchsorted([e for _, e in epochs], order.reshape(-1)[starts], side="right")
    by = np.argsort((lane * 16 + found).astype(np.uint16 if lanes <= CHUNK else np.int64), kind="stable")
    distinct = np.bincount(lane, minlength=lanes)
    entry = np.empty(len(starts), np.int64)
    entry[by] = np.arange(len(starts)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
    sizes = np.bincount(lane * len(epochs) + found, minlength=lanes * len(epochs)).reshape(lanes, -1)
    most = int(sizes.sum(1).max())
    place, epoch = np.empty((lanes, steps), np.int64), np.empty((lanes, steps), np.int8)
    size = np.diff(np.append(starts, lanes * steps))
    place.reshape(-1)[sorted_at] = np.repeat(lane * most + entry, size)
    epoch.reshape(-1)[sorted_at] = np.repeat(found.astype(np.int8), size)
    flat, begin_at = x.reshape(-1), np.empty((lanes, steps), np.uint32)  # the begin, in order 0, of the id at each step so far
    counts, weigh = np.zeros((lanes, most), np.int32), np.tile(_COUNTS, (lanes, 1, 1))
    begins, widths = np.empty((lanes, steps), np.uint32), np.empty((lanes, steps), np.uint32)
    for k, (t0, t1) in enumerate(epochs):
        weight = _weights(weigh)
        if k:
            s0 = epochs[k - 1][0]
            counts += np.bincount(place[:, s0:t0].reshape(-1), minlength=counts.size).reshape(counts.shape).astype(np.int32)
            share = _share(sizes[:, k - 1], t0 - s0, t0)
            begin0, width0 = _order0(counts, t0, share)
            begin0, width0 = (begin0.reshape(-1) << 12).view(np.uint32), (width0.reshape(-1) << 12).view(np.uint32)
        else:
            share, begin0, width0 = np.full(lanes, SHARES), np.zeros(counts.size, np.uint32), np.zeros(counts.size, np.uint32)
        base = (PARTS - SHARES * share) << 12
        ids, e1, e2 = x[:, t0:t1], entry1[:, t0:t1], entry2[:, t0:t1]
        at1, at2 = row + (e1 & 0xFFF), row + (e2 & 0xFFF)
        id1, id2 = flat.take(at1), flat.take(at2)
        where = place[:, t0:t1]
        own, width = begin0.take(where), width0.take(where)
        new = np.flatnonzero(epoch[:, t0:t1] >= k)  # none before t0
        of, fresh = new // (t1 - t0), ids.reshape(-1).take(new)
        scale = share.take(of)
        own.reshape(-1)[new] = base.take(of) + scale * _CUM.take(fresh)
        width.reshape(-1)[new] = scale * _UNITS.take(fresh)
        begin_at[:, :t0], begin_at[:, t0:t1] = begin0.take(place[:, :t0]), own
        state = lane32 + ((e2 >> 12 << 2) | (e1 >> 12)) + 16 * (id1 == id2)
        w = weight.take(state)
        w2, w1, w0 = w << np.uint32(24), (w >> np.uint32(8)) << np.uint32(24), w >> np.uint32(16)
        hit2, hit1 = id2 == ids, id1 == ids
        begins[:, t0:t1] = w2 * (begin_at.reshape(-1).take(at2) < own) + w1 * (begin_at.reshape(-1).take(at1) < own) + w0 * own
        widths[:, t0:t1] = w2 * hit2 + w1 * hit1 + w0 * width
        if t1 < steps:
            kind = np.where(hit2 & (e2 > 0), 0, np.where(hit1 & (e1 > 0), 1, 2))
            weigh += 2 * np.bincount((state * 3 + kind).reshape(-1), minlength=weigh.size).reshape(weigh.shape).astype(np.int32) * (_COUNTS > 0)
    return begins, widths


def _encode_group(x: np.ndarray, last: int) -> list[np.ndarray]:
    """Words of each block; x is [lanes, steps] uint16, and the last lane has only ``last`` ids."""
    lanes, steps = x.shape
    begins, widths = np.empty((steps, lanes), np.uint32), np.empty((steps, lanes), np.uint32)
    for i in range(0, lanes, CHUNK):  # what is at work fits into the processor's cache
        begin, width = _intervals(x[i : i + CHUNK])
        begins[:, i : i + CHUNK], widths[:, i : i + CHUNK] = begin.T, width.T
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    # What each step does to the words: a carry into those written, and two words at most, as an interval has 2^-32 or more.
    carry, wrote, tops = np.zeros((steps, lanes), bool), np.zeros((2, steps, lanes), bool), np.empty((2, steps, lanes), np.uint16)
    for t in range(steps):
        a = lanes if t < last else lanes - 1
        if not a:
            break
        now, r = low[:a], rng[:a]
        r >>= _32
        add = r * begins[t, :a]
        now += add
        np.less(now, add, out=carry[t, :a])
        r *= widths[t, :a]
        short = np.less(r, _TOP, out=wrote[0, t, :a])
        tops[0, t, :a] = now >> _48
        by = short.astype(np.uint64)
        by <<= np.uint64(4)
        now <<= by
        r <<= by
        again = (r < _TOP).nonzero()[0]
        if again.size:
            rest = now.take(again)
            wrote[1, t, again], tops[1, t, again] = True, rest >> _48
            now[again], r[again] = rest << _16, r.take(again) << _16
    del begins, widths
    words: list[np.ndarray] = []
    for i in range(0, lanes, CHUNK):
        n = min(CHUNK, lanes - i)
        kept, of = np.ones((n, 2 * steps + 4), bool), np.empty((n, 2 * steps + 4), np.uint16)
        for k in (0, 1):
            kept[:, k : 2 * steps : 2], of[:, k : 2 * steps : 2] = wrote[k, :, i : i + n].T, tops[k, :, i : i + n].T
        of[:, 2 * steps :] = low[i : i + n, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)
        total = np.cumsum(kept.reshape(-1), dtype=np.int32)
        lane, step = np.nonzero(carry[:, i : i + n].T)
        first = lane * (2 * steps + 4) + 2 * step
        out = of[kept].astype(np.uint32)
        out += np.bincount(total[first] - kept.reshape(-1)[first] - 1, minlength=len(out)).astype(np.uint32)
        while (over := np.flatnonzero(out > 0xFFFF)).size:
            out[over] &= np.uint32(0xFFFF)
            out[over - 1] += np.uint32(1)
        words += np.split(out.astype(np.uint16), total[2 * steps + 3 :: 2 * steps + 4][:-1])
    return words


class _Search:
    """Order 0 of all lanes of a decoder: finds the id at a place of a lane's range.

    An id in it is one number: begin from bit 40, width from bit 16 and the id; so one id has one number between renewals,
    and numbers of different ids are ordered as their begins."""

    def __init__(self, steps: int, lanes: int):
        self.lanes, self.most = lanes, 0
        self.counts, self.ids, self.sizes = np.zeros((lanes, steps), np.uint16), np.zeros((lanes, steps), np.uint16), np.zeros(lanes, np.int64)
        self.index = np.full((steps, lanes), _NEW, np.uint16)  # the entry of the id at each step
        self.part, self.packed = np.zeros(lanes * PARTS, np.uint16), np.zeros(lanes, np.uint64)
        self._scale(np.full(lanes, SHARES))

    def _scale(self, share: np.ndarray) -> None:
        self.share, self.base = share, (PARTS - SHARES * share) << 12
        self.share32, self.base32 = share.astype(np.uint32), self.base.astype(np.uint32)
        self.share64, self.base64 = share.astype(np.uint64), self.base.astype(np.uint64) << _40

    def renew(self, info: np.ndarray, s0: int) -> None:
        """Take in the numbers ``info`` [steps, lanes] from step ``s0``; writes them anew by the entries of all steps."""
        seen, lanes = info.shape
        index, lane = self.index[:seen], np.arange(lanes)
        for i in range(s0 if s0 else seen, seen, 64):
            index[i : i + 64] = self.part.take((lane << 12) + (info[i : i + 64] >> np.uint64(52)).view(np.int64))
        unknown, added = self.most if s0 else _NEW, np.zeros(lanes, np.int64)
        for i in range(0, lanes, 4 * CHUNK):  # new ids in order of lane, id and step
            n = min(4 * CHUNK, lanes - i)
            step, own = np.nonzero(index[s0:, i : i + n] == unknown)
            key = (own << 32 | (info[s0 + step, i + own] & _ID).view(np.int64) << 16 | step).view(np.uint64)
            key.sort()
            cut = np.ones(len(key), bool)
            np.not_equal(key[1:] >> _16, key[:-1] >> _16, out=cut[1:])
            found = key[cut]
            own = (found >> _32).view(np.int64)
            many = np.bincount(own, minlength=n)
            own += i
            entry = np.arange(len(found)) - np.repeat(np.cumsum(many) - many, many) + self.sizes[own]
            self.ids[own, entry] = (found >> _16).astype(np.uint16)
            at = ((key & _ID) * np.uint64(lanes) + (key >> _32)).view(np.int64) + (s0 * lanes + i)
            index.reshape(-1)[at] = entry.take(np.cumsum(cut) - 1)
            added[i : i + n] = many
        self.sizes += added
        self.most = most = int(self.sizes.max())
        wide = most + 1
        self.packed = np.empty((lanes, wide), np.uint64)
        self._scale(_share(added, seen - s0, seen))
        name = np.tile(np.arange(wide, dtype=np.uint16), CHUNK)
        for i in range(0, lanes, CHUNK):
            n = min(CHUNK, lanes - i)
            counts, ids, packed = self.counts[i : i + n, :most], self.ids[i : i + n, :most], self.packed[i : i + n]
            counts += np.bincount((np.arange(n) * most + index[s0:, i : i + n]).reshape(-1), minlength=n * most).reshape(n, most).astype(np.uint16)
            begin, width = _order0(counts, seen, self.share[i : i + n])
            packed[:, :most] = begin.astype(np.uint64) << np.uint64(52) | width.astype(np.uint64) << np.uint64(28) | ids
            packed[:, most] = 0  # one entry more, behind all others, stands for new ids
            every = np.concatenate([width, SHARES * self.share[i : i + n, None]], axis=1)
            self.part[i * PARTS : (i + n) * PARTS] = np.repeat(name[: n * wide], every.reshape(-1))
        self.packed, at = self.packed.reshape(-1), lane * wide
        for i in range(0, seen, 64):
            info[i : i + 64] = self.packed.take(at + index[i : i + 64])

    def find(self, lane: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Numbers of the ids whose intervals hold ``want`` (int64)."""
        if self.most:
            at = lane << 12
            at += want >> 12
            entry = self.part.take(at)
            np.multiply(lane, self.most + 1, out=at)
            at += entry
            got = self.packed.take(at)
            gap = (entry == self.most).nonzero()[0]
            if not gap.size:
                return got
            lane, want = lane.take(gap), want.take(gap)
        want = want.astype(np.uint32)
        want -= self.base32.take(lane)
        want //= self.share32.take(lane)
        new = _FIND.take(want)
        fresh = _SPAN.take(new)
        fresh *= self.share64.take(lane)
        fresh += self.base64.take(lane)
        fresh |= new
        if not self.most:
            return fresh
        got[gap] = fresh
        return got


def _decode_group(words: list[np.ndarray], steps: int, last: int) -> np.ndarray:
    lanes = len(words)
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate([*words, np.zeros(4, np.uint16)]).astype(np.uint16)
    pos = np.cumsum(sizes) - sizes
    value = np.zeros(lanes, np.uint64)
    for k in range(4):
        value = (value << _16) | flat[pos + k]
    pos += 4
    rng = np.full(lanes, (1 << 64) - 1, np.uint64)
    # Rows of what follows: order 2 and order 1.  A table's entry is the place of a step in info, and its confidence from bit 30.
    slot0 = (np.arange(2 * lanes, dtype=np.int64) << SLOT_BITS).reshape(2, lanes)
    table = np.tile(np.repeat(np.arange(lanes, dtype=np.uint32), 1 << SLOT_BITS), 2)
    info, search = np.zeros((steps, lanes), np.uint64), _Search(steps, lanes)
    known, counts = info.reshape(-1), np.tile(_COUNTS, (lanes, 1, 1))
    lane, lane32 = np.arange(lanes), (np.arange(lanes) * 32).astype(np.uint32)
    context, before = np.zeros((2, lanes), np.uint64), np.zeros(lanes, np.uint64)
    levels, parts, top = np.array([[28], [30]], np.uint32), np.array([[0], [8]], np.uint64), np.uint32(3 << 30)
    here = np.arange(1 << 30, (1 << 30) + lanes, dtype=np.uint32)  # an entry for this step
    slot_shift, hash1, hash2 = np.uint64(64 - SLOT_BITS), np.uint64(int(_HASH[0]) << 32), np.uint64(int(_HASH[1]) << 32)
    place, level1, agreeing, most = np.uint32((1 << 28) - 1), np.uint32(1 << 30), np.uint8(4), np.uint64((1 << 32) - 1)
    one, high, low9, low24 = np.uint8(1), np.uint64(0xFF << 24), np.uint64(0x1FF), np.uint64(MASS - 1)
    epochs = _epochs(steps)
    for k, (t0, t1) in enumerate(epochs):
        w = _weights(counts)  # now order 2 from bit 24, order 1 from bit 16, order 0 below
        weight = (w & np.uint32(0xFF)) << np.uint32(24) | (w & np.uint32(0xFF00)) << np.uint32(8) | w >> np.uint32(16)
        if k:
            search.renew(info[:t0], epochs[k - 1][0])
        taken = np.full((t1 - t0, lanes), counts.size, np.uint32)
        for t in range(t0, t1):
            a = lanes if t < last else lanes - 1
            if not a:
                break
            slot = (context[:, :a] >> slot_shift).view(np.int64)
            slot += slot0[:, :a]
            entry = table.take(slot)
            i = known.take(entry & place)
            state = entry >> levels
            state = state[0] | state[1]
            state |= (i[0] == i[1]).view(np.uint8) << agreeing
            state += lane32[:a]
            p = weight.take(state).astype(np.uint64)
            w0 = p & low9
            w = p << parts
            w &= high
            begin = i >> _40
            begin *= w0
            behind = w[::-1] * (i[::-1] < i)
            begin += behind
            width = i >> _16
            width &= low24
            width *= w0
            width += w
            r = rng[:a]
            r >>= _32
            target = value[:a] // r
            np.minimum(target, most, out=target)
            hit = (target - begin) < width
            live = entry >= level1
            two = hit[0]
            two &= live[0]
            own = (two | hit[1]).__invert__().nonzero()[0]
            if own.size:
                beyond = w * (begin <= target)
                beyond = beyond[0] + beyond[1]
                scale, over, want = w0.take(own), beyond.take(own), target.take(own)
                want -= over
                want //= scale
                got = search.find(own, want.view(np.int64))
                mine, wide = got >> _40, got >> _16
                mine *= scale
                mine += over
                wide &= low24
                wide *= scale
            begins, widths, now = np.where(two, begin[0], begin[1]), np.where(two, width[0], width[1]), np.where(two, i[0], i[1])
            if own.size:
                begins[own], widths[own], now[own] = mine, wide, got
            info[t, :a] = now
            c = value[:a]
            begins *= r
            c -= begins
            r *= widths
            short = r < _TOP
            by = short.astype(np.uint64)
            by <<= np.uint64(4)
            c <<= by
            r <<= by
            at = pos[:a]
            c |= flat.take(at) * short
            at += short
            again = (r < _TOP).nonzero()[0]
            while again.size:
                p = pos.take(again)
                c[again] = (c.take(again) << _16) | flat.take(p)
                pos[again] = p + 1
                small = r.take(again) << _16
                r[again] = small
                again = again.compress(small < _TOP)
            same = i == now
            same &= live
            # A hit's confidence goes up by one, to 3; any other's is 1.
            raised = entry & top
            np.minimum(raised, np.uint32(2 << 30), out=raised)
            raised *= same
            raised += here[:a]
            here += np.uint32(lanes)
            table[slot] = raised
            kind = same.view(np.uint8)
            state *= np.uint32(3)
            state += (kind[0] ^ one) * ((kind[1] ^ one) + one)
            taken[t - t0, :a] = state
            now = now & _ID
            np.multiply(now, hash1, out=context[1, :a])
            np.add(context[1, :a], before[:a] * hash2, out=context[0, :a])
            before = now
        if t1 < steps:
            counts += 2 * np.bincount(taken.reshape(-1), minlength=counts.size + 1)[:-1].reshape(counts.shape).astype(np.int32) * (_COUNTS > 0)
    return info.T.astype(np.uint16)


def encode(ids: np.ndarray, block: int = BLOCK, group: int = GROUP) -> bytes:
    """Coded blocks of uint16 ids, one after the other; a block has at most 4,096 ids."""
    ids, parts = np.ascontiguousarray(ids, np.uint16), []
    for i in range(0, len(ids), block * group):
        own = ids[i : i + block * group]
        lanes = -(-len(own) // block)
        x = np.zeros(lanes * block, np.uint16)
        x[: len(own)] = own
        x = x.reshape(lanes, block)
        last = len(own) - (lanes - 1) * block
        if lanes == 1:
            x = x[:, :last]
        for k, words in enumerate(_encode_group(x, last)):
            raw = own[k * block : (k + 1) * block]
            parts += [_HEAD.pack(_MAGIC, len(raw), len(words), zlib.crc32(raw.astype("<u2").tobytes())), words.astype("<u2").tobytes()]
    return b"".join(parts)


def blocks(data: bytes) -> list[tuple[int, int, int, int]]:
    """(number of ids, number of words, checksum, offset of the words) of every block."""
    out, at = [], 0
    while at < len(data):
        magic, n, words, crc = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError(f"no block at byte {at}")
        out.append((n, words, crc, at + _HEAD.size))
        at += _HEAD.size + 2 * words
    return out


def decode(data: bytes, group: int = GROUP) -> np.ndarray:
    """The ids of all blocks; raises ValueError where a checksum fails."""
    table, parts = blocks(data), []
    i = 0
    while i < len(table):
        j = i + 1
        while j < len(table) and j - i < group and table[j - 1][0] == table[i][0] and table[j][0] <= table[i][0]:
            j += 1
        words = [np.frombuffer(data, "<u2", w, p) for _, w, _, p in table[i:j]]
        x = _decode_group(words, table[i][0], table[j - 1][0])
        for k in range(j - i):
            n, _, crc, p = table[i + k]
            own = np.ascontiguousarray(x[k, :n])
            if zlib.crc32(own.astype("<u2").tobytes()) != crc:
                raise ValueError(f"checksum of the block at byte {p} fails")
            parts.append(own)
        i = j
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)
