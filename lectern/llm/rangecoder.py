"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block starts with its sorted distinct ids; what is coded is each id's rank
among them. Three orders predict it. Order 2 and order 1 keep, for each context
of the last two ranks and of the last one, the rank seen last and a confidence.
Integer logistic mixing of adaptive bit models, one for each order, gives the
probability that order 2's candidate is right; it is corrected by what has been
counted for the same confidences. If that candidate is wrong, order 1's is
tried, and else order 0, an adaptive frequency table over all ranks, gives the
rank. Every step is one multi-symbol range coding.

A block's ids are cut into strands, consecutive stretches with a range coder's
state of their own, that advance in step and share the block's model: the ids
at one place of all strands are coded, then the model learns them. So blocks
are long enough to learn from, and a step is a few operations on arrays over
the strands of all blocks of a call. Each block starts from a fresh model and
can be decoded alone. Probabilities are integers; the coder's ranges are whole
numbers below 2**53 in doubles, which are exact, so that any machine decodes
what another has encoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 19
STRANDS = 1024
#: Ids of a strand below which a block has fewer strands.
LEAST = 256
#: Strands that advance together; more at a time would leave the processor's cache.
LANES = 8192
#: Steps between refreshes of the candidates' probabilities, after the first as many.
REFRESH = 16
#: A miss keeps this share of 65536, so that ranges stay wide enough for order 0.
REST = 1024
PRIOR = 16

#: Place p of a strand from which order 0's table is made anew: each about a third further.
REBUILD = frozenset(round(1.33**k) for k in range(1, 60))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Integer logistic tables: squash by interpolation between fixed points, stretch as its inverse."""
    # 4096 / (1 + exp(-k / 2)) for k from -16 to 16.
    knots = [1, 2, 4, 6, 10, 17, 27, 45, 74, 120, 194, 310, 488, 747, 1101, 1546, 2048, 2550, 2995, 3349, 3608, 3786, 3902, 3976, 4022, 4051, 4069, 4079, 4086, 4090, 4092, 4094, 4095]
    d = np.arange(-2048, 2048)
    k, w = (d + 2048) >> 7, (d + 2048) & 127
    knots = np.array(knots)
    squash = np.clip((knots[k] * (128 - w) + knots[np.minimum(k + 1, 32)] * w + 64) >> 7, 1, 4095)
    stretch = np.minimum(np.searchsorted(squash, np.arange(4096), side="left"), 4095) - 2048
    return squash.astype(np.int64), stretch.astype(np.int64)


SQUASH, STRETCH = _tables()

#: Cells of the candidates' statistics: confidence in order 2, in order 1, and whether both name one rank.
_K2, _K1, _SAME = (x.reshape(-1) for x in np.meshgrid(np.arange(8), np.arange(8), np.arange(2), indexing="ij"))
CELLS = len(_K2)
#: An entry holds its rank above three bits of confidence: change by a miss and by a hit.
_STEP = np.array([0, 0, -1, -1, -2, -2, -3, -3, 1, 1, 1, 1, 1, 1, 1, 0], dtype=np.int32)
EMPTY = np.int32(-8)

#: Ranges start at STATE; one below LOW is widened by a word of 24 bits. A word's bit 24 is a carry.
STATE, LOW, WORD = 2.0**52, 2.0**28, 2.0**24
WHOLE = 65536.0


def shape(n: int) -> tuple[int, int]:
    """(strands, steps) of a block of n ids."""
    strands = min(STRANDS, max(1, n // LEAST))
    return strands, -(-n // strands)


class _Model:
    """What the predictors know of some blocks; lanes are the blocks' strands in order of block."""

    def __init__(self, strands: list[int], distinct: list[int], ids: list[int]):
        self.blocks, self.distinct = len(strands), distinct
        self.lanes = np.cumsum([0, *strands])
        of = np.repeat(np.arange(self.blocks), strands)
        #: Order 0 has shares of 1 << bits, sixteen or so for each rank.
        self.bits = [min(20, max(12, d.bit_length() + 4)) for d in distinct]
        self.first = np.cumsum([0, *distinct])
        self.base1 = self.first[of]
        slots = [1 << min(16, max(8, (n - 1).bit_length() - 2)) for n in ids]
        self.base2, self.mask2 = np.cumsum([0, *slots])[of], np.array(slots)[of] - 1
        self.t1, self.t2 = np.full(self.first[-1], EMPTY, np.int32), np.full(sum(slots), EMPTY, np.int32)
        self.base_cell = (of * CELLS * 4).astype(np.int32)
        self.a, self.b = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        self.counts = np.zeros((self.blocks, CELLS, 3), np.int64)
        self.weights = np.tile(np.array([26000, 16000, 8000]), (self.blocks, 1))
        self.seen: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.missed: list[np.ndarray] = []
        self.tally = [np.zeros(d, np.int64) for d in distinct]
        self.start, self.freq = np.zeros(self.first[-1]), np.zeros(self.first[-1])
        self.scale = np.array([2.0**-b for b in self.bits])[of]
        self.slot_base = np.cumsum([0, *[1 << b for b in self.bits]])
        self.slot_of, self.slots = self.slot_base[of], None
        self.i1 = self.a + self.base1
        self._mix()

    def narrow(self, blocks: int) -> int:
        """Go on with the first blocks alone."""
        self.blocks = blocks
        n = int(self.lanes[blocks])
        # no refresh here: what a block learns and when must not hang on its neighbours
        self.seen, self.ranks, self.missed = ([x[:n] for x in kept] for kept in (self.seen, self.ranks, self.missed))
        for k in ("base1", "base2", "mask2", "base_cell", "a", "b", "i1", "scale", "slot_of"):
            setattr(self, k, getattr(self, k)[:n])
        return n

    # order 2 and order 1

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates of orders 2 and 1, and the cells of their statistics, four places each."""
        self.i2 = ((self.a * 40503 + self.b) & self.mask2) + self.base2
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.k1, self.k2 = self.e1 & 7, self.e2 & 7
        c1, c2 = self.e1 >> 3, self.e2 >> 3
        cell = (self.k2 << 6) + (self.k1 << 3)
        cell += self.base_cell
        cell += (c1 == c2).view(np.int8) << 2
        return c2, c1, cell

    def update(self, x: np.ndarray, cell: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, miss: np.ndarray, t: int) -> None:
        """Learn the ranks of step t by their cells' places; hit1 tells whether order 1's candidate is right, whatever order 2's is."""
        new = (x << 3) + 1
        for table, i, e, k, hit in ((self.t2, self.i2, self.e2, self.k2, hit2), (self.t1, self.i1, self.e1, self.k1, hit1)):
            e += _STEP.take(k + (hit.view(np.int8) << 3))
            np.putmask(e, (k < 2) & ~hit, new)
            table[i] = e
        self.seen.append(cell)
        self.ranks.append(x)
        self.missed.append(miss)
        self.b = self.a
        self.a = x.astype(np.int64)
        self.i1 = self.a + self.base1
        if t < REFRESH or t % REFRESH == 0:
            self._learn()
            self._mix()
        if t + 1 in REBUILD:
            self._tally()
            self.rebuild()

    def _learn(self) -> None:
        if self.seen:
            n = np.bincount(np.concatenate(self.seen), minlength=self.blocks * CELLS * 4)
            self.recent = n.reshape(-1, CELLS, 4)[: self.blocks, :, :3]
            self.counts[: self.blocks] += self.recent
            self.seen.clear()
            self._train()

    def _stretched(self) -> tuple[np.ndarray, ...]:
        """Adaptive bit models of the three orders for each cell, stretched."""
        tries, hits = self.counts[: self.blocks].sum(axis=2), self.counts[: self.blocks, :, 0]

        def rate(groups: np.ndarray, n: int) -> np.ndarray:
            by = np.eye(n, dtype=np.int64)[groups]
            return STRETCH[np.clip(((hits @ by) * 8192 + 4096) // ((tries @ by) * 2 + 2), 1, 4095)][:, groups]

        return rate(_K2, 8), rate(_K1 * 2 + _SAME, 16), rate(np.zeros(CELLS, np.int64), 1)

    def _mixed(self) -> np.ndarray:
        self.parts = self._stretched()
        dot = sum(s * w[:, None] for s, w in zip(self.parts, self.weights[: self.blocks].T, strict=True)) >> 16
        return SQUASH[np.clip(dot, -2048, 2047) + 2048]

    def _train(self) -> None:
        """Move the weights along the gradient of the code length of what came since the last refresh."""
        live = self.recent * (_K2 > 0)[None, :, None]
        err = live[:, :, 0] * 4096 - live.sum(axis=2) * self.mixed[: self.blocks]
        total = np.maximum(1, live.sum(axis=(1, 2)))
        for k, s in enumerate(self.parts):
            step = (s[: self.blocks] * err).sum(axis=1) // total // 64
            self.weights[: self.blocks, k] = np.clip(self.weights[: self.blocks, k] + np.clip(step, -4000, 4000), -100_000, 200_000)

    def _mix(self) -> None:
        """Shares of both candidates for each cell."""
        self.mixed = self._mixed()
        c = self.counts[: self.blocks]
        # Sixteenths of 65536 from the mix, corrected by the cell's own count.
        p = (self.mixed * 16 * PRIOR + c[:, :, 0] * 65536) // (c.sum(axis=2) + PRIOR)
        top = 65536 - REST
        two = np.where(_K2 > 0, np.clip(p, 16, top - 64), 0)
        q = ((c[:, :, 1] * 2 + 1) * 32768) // (c[:, :, 1] + c[:, :, 2] + 2)
        one = np.where((_K1 > 0) & ~((_SAME > 0) & (_K2 > 0)), np.maximum(16, (top - two) * np.minimum(q, 65000) >> 16), 0)
        #: By cell and place, which is 0 if order 2's candidate is right, 1 if order 1's is, and 2 if neither is.
        both, none = two + one, np.zeros_like(two)
        self.from_ = np.stack([none, two, both, none], axis=2).reshape(-1).astype(np.float64)
        self.share = np.stack([two, one, 65536 - both, none], axis=2).reshape(-1).astype(np.float64)

    # order 0

    def _tally(self) -> None:
        if self.missed:
            x, miss = np.stack(self.ranks), np.stack(self.missed)
            for k in range(self.blocks):
                own = slice(self.lanes[k], self.lanes[k + 1])
                self.tally[k] += np.bincount(x[:, own][miss[:, own]], minlength=self.distinct[k])
            self.ranks.clear()
            self.missed.clear()

    def rebuild(self) -> None:
        """Order 0's shares from the ranks that it had to code: one for each rank, the others in proportion."""
        for k in range(self.blocks):
            d, n = self.distinct[k], self.tally[k]
            free = (1 << self.bits[k]) - d
            freq = 1 + (n * 16 + 1) * free // int((n * 16 + 1).sum())
            freq[int(n.argmax())] += (1 << self.bits[k]) - int(freq.sum())
            own = slice(self.first[k], self.first[k + 1])
            self.freq[own] = freq
            self.start[own] = np.cumsum(freq) - freq
            if self.slots is not None:
                self.slots[self.slot_base[k] : self.slot_base[k + 1]] = np.repeat(np.arange(d, dtype=np.int32), freq)


def _ranked(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order, rank of each id)."""
    most = int(block.max())
    if most < max(1 << 16, 4 * len(block)):
        present = np.zeros(most + 1, bool)
        present[block] = True
        ids = np.flatnonzero(present)
        return ids.astype("<u4"), (np.cumsum(present, dtype=np.int32) - 1)[block]
    ids, ranks = np.unique(block, return_inverse=True)
    return ids.astype("<u4"), ranks.astype(np.int32)


def _groups(lengths: list[int]) -> list[list[int]]:
    """Blocks that are coded together, each group in order of falling steps."""
    order = sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: -shape(lengths[k])[1])
    out: list[list[int]] = []
    size = LANES
    for k in order:
        n = shape(lengths[k])[0]
        if size + n > LANES:
            out.append([])
            size = 0
        out[-1].append(k)
        size += n
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids (below 2**32; at most BLOCK of them) coded on their own; an empty block gives no bytes."""
    if any(len(x) > BLOCK for x in blocks):
        raise ValueError(f"a block has at most {BLOCK} ids")
    out = [b""] * len(blocks)
    for own in _groups([len(x) for x in blocks]):
        for k, x in zip(own, _encode([blocks[k] for k in own]), strict=True):
            out[k] = x
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The blocks' steps must not increase."""
    shapes = [shape(len(b)) for b in blocks]
    ranked = [_ranked(b) for b in blocks]
    steps = [s for _, s in shapes]
    m = _Model([s for s, _ in shapes], [len(ids) for ids, _ in ranked], [len(b) for b in blocks])
    lanes = int(m.lanes[-1])
    grid = np.zeros((steps[0], lanes), np.int32)
    for k, ((strands, length), (_, ranks)) in enumerate(zip(shapes, ranked, strict=True)):
        own = np.zeros(strands * length, np.int32)
        own[: len(ranks)] = ranks
        grid[:length, m.lanes[k] : m.lanes[k + 1]] = own.reshape(strands, length).T
    m.rebuild()
    low, rng = np.zeros(lanes), np.full(lanes, STATE)
    words = np.zeros((steps[0] * 2 + 4) * lanes, np.uint32)  # at most 48 bits for an id
    at, ends = np.arange(lanes), np.zeros(lanes, np.int64)  # where a lane's next word goes, and its last one
    live = lanes
    for t in range(steps[0]):
        if steps[m.blocks - 1] <= t:
            n = m.narrow(sum(s > t for s in steps))
            _finish(words, low[n:], at[n:], lanes)
            ends[n:live] = at[n:]
            low, rng, at, live = low[:n], rng[:n], at[:n], n
        x = grid[t, :live]
        c2, c1, cell = m.predict()
        hit2, hit1 = x == c2, x == c1
        miss = ~(hit2 | hit1)
        cell += miss.view(np.int8)
        cell += (~hit2).view(np.int8)
        r = np.floor(rng * (1 / WHOLE))
        low += r * m.from_.take(cell)
        rng = r * m.share.take(cell)
        rank = x + m.base1
        r = np.floor(rng * m.scale)
        low += r * m.start.take(rank) * miss
        np.putmask(rng, miss, r * m.freq.take(rank))
        while (narrow := np.flatnonzero(rng < LOW)).size:
            own, to = low[narrow], at[narrow]
            w = np.floor(own * (1 / LOW))
            words[to] = w.astype(np.uint32)
            low[narrow] = (own - w * LOW) * WORD
            rng[narrow] *= WORD
            at[narrow] = to + lanes
        m.update(x, cell, hit2, hit1, miss, t)
    _finish(words, low, at, lanes)
    ends[:live] = at
    counts = ends // lanes + 1
    table = words.reshape(-1, lanes)[: int(counts.max())]
    for p in range(len(table) - 1, 0, -1):
        table[p - 1] += table[p] >> 24
    columns = np.ascontiguousarray(table.T, "<u4").view(np.uint8).reshape(lanes, -1, 4)[:, :, :3]
    kept = np.arange(len(table))[None, :] < counts[:, None]
    out = []
    for k, (ids, _) in enumerate(ranked):
        own = slice(m.lanes[k], m.lanes[k + 1])
        gaps = zlib.compress(np.diff(ids, prepend=np.uint32(0)).astype("<u4").tobytes())
        out.append(struct.pack("<2I", len(ids), len(gaps)) + gaps + counts[own].astype("<u2").tobytes() + columns[own][kept[own]].tobytes())
    return out


def _finish(words: np.ndarray, low: np.ndarray, at: np.ndarray, lanes: int) -> None:
    """A last word: the range holds a multiple of LOW, and what follows reads as zeros."""
    words[at] = np.ceil(low * (1 / LOW))


def decode_blocks(blocks: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids (uint32) of each block; lengths: ids in each."""
    parts: list[np.ndarray] = [np.empty(0, "<u4")] * len(blocks)
    for own in _groups(lengths):
        for k, x in zip(own, _decode([blocks[k] for k in own], [lengths[k] for k in own]), strict=True):
            parts[k] = x
    return parts


def _parsed(block: bytes, strands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, words of each strand, all words)."""
    distinct, size = struct.unpack_from("<2I", block)
    ids = np.cumsum(np.frombuffer(zlib.decompress(block[8 : 8 + size]), "<u4", distinct), dtype="<u4")
    counts = np.frombuffer(block, "<u2", strands, 8 + size)
    raw = np.frombuffer(block, np.uint8, 3 * int(counts.sum()), 8 + size + 2 * strands).reshape(-1, 3)
    return ids, counts, raw @ np.array([1.0, 2.0**8, 2.0**16])


def _decode(blocks: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The blocks' steps must not increase."""
    shapes = [shape(n) for n in lengths]
    steps = [s for _, s in shapes]
    parsed = [_parsed(b, s) for b, (s, _) in zip(blocks, shapes, strict=True)]
    m = _Model([s for s, _ in shapes], [len(ids) for ids, _, _ in parsed], lengths)
    m.slots = np.zeros(m.slot_base[-1], np.int32)
    m.rebuild()
    lanes = int(m.lanes[-1])
    counts = np.concatenate([c for _, c, _ in parsed])
    width = int(counts.max()) + 4
    table = np.zeros((lanes, width))
    table[np.arange(width)[None, :] < counts[:, None]] = np.concatenate([w for _, _, w in parsed])
    words = np.ascontiguousarray(table.T).reshape(-1)
    del table
    # A state has 52 bits: two words of 24 and the first four bits of the third, of which 20 stay for the next.
    code = words[:lanes] * LOW + words[lanes : 2 * lanes] * 16.0 + np.floor(words[2 * lanes : 3 * lanes] * 2.0**-20)
    rng = np.full(lanes, STATE)
    at, last = np.arange(lanes) + 2 * lanes, len(words) - 1
    grid = np.zeros((steps[0], lanes), np.int32)
    top = 1.0 / m.scale - 1
    live = lanes
    for t in range(steps[0]):
        if steps[m.blocks - 1] <= t:
            live = m.narrow(sum(s > t for s in steps))
            code, rng, at, top = code[:live], rng[:live], at[:live], top[:live]
        c2, c1, cell = m.predict()
        r = np.floor(rng * (1 / WHOLE))
        hit2 = code < r * m.share.take(cell)
        miss = code >= r * m.from_.take(cell + 2)
        cell += miss.view(np.int8)
        cell += (~hit2).view(np.int8)
        code -= r * m.from_.take(cell)
        rng = r * m.share.take(cell)
        x = c1
        hit1 = c1 == c2
        np.putmask(x, hit2, c2)
        r = np.floor(rng * m.scale)
        share = np.minimum(np.floor(code / r), top)  # more only in a corrupt block
        found = m.slots.take(share.astype(np.int64) + m.slot_of)
        hit1 = (hit2 & hit1) | ~(hit2 | miss)
        np.putmask(x, miss, found)
        rank = found + m.base1
        code -= r * m.start.take(rank) * miss
        np.putmask(rng, miss, r * m.freq.take(rank))
        while (narrow := np.flatnonzero(rng < LOW)).size:
            to = at[narrow]
            a, z = words[np.minimum(to, last)], words[np.minimum(to + lanes, last)]
            code[narrow] = code[narrow] * WORD + (a % 2.0**20) * 16.0 + np.floor(z * 2.0**-20)
            rng[narrow] *= WORD
            at[narrow] = to + lanes
        grid[t, :live] = x
        m.update(grid[t, :live], cell, hit2, hit1, miss, t)
    out = []
    for k, (ids, _, _) in enumerate(parsed):
        ranks = grid[: steps[k], m.lanes[k] : m.lanes[k + 1]].T.reshape(-1)[: lengths[k]]
        out.append(ids[ranks])
    return out
