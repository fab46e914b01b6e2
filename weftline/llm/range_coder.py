"""An adaptive context-mixing range coder for blocks of ids, many blocks in step.

Every block starts from the same state and is a lane of the arrays here, so that one numpy operation takes
a step in all blocks. An id is coded in up to three parts:

1. whether it is the candidate: what last followed the same two ids (order 2), else the same id (order 1).
   Its probability mixes, by weights that learn, what each of the orders 2, 1 and 0 says of the candidate;
2. if not, its slot among 256 that hold ids seen before (order 0), or the escape, by frequencies that adapt;
3. after the escape, the id itself.

What follows an id or two is learned at every step, and so is the probability of a hit in each state; the weights
of the mixture and the slots' frequencies come into force at the steps REFRESH, for all lanes at once. All arithmetic is on integers, so that any machine decodes what any other encoded.
"""

from __future__ import annotations

from functools import partial

import numpy as np

#: Entries of a lane's tables for order 1 and order 2: id << 3 | CODES, 0 for none. Ids are counted from 1 in all tables.
ENTRIES = 1 << 9
#: What an entry says of itself: in order 1, 4 if it was right the last time; in order 2, 1 for being there and 1 more if right.
RIGHT, THERE = np.array([[4], [1]], np.int32), np.array([[0], [1]], np.int32)
#: The entry of order 2 is that of the last id, moved by this times that of the id before.
APART = 181
SLOTS = 256
#: Symbols after the slots: the escape, and the one without width that stands for a hit.
ESCAPE, HIT = SLOTS, SLOTS + 1
SYMBOLS = SLOTS + 2
#: Steps at which what was counted comes into force, and every EVERY after the last.
REFRESH, EVERY = frozenset((32, 64, 128)), 256
#: Scales: of a hit's probability, and of the slots' frequencies, in bits.
P_BITS, F_BITS = 16, 12
ONE, FULL = 1 << P_BITS, 1 << F_BITS
LEAST = 64
#: A state's probability moves by this part (a power of two) of what it missed, at every step that meets the state.
RATE = np.uint16(5)
#: What a hit adds: a probability stays between 31 and ONE - 32, so neither part of a width is ever empty.
GAIN = np.uint16((ONE >> 5) - 1)
#: Lanes whose counts come into force at once, and steps whose places are found at once: few, so that they stay near the processor.
TURN, AHEAD = 128, 16
#: A lane's width is between 2 to the 31 and 2 to the 63 before each id; it gives 32 bits at a time, after the symbol and the
#: escape. Between, the first part leaves 2 to the 20 at least, and the symbol 2 to the 8.
SMALL, WORD, REST = np.uint64(1 << 31), np.uint64(32), np.uint64(31)
LOW = np.uint64((1 << 31) - 1)
#: Shifts of a width for its two scales, and the parts of a packed frequency.
S_ESCAPE, S_HIT = np.int16(ESCAPE), np.int16(HIT)
P_SHIFT, F_SHIFT, FIRST, OWN, NONE = np.uint64(P_BITS), np.uint64(F_BITS), np.uint64(16), np.uint64(0xFFFF), np.uint64(0)

_STRETCH = np.array([int(round(256 * np.log((i + 0.5) / (256 - i - 0.5)))) for i in range(256)], np.int64)  # of p >> 8
_SQUASH = np.array([int(round(ONE / (1 + np.exp(-(i - 2047) / 256)))) for i in range(4095)], np.int64)


class _Model:
    """The state of all lanes, and its steps."""

    def __init__(self, lanes: int, inverse: bool):
        self.lanes, self.inverse = lanes, inverse
        lane = np.arange(lanes)
        self.slots, self.states, self.symbols = lane * SLOTS, lane * 64, lane * SYMBOLS
        self.base = np.stack([lane * ENTRIES, (lanes + lane) * ENTRIES])
        self.table = np.zeros(2 * lanes * ENTRIES, np.int32)
        self.slot = np.zeros(lanes * SLOTS, np.int32)
        self.hits, self.tries = np.full((3, 4, lanes), 1, np.int64), np.full((3, 4, lanes), 8, np.int64)
        self.bent, self.p = np.zeros((3, 4, lanes), np.int64), np.zeros((64, lanes), np.int32)
        self.chance, self.often = np.zeros(lanes * 64, np.uint16), np.zeros(lanes * SLOTS, np.int8)
        self.weight = np.full((3, lanes), 24000, np.int64)
        self.count = np.zeros((lanes, SYMBOLS), np.int64)
        self.count[:, ESCAPE] = 4
        self.packed = np.zeros((lanes, SYMBOLS), np.uint32)  # first << 16 | width
        self.packed[:, HIT] = FULL
        self.flat = self.packed.reshape(-1)
        if inverse:
            self.tiled = np.tile(np.arange(HIT).astype(np.uint8), min(lanes, TURN))
            self.at, self.edge = np.zeros(lanes * FULL, np.uint8), np.zeros(lanes, np.int32)
        self.said = np.zeros((EVERY, lanes), np.int16)  # symbols
        self.was = np.zeros((EVERY, lanes), np.int16)  # states
        self.rows = 0
        self.refresh(lanes)

    def refresh(self, m: int) -> None:
        for a in range(0, m, TURN):
            self.refresh_lanes(a, min(a + TURN, self.lanes))
        self.rows = 0

    def refresh_lanes(self, a: int, b: int) -> None:
        lanes, bent, count = b - a, self.bent[..., a:b], self.count[a:b]
        if self.rows:
            said, was = self.said[: self.rows, a:b], self.was[: self.rows, a:b]
            count += np.bincount((said + self.symbols[:lanes]).ravel(), minlength=lanes * SYMBOLS).reshape(lanes, SYMBOLS)
            met = (said == HIT).view(np.int8) * np.int16(64)
            met += was
            both = np.bincount((met + self.states[:lanes] * 2).ravel(), minlength=lanes * 128).reshape(lanes, 128).T.astype(np.int32, order="C")
            hits, tries = both[64:], both[:64] + both[64:]
            error = hits * ONE - tries * self.p[:, a:b]  # below 2 to the 25, and so are sums of it
            total = np.maximum(1, tries.sum(0)) * 64
            for k, (e, h, t) in enumerate(_by_order(np.stack([error, hits, tries]))):
                self.weight[k, a:b] += np.clip((e * bent[k]).sum(0) // total, -16000, 16000)
                self.hits[k, :, a:b] += h
                self.tries[k, :, a:b] += t
        # the mixed probability of each state: a row is a state, of order 0, order 1, order 2
        bent[:] = _STRETCH[self.hits[..., a:b] * 255 // self.tries[..., a:b]]
        two, one, none = self.weight[:, None, a:b] * bent
        dot = (none[:, None, None] + one[:, None] + two).reshape(64, lanes)
        dot >>= 16
        np.clip(dot, -2047, 2047, out=dot)
        dot += 2047
        self.p[:, a:b] = p = np.clip(_SQUASH.take(dot, mode="clip"), LEAST, ONE - LEAST)
        self.chance.reshape(-1, 64)[a:b] = p.T
        # frequencies of slots and escape: none is zero, and they add up to FULL
        count = count[:, :HIT]
        own = (count * ((FULL - HIT) / count.sum(1, keepdims=True))).astype(np.int32)  # the same doubles on any machine
        own += 1
        own[:, ESCAPE] += FULL - own.sum(1, dtype=np.int32)
        first = np.cumsum(own[:, :-1], axis=1, dtype=np.int32)
        if self.inverse:  # the slot of each place, and where the escape begins
            self.at[a * FULL : b * FULL] = np.repeat(self.tiled[: lanes * HIT], own.ravel())
            self.edge[a:b] = first[:, -1]
        first <<= 16
        packed = self.packed[a:b]
        packed[:, :HIT] = own
        packed[:, 1:HIT] += first.view(np.uint32)
        self.often.reshape(-1, SLOTS)[a:b] = _GRADE.take(count[:, :SLOTS], mode="clip")

    def predict(self, at: np.ndarray, m: int) -> None:
        """For the first m lanes, from where the tables' entries are: the candidate, and the scaled probability that the id is it."""
        e = self.table.take(at, mode="clip")
        i = self.i = e >> 3
        e &= 7
        state = e[0] + e[1]
        cand = self.cand = np.where(i[1], i[1], i[0])
        state += (i[0] == cand).view(np.int8) << 3
        o = (cand & (SLOTS - 1)) + self.slots[:m]
        was = self.was[self.rows, :m]
        np.add(state, self.often.take(o, mode="clip"), out=was, casting="unsafe")
        self.spot = was + self.states[:m]
        self.now = self.chance.take(self.spot, mode="clip")

    def learn(self, at: np.ndarray, m: int, ids: np.ndarray, fresh: np.ndarray, hit: np.ndarray, symbol: np.ndarray) -> None:
        """ids as int32, and as new entries."""
        self.said[self.rows, :m] = symbol
        self.rows += 1
        moved = self.now - (self.now >> RATE)
        moved += hit * GAIN
        self.chance[self.spot] = moved
        right = (self.i == ids) * RIGHT
        right += fresh
        self.table[at] = right

    def due(self, t: int) -> bool:
        return t in REFRESH or t % EVERY == 0


def _by_order(x: np.ndarray) -> list[np.ndarray]:
    """Sums of the states' rows for each state of order 2, of order 1 and of order 0."""
    x = x.reshape(len(x), 4, 4, 4, -1)
    add = partial(np.sum, dtype=np.int32)
    late = add(x, axis=1)
    return [add(late, axis=1), add(late, axis=2), add(add(x, axis=3), axis=2)]


#: How often a slot was seen, in four grades, shifted to their place in a state.
_GRADE = np.array([0 if i < 1 else 16 if i < 3 else 32 if i < 8 else 48 for i in range(9)], np.int8)


def encode(ids: list[np.ndarray], bits: int) -> list[bytes]:
    """Each block's ids as bytes; the blocks' lengths must not grow. ids are below 2 to the power of bits and 2 to the 28."""
    lanes, steps = len(ids), len(ids[0])
    x = np.zeros((steps + 2, lanes), np.int32)  # after two that are none
    for i, block in enumerate(ids):
        x[2 : len(block) + 2, i] = block
        x[2 : len(block) + 2, i] += 1
    sizes = np.array([len(b) for b in ids])
    model = _Model(lanes, False)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 63, np.uint64)
    words = np.zeros((steps * (2 if bits > 16 else 1) * 3 // 2 + 8, lanes), np.uint64)
    flat, used = words.reshape(-1), np.arange(lanes)
    ends = set(sizes.tolist())
    m = lanes
    raw_unit, most = np.uint64(min(bits, 16)), np.uint64((1 << min(bits, 16)) - 1)

    def give(rows: np.ndarray, own: np.ndarray) -> None:
        """Lanes whose width is small give their first 32 bits of low, with what carries in the 33rd."""
        at = used.take(rows, mode="clip")
        flat[at] = own >> REST
        at += lanes
        used[rows] = at
        own &= LOW
        own <<= WORD
        low[rows] = own
        width[rows] = width.take(rows, mode="clip") << WORD

    for t in range(steps):
        if t in ends:
            m = int((sizes > t).sum())
        if t and model.due(t):
            model.refresh(m if t not in ends else int((sizes >= t).sum()))
        row = t % AHEAD
        if row == 0:  # all that follows from the ids alone
            part = x[t : t + AHEAD + 2]
            entry = part[:-1] & (ENTRIES - 1)
            place = np.empty((len(entry) - 1, 2, lanes), np.int64)
            place[:, 0] = entry[1:]
            place[:, 1] = (entry[1:] + entry[:-1] * APART) & (ENTRIES - 1)
            place += model.base
            fresh = (part[2:, None] << 3) + THERE
            slots = (part[2:] & (SLOTS - 1)).astype(np.int16)
            spots = slots + model.slots
        at, now = place[row, :, :m], x[t + 2, :m]
        w, lo = width[:m], low[:m]
        model.predict(at, m)
        hit = now == model.cand
        part = w >> P_SHIFT
        part *= model.now.astype(np.uint64)
        w -= part
        lo += np.where(hit, NONE, part)
        np.copyto(w, part, where=hit)
        spot = spots[row, :m]
        known = model.slot.take(spot, mode="clip") == now
        symbol = np.where(hit, S_HIT, np.where(known, slots[row, :m], S_ESCAPE))
        both = model.flat.take(symbol + model.symbols[:m], mode="clip").astype(np.uint64)
        w >>= F_SHIFT
        lo += w * (both >> FIRST)
        both &= OWN
        w *= both
        rows = (w < SMALL).nonzero()[0]
        if len(rows):
            give(rows, low.take(rows, mode="clip"))
        rows = (symbol == ESCAPE).nonzero()[0]
        if len(rows):
            left = (now.take(rows, mode="clip") - 1).astype(np.uint64)
            for b in range(0, bits, 16):
                unit = width.take(rows, mode="clip") >> raw_unit
                own = low.take(rows, mode="clip") + unit * ((left >> np.uint64(b)) & most)
                low[rows], width[rows] = own, unit
                small = (unit < SMALL).nonzero()[0]
                give(rows.take(small), own.take(small))
        model.slot[spot] = now
        model.learn(at, m, now, fresh[row, :, :m], hit, symbol)
    for _ in range(2):  # what is left of low
        flat[used] = low >> REST
        low = (low & LOW) << WORD
        used += lanes
    used //= lanes
    n = int(used.max())
    for i in range(n - 1, 0, -1):  # carries
        words[i - 1] += words[i] >> WORD
    out = words[:n].T.astype("<u4", order="C")
    return [out[i, : used[i]].tobytes() for i in range(lanes)]


def decode(coded: list[bytes], sizes: list[int], bits: int) -> list[np.ndarray]:
    """The blocks' ids again."""
    lanes, steps = len(coded), sizes[0]
    given = np.zeros((lanes, max(len(c) for c in coded) // 4 + 8), np.uint64)
    for i, c in enumerate(coded):
        given[i, : len(c) // 4] = np.frombuffer(c, "<u4")
    code = (given[:, 0] << REST) | (given[:, 1] >> np.uint64(1))
    words = ((given[:, 1:-1] << REST) | (given[:, 2:] >> np.uint64(1))).astype(np.uint32)  # 32 bits each, after those 63
    del given
    flat, stride = words.reshape(-1), words.shape[1]
    used = np.arange(lanes) * stride
    width = np.full(lanes, 1 << 63, np.uint64)
    model = _Model(lanes, True)
    x = np.zeros((steps, lanes), np.int32)
    lengths = np.array(sizes)
    ends, m = set(sizes), lanes
    raw_unit, most = np.uint64(min(bits, 16)), np.uint64((1 << min(bits, 16)) - 1)
    full = np.uint64(FULL - 1)
    lanes_full = np.arange(lanes) * FULL
    now, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    place = np.empty((2, lanes), np.int64)

    def take(rows: np.ndarray, own: np.ndarray) -> None:
        """Lanes whose width is small take 32 bits more into their code."""
        at = used.take(rows, mode="clip")
        own <<= WORD
        own |= flat.take(at, mode="clip")
        code[rows] = own
        at += 1
        used[rows] = at
        width[rows] = width.take(rows, mode="clip") << WORD

    for t in range(steps):
        if t in ends:
            m = int((lengths > t).sum())
        if t and model.due(t):
            model.refresh(m if t not in ends else int((lengths >= t).sum()))
        w, c, at = width[:m], code[:m], place[:, :m]
        entry = now[:m] & (ENTRIES - 1)
        np.add(entry, model.base[0, :m], out=at[0])
        moved = before[:m] + entry
        moved &= ENTRIES - 1
        np.add(moved, model.base[1, :m], out=at[1])
        before = entry * APART
        model.predict(at, m)
        part = w >> P_SHIFT
        part *= model.now.astype(np.uint64)
        hit = c < part
        w -= part
        c -= np.where(hit, NONE, part)
        np.copyto(w, part, where=hit)
        w >>= F_SHIFT
        value = np.minimum(c // w, full).astype(np.int64)
        escape = value >= model.edge[:m]
        value += lanes_full[:m]
        symbol = np.where(hit, S_HIT, np.where(escape, S_ESCAPE, model.at.take(value, mode="clip")))
        both = model.flat.take(symbol + model.symbols[:m], mode="clip").astype(np.uint64)
        c -= w * (both >> FIRST)
        both &= OWN
        w *= both
        rows = (w < SMALL).nonzero()[0]
        if len(rows):
            take(rows, code.take(rows, mode="clip"))
        spot = (symbol & (SLOTS - 1)) + model.slots[:m]
        now = np.where(hit, model.cand, model.slot.take(spot, mode="clip"))
        rows = (symbol == ESCAPE).nonzero()[0]
        if len(rows):
            got = np.ones(len(rows), np.uint64)
            for b in range(0, bits, 16):
                unit = width.take(rows, mode="clip") >> raw_unit
                own = code.take(rows, mode="clip")
                piece = np.minimum(own // unit, most)
                own -= unit * piece
                got += piece << np.uint64(b)
                code[rows], width[rows] = own, unit
                small = (unit < SMALL).nonzero()[0]
                take(rows.take(small), own.take(small))
            now[rows] = got
        x[t, :m] = now
        model.slot[(now & (SLOTS - 1)) + model.slots[:m]] = now
        model.learn(at, m, now, (now << 3) + THERE, hit, symbol)
    x -= 1
    return [x[:n, i].copy() for i, n in enumerate(sizes)]
