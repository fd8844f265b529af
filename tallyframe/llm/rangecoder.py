"""Adaptive context-mixing range coder for token ids, in blocks that start from nothing and stand alone.

Three models predict the next id of a block, all learnt from the block's own ids. Order 2 and order 1 remember which id
followed the two ids before, and the one before. Order 0 counts how often each remembered id, and each class of new
ids, has come. The prediction is the mix of the three, ``w2 * order 2 + w1 * order 1 + w0 * order 0``; the weights follow
how often orders 2 and 1 have been right, by how sure they are and whether they agree. A range coder turns the mix into
bytes; what tells a new id from its class is added as plain bits. What a block's ids tell takes effect after each
``STRIDE`` of them, so that the models learn from many blocks' strides in one pass.
Numbers are whole throughout (held in doubles below 2**53), so every machine decodes what another has encoded. Blocks
are coded side by side, one numpy lane each.
"""

from __future__ import annotations

import numpy as np

BLOCK, STRIDE = 1024, 64
#: Strides after which order 0 takes effect.
_STRIDES = 2
_LANES = 4096
#: Slots of orders 1 and 2 in a block; remembered ids of order 0, and bits that tell the ids of a class apart.
_SLOTS, _RECENT, _BITS = 256, 64, 10
_SYMBOLS = _RECENT + (1 << 16 - _BITS)
#: Units of order 0, and what a symbol's count grows by.
_UNITS, _GROWTH = 4096.0, 4
_SURE, _ID, _STATES = np.int32(1 << 16), np.int32(0xFFFF), 16
#: How likely an order that is sure to this degree is right before a block has told, of 65,536; how many sightings that
#: is worth; and what each order has at least.
_START, _PRIOR, _LEAST = np.array([1200, 16000, 40000, 56000], np.float32), np.float32(12), np.float32(64)
_WORD, _FULL, _NARROW = 65536.0, float(1 << 48), float(1 << 32)


class _Coder:
    """An interval of each lane, less than 2**48 wide; a word of 16 bits leaves it whenever less than 2**32 is left."""

    def __init__(self, n: int):
        self.wide = np.full(n, _FULL)

    def narrow(self, start: np.ndarray, size: np.ndarray, inner: np.ndarray, part: np.ndarray) -> None:
        """Keep, of 65,536 units, ``size`` from ``start`` on; and of these, in 4,096 units, ``part`` from ``inner`` on."""
        unit = np.floor(self.wide * (1 / 65536))
        start = start * unit
        unit *= size
        unit *= 1 / _UNITS
        np.floor(unit, out=unit)
        start += inner * unit
        self.move(start)
        unit *= part
        self.wide = wide = unit
        thin = np.flatnonzero(wide < _NARROW)
        while len(thin):
            self.shift(thin)
            left = wide[thin] * _WORD
            wide[thin] = left
            thin = thin[left < _NARROW]


class _Encoder(_Coder):
    def __init__(self, n: int, length: int):
        super().__init__(n)
        self.low = np.zeros(n)
        self.room = 2 * length + 4
        self.words, self.end = np.zeros(n * self.room, np.int32), np.arange(n) * self.room

    def move(self, by: np.ndarray) -> None:
        self.low += by
        over = np.flatnonzero(self.low >= _FULL)
        if len(over):  # a carry goes to the word before
            self.low[over] -= _FULL
            self.words[self.end[over] - 1] += 1

    def shift(self, at: np.ndarray) -> None:
        low = self.low[at]
        word = np.floor(low * (1 / _NARROW))
        end = self.end[at]
        self.words[end] = word
        self.end[at] = end + 1
        self.low[at] = (low - word * _NARROW) * _WORD

    def done(self, table: np.ndarray, new: np.ndarray) -> list[bytes]:
        """Of each lane the number of new ids, what tells them from their classes, and the words."""
        every = np.arange(len(self.low))
        self.move(np.ceil(self.low / _WORD) * _WORD - self.low)
        self.shift(every)
        self.shift(every)
        while len(over := np.flatnonzero(self.words >= 1 << 16)):
            self.words[over] -= 1 << 16
            self.words[over - 1] += 1
        words, size = self.words.astype("<u2").reshape(len(every), self.room), (self.end - every * self.room).tolist()
        bits = np.unpackbits((table[new] << 16 - _BITS).astype(">u2").view(np.uint8)).reshape(-1, 16)[:, :_BITS].reshape(-1)
        many = new.sum(axis=1)
        ends = (np.cumsum(many) * _BITS).tolist()
        out = []
        for j, (k, a, z) in enumerate(zip(many.tolist(), [0, *ends[:-1]], ends, strict=True)):
            out.append(k.to_bytes(2, "little") + np.packbits(bits[a:z]).tobytes() + words[j, : size[j]].tobytes())
        return out


class _Decoder(_Coder):
    def __init__(self, coded: list[bytes]):
        super().__init__(len(coded))
        bits, words = [], []
        for block in coded:
            n = int.from_bytes(block[:2], "little")
            size = -(-n * _BITS // 8)
            bits.append(np.unpackbits(np.frombuffer(block, np.uint8, size, 2), count=n * _BITS))
            words.append(block[2 + size :])
        sizes = np.array([len(b) for b in bits]) // _BITS
        wide = np.zeros((int(sizes.sum()) + 1, 16), np.uint8)
        wide[:-1, 16 - _BITS :] = np.concatenate(bits).reshape(-1, _BITS)
        self.bits = np.packbits(wide).view(">u2").astype(np.uint32)
        self.next = np.cumsum(sizes) - sizes
        size = np.array([len(w) // 2 for w in words])
        first = np.cumsum(size) - size
        self.stream = np.concatenate([np.frombuffer(b"".join(words), "<u2"), np.zeros(8, "<u2")])
        self.low = (self.stream[first] * _WORD + self.stream[first + 1]) * _WORD + self.stream[first + 2]
        self.at = first + 3

    def move(self, by: np.ndarray) -> None:
        self.low -= by

    def shift(self, at: np.ndarray) -> None:
        place = self.at[at]
        self.low[at] = self.low[at] * _WORD + self.stream.take(place, mode="clip")
        self.at[at] = place + 1


class _Models:
    """The models of all lanes, and what they predict until the next stride."""

    def __init__(self, n: int):
        self.slots, self.states = (np.arange(n) * _SLOTS).astype(np.uint32), (np.arange(n) * _STATES).astype(np.int32)
        #: The id that followed each pair of ids, and each id, and above it how sure that is.
        self.two, self.one = np.zeros(n * _SLOTS, np.int32), np.zeros(n * _SLOTS, np.int32)
        # A state is sure2 * 4 + (sure1 > 1) * 2 + agree; it has a chance for order 2, and for order 1 where that is wrong.
        state = np.arange(_STATES)
        start2, start1 = _START[state >> 2], _START[(state >> 1 & 1) + 1]
        self.seen2, self.seen1 = np.full(n * _STATES, _PRIOR), np.full(n * _STATES, _PRIOR)
        self.right2, self.right1 = np.tile(start2 / 65536, n) * _PRIOR, np.tile(start1 / 65536, n) * _PRIOR
        self.agree = np.tile(state & 1, n).astype(bool)
        self.count = np.zeros((n, _SYMBOLS), np.float32)
        self.count[:, _RECENT:] = 1
        self.recent = np.zeros(n * _RECENT, np.uint16)
        self.recents, self.symbols = np.arange(n) * _RECENT, np.arange(n) * _SYMBOLS
        self.until = np.zeros((n, _SYMBOLS), np.int16)
        self.held, self.lanes = [], np.tile(np.arange(n), STRIDE)
        self.weigh()
        self.renew()

    def weigh(self) -> None:
        """The weights of each state."""
        w2 = np.floor(self.right2 / self.seen2 * (65536 - 3 * _LEAST)) + _LEAST
        w1 = np.floor(self.right1 / self.seen1 * (65536 - 2 * _LEAST - w2)) + _LEAST
        w1[self.agree] = 0
        self.w2, self.both = w2, w2 + w1

    def renew(self) -> None:
        """Count the symbols of the strides held and remember their new ids. Each symbol has at least one unit; what
        rounding leaves goes to the last one."""
        if self.held:
            at, symbol, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held = []
            count = self.count.reshape(-1)
            count += np.bincount(at * _SYMBOLS + symbol, minlength=len(count)) * _GROWTH
            new = np.flatnonzero(symbol >= _RECENT)
            at, ids = at[new], ids[new]
            slot = ids & (_RECENT - 1)
            self.recent[at * _RECENT + slot] = ids
            count[at * _SYMBOLS + slot] = _GROWTH
        share = np.float32(_UNITS - _SYMBOLS) / self.count.sum(axis=1, keepdims=True)
        np.cumsum((self.count * share).astype(np.int16) + np.int16(1), axis=1, out=self.until)
        self.until[:, -1] = _UNITS
        self.groups = np.ascontiguousarray(self.until[:, 15::16])

    def contexts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of order 1 and 2 after the id ``a``, which ``b`` stood before; one column a lane."""
        a = a * np.uint32(40503)
        return self.slots + (a >> np.uint32(5) & np.uint32(_SLOTS - 1)), self.slots + (a + b * np.uint32(2654435761) >> np.uint32(11) & np.uint32(_SLOTS - 1))

    def state(self, e1: np.ndarray, e2: np.ndarray, agree: np.ndarray) -> np.ndarray:
        now = e2 >> 16
        now <<= 1
        now += e1 >= 2 * _SURE
        now <<= 1
        now += agree
        now += self.states
        return now

    def find(self, value: np.ndarray) -> np.ndarray:
        """The symbol that holds each lane's value: the borders up to it, counted by group and then inside the group."""
        value = value.astype(np.int16)[:, None]
        group = _counted(self.groups <= value)
        return group * 16 + _counted(self.until.reshape(-1, 16).take((self.symbols >> 4) + group, axis=0) <= value)

    def places(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where symbols begin, and their sizes."""
        at = self.symbols + symbol
        start = self.until.take(at - 1, mode="clip").astype(np.float64)
        start[symbol == 0] = 0
        return start, self.until.take(at) - start

    def learn(self, ids, k1, e1, k2, e2, now, hit1, hit2, symbol) -> None:
        """What a stride's ids tell (one row a step, one column a lane)."""
        small = ids.astype(np.int32)
        for table, k, e in ((self.one, k1, e1), (self.two, k2, e2)):
            same = (e & _ID) == small
            # surer if right; if not, less sure or replaced
            after = np.minimum(e + _SURE, e & _ID | 3 * _SURE)
            wrong = np.flatnonzero(~same)
            less = e.reshape(-1)[wrong] - _SURE
            after.reshape(-1)[wrong] = np.where(less < _SURE, small.reshape(-1)[wrong] | _SURE, less)
            table[k.reshape(-1)] = after.reshape(-1)
        size = len(self.seen2)
        sighted, right = np.bincount(now.reshape(-1), minlength=size), np.bincount(now[hit2], minlength=size)
        self.seen2 += sighted
        self.right2 += right
        self.seen1 += sighted - right
        self.right1 += np.bincount(now[hit1], minlength=size)
        self.weigh()
        miss = np.flatnonzero(~(hit1 | hit2))
        self.held.append((self.lanes.take(miss), symbol.reshape(-1).take(miss), small.reshape(-1).take(miss)))
        if len(self.held) == _STRIDES:
            self.renew()


def _counted(less: np.ndarray) -> np.ndarray:
    """How many of each row are true."""
    eights = np.bitwise_count(less.view(np.uint64))
    total = eights[:, 0].astype(np.int64)
    for k in range(1, eights.shape[1]):
        total += eights[:, k]
    return total


def _encoded(table: np.ndarray) -> list[bytes]:
    """The coded rows of ``table``, one block each."""
    n, length = table.shape
    coder, models = _Encoder(n, length), _Models(n)
    ids = np.ascontiguousarray(table.T)
    before = np.zeros((length + 2, n), np.uint32)
    before[2:] = ids
    new = np.zeros((length, n), bool)
    for t in range(0, length, STRIDE):
        z = min(t + STRIDE, length)
        own = ids[t:z].astype(np.int64)
        k1, k2 = models.contexts(before[t + 1 : z + 1], before[t:z])
        e1, e2 = models.one.take(k1), models.two.take(k2)
        p1, p2 = e1 & _ID, e2 & _ID
        now = models.state(e1, e2, p1 == p2)
        hit2, hit1 = p2 == own, p1 == own
        hit1 &= ~hit2
        slot = own & (_RECENT - 1)
        symbol = np.where(models.recent.take(models.recents + slot) == own, slot, _RECENT + (own >> _BITS))
        w2, start = models.w2.take(now).astype(np.float64), models.both.take(now).astype(np.float64)
        size = 65536 - start
        inner, part = models.places(symbol)
        hit = hit1 | hit2
        inner[hit], part[hit] = 0, _UNITS
        new[t:z] = ~hit & (symbol >= _RECENT)
        size[hit1] = (start - w2)[hit1]
        start[hit1] = w2[hit1]
        size[hit2], start[hit2] = w2[hit2], 0
        for j in range(z - t):
            coder.narrow(start[j], size[j], inner[j], part[j])
        models.learn(own, k1, e1, k2, e2, now, hit1, hit2, symbol)
    return coder.done(table, np.ascontiguousarray(new.T))


def _decoded(coded: list[bytes], length: int) -> np.ndarray:
    """The ids of blocks of one length, one row each."""
    n = len(coded)
    coder, models = _Decoder(coded), _Models(n)
    table = np.zeros((length + 2, n), np.uint32)
    kept = {name: np.zeros((STRIDE, n), kind) for name, kind in (("k1", np.uint32), ("e1", np.int32), ("k2", np.uint32), ("e2", np.int32), ("now", np.int32), ("hit1", bool), ("hit2", bool), ("symbol", np.int64))}
    for t in range(0, length, STRIDE):
        z = min(t + STRIDE, length)
        for j in range(z - t):
            row = t + j + 2
            k1, k2 = models.contexts(table[row - 1], table[row - 2])
            e1, e2 = models.one.take(k1), models.two.take(k2)
            p1, p2 = e1 & _ID, e2 & _ID
            now = models.state(e1, e2, p1 == p2)
            w2, start = models.w2.take(now).astype(np.float64), models.both.take(now).astype(np.float64)
            unit = np.floor(coder.wide * (1 / 65536))
            value = coder.low / unit  # compared with whole numbers, it needs no rounding
            hit2 = value < w2
            hit1 = value < start
            hit1 &= ~hit2
            size = 65536 - start
            inside = coder.low - start * unit
            inside /= np.floor(size * unit * (1 / _UNITS))
            symbol = models.find(np.clip(inside, 0.0, _UNITS - 1, out=inside))
            inner, part = models.places(symbol)
            a, b = np.flatnonzero(hit1), np.flatnonzero(hit2)
            size[a] = start[a] - w2[a]
            start[a] = w2[a]
            size[b], start[b] = w2[b], 0
            inner[a] = inner[b] = 0
            part[a] = part[b] = _UNITS
            coder.narrow(start, size, inner, part)
            ids = models.recent.take(models.recents + symbol, mode="clip").astype(np.uint32)
            new = symbol >= _RECENT
            new[a] = new[b] = False
            new = np.flatnonzero(new)
            bit = coder.next[new]
            coder.next[new] = bit + 1
            ids[new] = (symbol[new] - _RECENT << _BITS) + coder.bits.take(bit, mode="clip")
            ids[a] = p1[a]
            ids[b] = p2[b]
            table[row] = ids
            for name, value in (("k1", k1), ("e1", e1), ("k2", k2), ("e2", e2), ("now", now), ("hit1", hit1), ("hit2", hit2), ("symbol", symbol)):
                kept[name][j] = value
        models.learn(table[t + 2 : z + 2], **{name: value[: z - t] for name, value in kept.items()})
    return table[2:].T


def encode(ids: np.ndarray) -> list[bytes]:
    """The blocks of 16-bit ``ids``, ``BLOCK`` ids each but the last, as bytes."""
    out, whole = [], len(ids) // BLOCK
    full = ids[: whole * BLOCK].reshape(whole, BLOCK)
    parts = [full[k : k + _LANES] for k in range(0, whole, _LANES)] + ([ids[None, whole * BLOCK :]] if len(ids) > whole * BLOCK else [])
    for part in parts:
        out += _encoded(part)
    return out


def decode(coded: list[bytes], sizes: list[int]) -> np.ndarray:
    """The ids of blocks, each of which may come from anywhere; neighbours of one size are decoded together."""
    out, k = [], 0
    while k < len(coded):
        z = k + 1
        while z < len(coded) and z - k < _LANES and sizes[z] == sizes[k]:
            z += 1
        out.append(_decoded(coded[k:z], sizes[k]).astype("<u2").reshape(-1))
        k = z
    return np.concatenate(out) if out else np.zeros(0, "<u2")
