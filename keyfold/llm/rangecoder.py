"""Adaptive context-mixing range coder for blocks of token ids.

Blocks are coded independently: models start anew in each, and each carries a
checksum. Many blocks go side by side, one numpy lane each.

For every id three predictions are mixed into one distribution over 2**16 parts:
order 2 and order 1 each name the id that followed the context last, with a mass
that the block learns from how often that came true; order 0 shares the rest
among the block's ids by their counts so far, in SLOTS shares.
Counts enter the order-0 table after 32, 64, 128, 256 and 512 ids.

The coder keeps a 48-bit interval and gives 16 bits at a time. The decoder goes
step by step; the encoder knows all ids, so only what hangs on the step before
(contexts, masses, the interval) goes step by step, and the rest GROUP steps at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
MAGIC = b"KTB2"
BLOCK = 1024
TOP, LOW_BITS, WORD = 1 << 48, 32, 16
PARTS = 1 << 16
SLOT_BITS = 10
SLOTS = 1 << SLOT_BITS  # shares of order 0; an id of the block's alphabet has one at least
MOST = 20_000  # parts of one prediction at most
CONTEXTS = 1 << 10  # order-2 contexts a block
REFRESH = (0, 32, 64, 128, 256, 512)  # powers of two, and multiples of GROUP
RATE = 5
START = 4_000  # parts of a prediction at first
HEADER = "<IIHI"

GROUP = 32


class BadBlock(ValueError):
    """A block whose form or checksum is wrong."""


class _Order0:
    """Shares of the ids by their counts, in every lane. ``n_ids``: size of each
    lane's alphabet. ``ranges`` holds an id's first share and their number,
    ``owner`` the id of each share (for the decoder)."""

    def __init__(self, n_ids: np.ndarray, owners: bool) -> None:
        self.n_ids, self.width, self.owners = n_ids[:, None].astype(np.int32), int(n_ids.max()), owners
        self.base = np.arange(len(n_ids)) * self.width
        self.count = np.zeros(len(n_ids) * self.width, np.int32)
        self.there = (np.arange(self.width) < self.n_ids).astype(np.int32)
        self.seen = 0

    def refresh(self, rows: np.ndarray) -> None:
        """``rows`` (steps x lanes): the ids since the last refresh."""
        self.seen += len(rows)
        if self.seen:
            self.count += np.bincount((rows + self.base).reshape(-1), minlength=len(self.count)).astype(np.int32)
            freq = self.count.reshape(self.there.shape) * (SLOTS - self.n_ids)
            freq >>= self.seen.bit_length() - 1
            freq += self.there
        else:
            freq = self.there * (SLOTS // self.n_ids)
        freq[:, 0] += SLOTS - freq.sum(axis=1, dtype=np.int32)
        start = np.cumsum(freq, axis=1, dtype=np.int32)
        start -= freq
        self.ranges = ((start << (SLOT_BITS + 1)) | freq).reshape(-1)
        if self.owners:
            ids = np.broadcast_to(np.arange(self.width, dtype=np.int16), freq.shape)
            self.owner = np.repeat(ids.reshape(-1), freq.reshape(-1))


class _Contexts:
    """What followed each context last: ``~id``, or 0 if nothing did, so the sign
    tells. Order 1 in front, then order 2; rows of ``mass`` in the same order."""

    def __init__(self, lanes: int, width: int) -> None:
        self.base1 = np.arange(lanes) * width
        self.base2 = np.arange(lanes) * CONTEXTS + lanes * width
        self.table = np.zeros(lanes * (width + CONTEXTS), np.int16)
        self.mass = np.full((2, lanes), START, np.int16)
        self.by5, self.most = np.full(lanes, 5), np.full(lanes, CONTEXTS - 1)

    def at(self, before: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        """Where the contexts stand; out: (..., 2, lanes)."""
        np.add(last, self.base1, out=out[..., 0, :])
        key = before << self.by5
        key += last
        key &= self.most
        np.add(key, self.base2, out=out[..., 1, :])


def _aim(hit: np.ndarray) -> np.ndarray:
    """What the masses move towards; with one step more, as shifts round down."""
    aim = hit.view(np.int8).astype(np.int16)
    aim *= np.int16(MOST)
    aim += np.int16(1 << RATE)
    return aim


def _parts(x: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the predictions (..., 2, lanes) and their sum: none for a context
    that is new; both orders' naming one id counts once."""
    m = x >> np.int16(15)
    m &= mass
    m[..., 0, :] *= x[..., 0, :] != x[..., 1, :]
    return m, np.add(m[..., 0, :], m[..., 1, :], dtype=np.int32)


def _shares(ranges: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of ids' order-0 ranges in what the predictions leave."""
    a = ranges >> np.int32(SLOT_BITS + 1)
    ranges &= np.int32((1 << (SLOT_BITS + 1)) - 1)
    ranges += a
    a *= rest
    a >>= np.int32(SLOT_BITS)
    ranges *= rest
    ranges >>= np.int32(SLOT_BITS)
    ranges -= a
    return a, ranges


def encode_lanes(ids: np.ndarray, n_ids: np.ndarray) -> list[bytes]:
    """Code of each row of ``ids`` (lanes x BLOCK, numbers below n_ids)."""
    lanes, steps = ids.shape
    padded = np.zeros((steps + 2, lanes), np.int64)  # two ids 0 stand before the first
    padded[2:] = ids.T
    order0 = _Order0(n_ids, False)
    model = _Contexts(lanes, order0.width)
    table, mass = model.table, model.mass
    low, size, product = np.zeros(lanes, np.int64), np.full(lanes, TOP, np.int64), np.empty(lanes, np.int64)
    out = np.zeros((steps + 8, lanes), np.int32)
    flat, to = out.reshape(-1), np.arange(lanes)
    done = 0
    # numbers as whole arrays: numpy takes twice as long over a step's scalars
    by16, by4, by32, rate, least, width = (np.full(lanes, v, k) for v, k in (
        (WORD, np.int64), (4, np.int64), (LOW_BITS, np.int64), (RATE, np.int16), (1 << LOW_BITS, np.int64), (lanes, np.int64)))
    for g in range(0, steps, GROUP):
        if g in REFRESH:
            order0.refresh(padded[done + 2:g + 2])
            done = g
        s = padded[g + 2:g + 2 + GROUP]
        n = len(s)
        y = ~s.astype(np.int16)
        at = np.empty((n, 2, lanes), np.int64)
        model.at(padded[g:g + n], padded[g + 1:g + 1 + n], at)
        x = np.empty((n, 2, lanes), np.int16)
        for i in range(n):
            k = at[i]
            x[i] = table.take(k)
            table[k] = y[i]
        hit = x == y[:, None]
        aim = _aim(hit)
        masses = np.empty_like(x)
        for i in range(n):
            masses[i] = mass
            move = aim[i]
            move -= mass
            move >>= rate
            mass += move
        m, taken = _parts(x, masses)
        a, freq = _shares(order0.ranges.take(s + order0.base), PARTS - taken)
        a += taken
        # order 2 counts where both hold
        m, hit = m.astype(np.int32), -hit.view(np.int8).astype(np.int32)
        for k, begin in ((0, m[:, 1]), (1, 0)):
            a += hit[:, k] & (begin - a)
            freq += hit[:, k] & (m[:, k] - freq)
        a, freq = a.astype(np.int64), freq.astype(np.int64)
        for i in range(n):
            size >>= by16
            np.multiply(a[i], size, out=product)
            low += product  # below 2 * TOP; the carry goes out with the next word
            size *= freq[i]
            np.right_shift(low, by32, out=product)
            flat[to] = product  # a lane that gives no word now writes there again
            short = (size < least).view(np.int8).astype(np.int64)
            product *= short
            product <<= by32
            low -= product
            to += short * width
            short <<= by4
            low <<= short
            size <<= short
    for shift in (32, 16, 0):
        flat[to] = (low >> shift) & (0xFFFF if shift < 32 else 0x1FFFF)
        to += lanes
    for t in range(int(to.max()) // lanes - 1, 0, -1):  # the carries
        carry = out[t] >> 16
        if carry.any():
            out[t] &= 0xFFFF
            out[t - 1] += carry
    words = np.ascontiguousarray(out.T.astype("<u2"))
    return [words[i, :n].tobytes() for i, n in enumerate((to // lanes).tolist())]


def decode_lanes(codes: list[bytes], n_ids: np.ndarray, steps: int) -> np.ndarray:
    """The ids of each code, a row each."""
    lanes = len(codes)
    sizes = np.array([len(c) // 2 for c in codes])
    rows = steps + 4  # a step takes one word at most
    if sizes.max() > rows:
        raise BadBlock("longer than its ids")
    words = np.zeros((lanes, rows), np.uint16)
    for i, c in enumerate(codes):
        words[i, :sizes[i]] = np.frombuffer(c, "<u2", sizes[i])
    words = np.ascontiguousarray(words.T)
    flat = words.reshape(-1)
    order0 = _Order0(n_ids, True)
    model = _Contexts(lanes, order0.width)
    table, mass, base = model.table, model.mass, order0.base
    first = np.arange(lanes) * SLOTS
    # interval and code are whole numbers below 2**49, which double precision holds
    code = (words[0].astype(np.float64) * PARTS + words[1]) * PARTS + words[2]
    to, size = np.arange(lanes) + 3 * lanes, np.full(lanes, float(TOP))
    quotient, product = np.empty(lanes), np.empty(lanes)
    at = np.empty((2, lanes), np.int64)
    # numbers as whole arrays: numpy takes twice as long over a step's scalars
    one, by_part, top_part, least = (np.full(lanes, v, np.float64) for v in (1, 1 / PARTS, PARTS - 1, 1 << LOW_BITS))
    one = one.view(np.int64)
    slots, past, whole = (np.full(lanes, v, np.int32) for v in (SLOTS, SLOTS - 1, PARTS))
    width, exponent, rate = np.full(lanes, lanes), np.full(lanes, WORD << 52), np.full(lanes, RATE, np.int16)
    out = np.zeros((steps, lanes), np.int16)
    before, last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # two ids 0 stand before the first
    done = 0
    # of each lane: start and parts of order 2, order 1 and order 0, and the id's name
    starts, parts, names = np.zeros((3, lanes), np.int32), np.empty((3, lanes), np.int32), np.empty((3, lanes), np.int16)
    lane = np.arange(lanes)
    for t in range(steps):
        if t in REFRESH:
            order0.refresh(out[done:t])
            done = t
        model.at(before, last, at)
        x = table.take(at)
        m, taken = _parts(x, mass)
        rest = whole - taken
        size *= by_part
        np.floor(size, out=size)
        # quotients of whole numbers below 2**49 and 2**33, so far from the next
        # whole number that division in double precision never reaches it
        np.divide(code, size, out=quotient)
        np.minimum(quotient, top_part, out=quotient)
        v = quotient.astype(np.int32)
        order = (v >= m[1]).view(np.int8)
        order += (v >= taken).view(np.int8)
        # the share that holds v: below zero where a prediction does, any id then
        v -= taken
        v *= slots
        v += past
        np.divide(v, rest, out=quotient)
        slot = quotient.astype(np.int64)
        slot += first
        found = order0.owner.take(slot, mode="clip")
        slot = base + found
        a, freq = _shares(order0.ranges.take(slot, mode="clip"), rest)
        starts[1] = m[1]
        np.add(a, taken, out=starts[2])
        parts[0], parts[1], parts[2] = m[1], m[0], freq
        names[0], names[1] = x[1], x[0]
        np.invert(found, out=names[2])
        pick = order * width
        pick += lane
        y = names.reshape(-1).take(pick)
        before, last = last, before
        np.invert(y, out=last)
        out[t] = last
        code -= starts.reshape(-1).take(pick) * size
        size *= parts.reshape(-1).take(pick)
        np.minimum(code, size, out=code)  # only damaged codes lie past the interval
        short = (size < least).view(np.int8).astype(np.int64)
        word = flat.take(to)
        word *= short.astype(np.uint16)
        to += short * width
        short *= exponent  # what a factor of 2**16 adds to a double's bits
        size.view(np.int64)[:] += short
        short += one
        code *= short.view(np.float64)
        code += word
        table[at] = y
        move = _aim(x == y)
        move -= mass
        move >>= rate
        mass += move
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of up to BLOCK ids (unsigned 32-bit), one after another. A short
    last block is padded for the coder; its true length is in the header."""
    if not len(ids):
        return []
    lanes = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.full(lanes * BLOCK - len(ids), ids[-1], ids.dtype)]).reshape(lanes, BLOCK)
    # 16-bit numbers are sorted by radix
    order = np.argsort(padded.astype(np.uint16) if padded.max() < PARTS else padded, axis=1, kind="stable")
    order += np.arange(lanes)[:, None] * BLOCK
    ranked = padded.reshape(-1).take(order)
    new = np.ones_like(ranked, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    local = np.empty(lanes * BLOCK, np.int16)
    local[order.reshape(-1)] = (np.cumsum(new, axis=1, dtype=np.int16) - np.int16(1)).reshape(-1)
    n_ids = new.sum(axis=1)
    codes = encode_lanes(local.reshape(lanes, BLOCK), n_ids)
    alphabets = ranked[new].astype(np.int64)
    ends = np.cumsum(n_ids)
    gaps = np.diff(alphabets, prepend=0)
    gaps[ends - n_ids] = alphabets[ends - n_ids]
    narrow = np.minimum(gaps, 255).astype(np.uint8)
    raw = ids.astype("<u4").tobytes()
    out = []
    for i, (code, end, n) in enumerate(zip(codes, ends.tolist(), n_ids.tolist())):
        wide = gaps[end - n:end]
        head = narrow[end - n:end].tobytes() + wide[wide >= 255].astype("<u4").tobytes()
        own = raw[4 * i * BLOCK:4 * (i + 1) * BLOCK]
        out.append(MAGIC + struct.pack(HEADER, zlib.crc32(own), len(own) // 4, n, len(head)) + head + code)
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises BadBlock where a checksum is wrong."""
    if not blocks:
        return []
    at, alphabets, codes, heads = len(MAGIC) + struct.calcsize(HEADER), [], [], []
    for b in blocks:
        if b[:len(MAGIC)] != MAGIC or len(b) < at:
            raise BadBlock("not a block")
        crc, n, k, head = struct.unpack_from(HEADER, b, len(MAGIC))
        if not 0 < n <= BLOCK or not 0 < k <= BLOCK or not k <= head <= len(b) - at:
            raise BadBlock("wrong header")
        gaps = np.frombuffer(b, np.uint8, k, at).astype(np.int64)
        wide = gaps == 255
        if np.count_nonzero(wide) * 4 != head - k:
            raise BadBlock("wrong header")
        gaps[wide] = np.frombuffer(b, "<u4", (head - k) // 4, at + k)
        alphabets.append(np.cumsum(gaps))
        codes.append(b[at + head:])
        heads.append((crc, n))
    n_ids = np.array([len(a) for a in alphabets])
    local = decode_lanes(codes, n_ids, BLOCK) + (np.cumsum(n_ids) - n_ids)[:, None]
    every = np.concatenate(alphabets).astype("<u4").take(local, mode="clip")
    out = []
    for (crc, n), row in zip(heads, every):
        if zlib.crc32(row[:n]) != crc:
            raise BadBlock("checksum differs")
        out.append(row[:n])
    return out
