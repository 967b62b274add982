"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks of BLOCK.  Every block starts with a fresh model and is
decodable alone; its checksum is the CRC-32 of its ids.  Blocks are coded in
lockstep, one lane each, so a step of the model is a few numpy operations over
all lanes.  All arithmetic is in integers, so any machine decodes alike.

The model of a lane predicts the next id:

* order 2 and order 1: the id that last followed the hashed two ids or one id
  before, with a confidence that grows with each success;
* order 0: the ids seen so far, in SLOTS hashed slots with counts.

First the candidate (order 2's id, else order 1's) is coded as hit or miss.  Its
probability is a logistic mixture of what the confidences of order 2 and order 1
and the last outcomes of order 0 are worth, with weights that each lane learns.
After a miss, order 1's id is tried if it is another; then whether a slot of
order 0 has the id, and which one by count; else the id is coded as it is.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK, LANES = 2048, 1024
BITS1, BITS2, SLOTS = 10, 11, 1024
#: Steps after which the cumulative counts of order 0 are taken anew.
EPOCH = 32
TOP, BOT = np.uint64(1 << 48), np.uint64(1 << 32)
U = np.uint64
#: Logistic tables in 12 bits, as is usual: probability from a sum, and back.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int64)
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], dtype=np.int64)


class Coder:
    """A carryless range coder over lanes: 64-bit low and range, 16 bits out at a time."""

    def __init__(self, lanes: int, data: list[bytes] | None = None):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, np.iinfo(np.uint64).max, U)
        self.at = np.zeros(lanes, np.int64)
        self.decoding = data is not None
        if data is not None:
            width = max(len(d) // 2 for d in data) + 8
            self.words = np.zeros((lanes, width), np.uint16)
            for i, d in enumerate(data):
                self.words[i, : len(d) // 2] = np.frombuffer(d, "<u2")
            self.code = np.zeros(lanes, U)
            for _ in range(4):
                self.code = self.code << U(16) | self.words[np.arange(lanes), self.at].astype(U)
                self.at += 1
        else:
            self.words = np.zeros((lanes, 64), np.uint16)

    def _narrow(self, at: np.ndarray | slice, start: np.ndarray, size: np.ndarray, r: np.ndarray) -> None:
        """at: lanes, or a slice of the first ones."""
        low, rng = self.low[at] + start * r, size * r
        self.low[at], self.range[at] = low, rng
        while True:
            same = (low ^ (low + rng)) < TOP
            go = np.nonzero(same | (rng < BOT))[0]
            if not len(go):
                return
            rng = np.where(same[go], rng[go], (~low[go] + U(1)) & (BOT - U(1)))
            low, at = low[go], go if isinstance(at, slice) else at[go]
            place = self.at[at]
            if self.decoding:
                self.code[at] = self.code[at] << U(16) | self.words[at, place].astype(U)
            else:
                if int(place.max()) + 8 >= self.words.shape[1]:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
                self.words[at, place] = (low >> U(48)).astype(np.uint16)
            self.at[at] = place + 1
            low, rng = low << U(16), rng << U(16)
            self.low[at], self.range[at] = low, rng

    def bits(self, at: np.ndarray | slice, p: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        """Codes a bit for each lane of at; p: 12-bit probability of a one."""
        r = self.range[at] >> U(12)
        p = p.astype(U)
        if y is None:
            y = (self.code[at] - self.low[at]) // r < p
        self._narrow(at, np.where(y, U(0), p), np.where(y, p, U(4096) - p), r)
        return y

    def even(self, at: np.ndarray, total: int, value: np.ndarray | None) -> np.ndarray:
        """Codes a value below total, all alike."""
        r = self.range[at] // U(total)
        if value is None:
            value = np.minimum((self.code[at] - self.low[at]) // r, U(total - 1)).astype(np.int64)
        self._narrow(at, value.astype(U), np.ones(len(at), U), r)
        return value

    def ranged(self, at: np.ndarray, cumulated: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        """Codes a value by the lane's cumulative counts, of which the last is the total."""
        n = cumulated.shape[1] - 1
        flat, row = cumulated.reshape(-1), at * (n + 1)
        r = self.range[at] // flat.take(row + n).astype(U)
        if value is None:
            want = np.minimum((self.code[at] - self.low[at]) // r, U(2**31)).astype(np.int64)
            place, step = row.copy(), n >> 1
            while step:
                place += step * (flat.take(place + step) <= want)
                step >>= 1
            value = place - row
        start = flat.take(row + value).astype(U)
        self._narrow(at, start, flat.take(row + value + 1).astype(U) - start, r)
        return value

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        if int(self.at.max(initial=0)) + 8 >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros((len(every), 8), np.uint16)], axis=1)
        for _ in range(4):
            self.words[every, self.at] = (self.low >> U(48)).astype(np.uint16)
            self.low = self.low << U(16)
            self.at += 1
        return [self.words[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.at.tolist())]


def _learn(table: np.ndarray, at: np.ndarray, seen: np.ndarray, y: np.ndarray) -> None:
    """Moves 16-bit probabilities at these places toward what came."""
    table[at] = seen + ((np.where(y, 65_535, 0) - seen) >> 5)


def _run(coder: Coder, ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """Codes ids (lanes x steps) or, if the coder decodes, fills them.  lengths: of the lanes, not rising.

    Tables are flat, a stretch for each lane.  Orders 1 and 2 hold (id + 1) * 16 +
    confidence, order 0 holds (id + 1) * 64 + count; 0 is empty.
    """
    lanes = len(lengths)
    lane = np.arange(lanes)
    next1, next2 = np.zeros(lanes << BITS1, np.int64), np.zeros(lanes << BITS2, np.int64)
    slots, cumulated = np.zeros(lanes * SLOTS, np.int64), np.zeros((lanes, SLOTS + 1), np.int32)
    flat = cumulated.reshape(-1)
    row1, row2, row0, rowc, row16 = lane << BITS1, lane << BITS2, lane * SLOTS, lane * (SLOTS + 1), lane << 4
    # 16-bit probabilities: of a hit by confidence of order 2, of order 1, by history of order 0; of a second and a third try
    p2, p1 = np.full(lanes << 4, 1 << 14, np.int64), np.full(lanes << 4, 1 << 13, np.int64)
    ph, pb, pc = np.full(lanes << 4, 1 << 13, np.int64), np.full(lanes << 4, 1 << 13, np.int64), np.full(lanes << 4, 1 << 15, np.int64)
    weights = [np.full(lanes, 22_000, np.int64) for _ in range(3)]
    before1, before2, history = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    decoding = coder.decoding
    columns = np.ascontiguousarray(ids.T)
    for t in range(ids.shape[1]):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # lanes longer than t
        if not n:
            break
        if t % EPOCH == 0:
            np.cumsum(((slots & 63) + (slots > 0)).reshape(lanes, SLOTS), axis=1, out=cumulated[:, 1:])
        a1, a2 = before1[:n], before2[:n]
        at1 = row1[:n] + (a1 * 0x9E3779B1 >> 7 & ((1 << BITS1) - 1))
        at2 = row2[:n] + ((a1 * 0x85EBCA6B + a2 * 0xC2B2AE35) >> 9 & ((1 << BITS2) - 1))
        v1, v2 = next1.take(at1), next2.take(at2)
        g1, c1, g2, c2 = (v1 >> 4) - 1, v1 & 15, (v2 >> 4) - 1, v2 & 15
        guess = np.where(v2 > 0, g2, g1)
        hist = history[:n]
        true = None if decoding else columns[t, :n]
        out = np.full(n, -1, np.int64)
        # the candidate, in all lanes that have one
        some = np.nonzero(guess >= 0)[0]
        if len(some):
            full = len(some) == n
            of = (lambda x: x[:n]) if full else (lambda x: x[some])
            k = row16[:n] if full else row16[some]
            guessed = of(guess)
            k2 = k + np.where(of(v2) > 0, of(c2), 15)
            k1 = k + np.where(of(g1) == guessed, of(c1), 14)
            k0 = k + of(hist)
            q2, q1, q0 = p2.take(k2), p1.take(k1), ph.take(k0)
            s2, s1, s0 = STRETCH.take(q2 >> 4), STRETCH.take(q1 >> 4), STRETCH.take(q0 >> 4)
            w2, w1, w0 = (of(w) for w in weights)
            dot = (w2 * s2 + w1 * s1 + w0 * s0) >> 16
            p = SQUASH.take(dot + 2047, mode="clip")
            y = coder.bits(slice(0, n) if full else some, p, None if decoding else of(true) == guessed)
            error = (np.where(y, 4096, 0) - p) * 6
            at = slice(0, n) if full else some
            weights[0][at] = w2 + ((s2 * error) >> 10)
            weights[1][at] = w1 + ((s1 * error) >> 10)
            weights[2][at] = w0 + ((s0 * error) >> 10)
            _learn(p2, k2, q2, y)
            _learn(p1, k1, q1, y)
            _learn(ph, k0, q0, y)
            if full:
                out = np.where(y, guess, -1)
            else:
                out[some[y]] = guess[some[y]]
        # order 1, if it says another
        some = np.nonzero((out < 0) & (g1 >= 0) & (g1 != guess))[0]
        if len(some):
            k = row16[some] + c1[some]
            q = pb.take(k)
            y = coder.bits(some, np.maximum(q >> 4, 1), None if decoding else true[some] == g1[some])
            _learn(pb, k, q, y)
            hit = some[y]
            out[hit] = g1[hit]
        # order 0: the slots as they were at the last epoch's start
        some = np.nonzero(out < 0)[0]
        if len(some):
            past = hist[some]
            k = row16[some] + past
            q = pc.take(k)
            slot = known = None
            if not decoding:
                want = true[some]
                slot = want * 0x9E3779B1 >> 11 & (SLOTS - 1)
                c = rowc[some] + slot
                known = (slots.take(row0[some] + slot) >> 6 == want + 1) & (flat.take(c + 1) > flat.take(c))
            open_ = flat.take(rowc[some] + SLOTS) > 0
            y = coder.bits(some, np.where(open_, np.maximum(q >> 4, 1), 1), known)
            _learn(pc, k, q, y)
            hit, miss = some[y], some[~y]
            if len(hit):
                slot_of = coder.ranged(hit, cumulated, None if decoding else slot[y])
                out[hit] = (slots.take(row0[hit] + slot_of) >> 6) - 1
            if len(miss):
                out[miss] = coder.even(miss, vocabulary, None if decoding else true[miss])
            history[some] = (past << 1 | y) & 7
        # what was seen
        slot = out * 0x9E3779B1 >> 11 & (SLOTS - 1)
        at0, c = row0[:n] + slot, rowc[:n] + slot
        v0 = slots.take(at0)
        mine = v0 >> 6 == out + 1
        # a slot that order 0 can name in this epoch keeps its id until the epoch ends
        free = flat.take(c + 1) == flat.take(c)
        slots[at0] = np.where(mine, np.where((v0 & 63) < 59, v0 + 2, v0), np.where(free, (out + 1) << 6, v0))
        for table, at, v, g, c in ((next1, at1, v1, g1, c1), (next2, at2, v2, g2, c2)):
            table[at] = np.where(g == out, v + (c < 12), np.where(c < 2, (out + 1) << 4, v - c) + (c >> 1))
        before2[:n], before1[:n] = before1[:n], out
        if decoding:
            columns[t, :n] = out
    if decoding:
        ids[:] = columns.T
    return ids


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """ids: at most LANES * BLOCK of them.  Coded blocks, each with its header."""
    n = len(ids)
    lanes = max(1, -(-n // BLOCK))
    lengths = np.full(lanes, BLOCK, np.int64)
    lengths[-1] = n - BLOCK * (lanes - 1)
    grid = np.zeros((lanes, BLOCK), np.int64)
    grid.ravel()[:n] = ids
    coder = Coder(lanes)
    _run(coder, grid, lengths, vocabulary)
    raw = ids.astype("<u4")
    return [struct.pack("<III", lengths[i], len(p), zlib.crc32(raw[i * BLOCK : i * BLOCK + lengths[i]].tobytes())) + p for i, p in enumerate(coder.finish())]


def decode_blocks(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> list[np.ndarray]:
    """blocks: (ids, checksum, coded ids), in any order and number.  Raises ValueError on a block that doesn't match its checksum."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    lengths = np.array([blocks[i][0] for i in order], np.int64)
    grid = np.zeros((len(order), int(lengths.max(initial=0))), np.int64)
    _run(Coder(len(order), [blocks[i][2] for i in order]), grid, lengths, vocabulary)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    for row, i in enumerate(order):
        out[i] = grid[row, : blocks[i][0]].astype("<u4")
        if zlib.crc32(out[i].tobytes()) != blocks[i][1]:
            raise ValueError("a block doesn't match its checksum")
    return out
