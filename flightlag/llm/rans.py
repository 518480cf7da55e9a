"""Static range asymmetric numeral system: interleaved lanes, checkpoints, checksums."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Frequencies of a table sum up to two to this power.
SCALE = 20
#: States lie from LOW up to LOW << 32; what leaves a state is 32 bits.
LOW = 1 << 31
LANES = 1024
#: A checkpoint is kept after so many steps of all lanes.
CHECKPOINT_STEPS = 128
MAGIC = b"RNS1"
HEADER = "<4sIIIIIII"


class CorruptBlock(ValueError):
    pass


@dataclass(frozen=True)
class Table:
    """A shared frequency table: symbols in order, and how many of 2**SCALE slots each has."""

    symbols: np.ndarray
    slots: np.ndarray

    @classmethod
    def from_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Each symbol that occurs gets a slot at least, the rest is in proportion."""
        order = np.argsort(symbols, kind="stable")
        symbols, counts = np.asarray(symbols)[order].astype(np.uint32), np.asarray(counts)[order].astype(np.float64)
        total = 1 << SCALE
        if len(symbols) > total:
            raise ValueError("more symbols than slots")
        if not len(symbols):
            return cls(symbols, np.zeros(0, np.uint64))
        exact = 1 + counts / counts.sum() * (total - len(symbols))
        slots = np.floor(exact).astype(np.int64)
        # What rounding left over goes to the largest remainders, ties by symbol.
        short = total - int(slots.sum())
        slots[np.lexsort((symbols, slots - exact))[:short]] += 1
        return cls(symbols, slots.astype(np.uint64))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.slots)[:-1]]).astype(np.uint64) if len(self.slots) else self.slots

    @cached_property
    def of_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.slots.astype(np.int64))

    @cached_property
    def place(self) -> np.ndarray:
        """Symbol to its number in the table."""
        place = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        return place

    @cached_property
    def checksum(self) -> int:
        return zlib.crc32(self.slots.tobytes(), zlib.crc32(self.symbols.tobytes()))


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
    """One block. Lane i codes every ``lanes``-th symbol from i on; all lanes share one stream."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    index = table.place[ids]
    slots, starts = table.slots[index], table.starts[index]
    limit = slots << np.uint64(63 - SCALE)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words, kept = [], {}
    low32, half, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min((step + 1) * lanes, n)
        x, f = state[: b - a], slots[a:b]
        full = x >= limit[a:b]
        words.append((x[full] & low32).astype(np.uint32))
        x = np.where(full, x >> half, x)
        q = x // f
        state[: b - a] = (q << scale) + (x - q * f) + starts[a:b]
        if step and step % every == 0:
            kept[step] = state.copy()
    words.reverse()
    before = np.cumsum([0] + [len(w) for w in words])
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    marks = sorted(kept)
    head = struct.pack(HEADER, MAGIC, n, lanes, every, len(marks), len(stream), table.checksum, zlib.crc32(ids.astype("<u4").tobytes()))
    body = [head, state.astype("<u8").tobytes()]
    for step in marks:
        body += [struct.pack("<I", int(before[step])), kept[step].astype("<u8").tobytes()]
    body.append(stream.astype("<u4").tobytes())
    packed = b"".join(body)
    return packed + struct.pack("<I", zlib.crc32(packed))


class Block:
    """A block read back; its segments can be decoded each on its own."""

    def __init__(self, packed: bytes, table: Table):
        self.table = table
        size = struct.calcsize(HEADER)
        if len(packed) < size + 4 or struct.unpack("<I", packed[-4:])[0] != zlib.crc32(memoryview(packed)[:-4]):
            raise CorruptBlock("the checksum of the block differs")
        magic, self.n, self.lanes, self.every, marks, length, of_table, self.ids_crc32 = struct.unpack_from(HEADER, packed)
        if magic != MAGIC or of_table != table.checksum:
            raise CorruptBlock("not a block of this table")
        raw = memoryview(packed)
        self.states, self.at = [np.frombuffer(raw, "<u8", self.lanes, size)], [0]
        size += 8 * self.lanes
        for _ in range(marks):
            self.at.append(struct.unpack_from("<I", packed, size)[0])
            self.states.append(np.frombuffer(raw, "<u8", self.lanes, size + 4))
            size += 4 + 8 * self.lanes
        self.stream = np.frombuffer(raw, "<u4", length, size)

    @property
    def segments(self) -> int:
        return len(self.states)

    def segment(self, k: int) -> np.ndarray:
        """Symbols from checkpoint ``k`` to the next, from its states and place in the stream."""
        first = k * self.every
        steps = -(-self.n // self.lanes)
        last = min(first + self.every, steps) if k + 1 < self.segments else steps
        out = np.empty(min(last * self.lanes, self.n) - first * self.lanes, np.uint32)
        state, at = self.states[k].astype(np.uint64), self.at[k]
        slots, starts, of_slot = self.table.slots, self.table.starts, self.table.of_slot
        mask, half, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE), np.uint64(LOW)
        for step in range(first, last):
            a, b = (step - first) * self.lanes, min((step - first + 1) * self.lanes, len(out))
            x = state[: b - a]
            slot = x & mask
            index = of_slot[slot]
            out[a:b] = index
            x = slots[index] * (x >> scale) + slot - starts[index]
            short = np.flatnonzero(x < low)
            x[short] = (x[short] << half) | self.stream[at : at + len(short)]
            at += len(short)
            state[: b - a] = x
        return self.table.symbols[out]

    def decode(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.uint32)
        ids = np.concatenate([self.segment(k) for k in range(self.segments)])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.ids_crc32:
            raise CorruptBlock("the checksum of the symbols differs")
        return ids
