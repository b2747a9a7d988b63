"""Static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

One frequency table is shared by all blocks. A block holds up to ``LANES`` interleaved coder
states (64 bit, renormalised by 32-bit words); token i belongs to lane i mod LANES. Every
``CHECKPOINT`` steps the decoder's states and its place in the word stream are kept, so that
decoding can start there too. A checksum of the ids closes the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 512
CHECKPOINT = 128                 # steps, of LANES tokens each
SCALE_BITS = 20
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_SCALE = np.uint64(SCALE_BITS)
_SLOT = np.uint64((1 << SCALE_BITS) - 1)
MAGIC = b"RNS1"


class Table:
    """Frequencies scaled to 2^SCALE_BITS; every symbol that occurs keeps at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols = np.asarray(symbols, np.uint32)[order]
        counts = np.asarray(counts, np.float64)[order]
        total = 1 << SCALE_BITS
        if len(self.symbols) > total:
            raise ValueError("more symbols than slots")
        freq = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * total)).astype(np.int64)
        off = total - int(freq.sum())
        largest = np.argsort(-freq, kind="stable")
        if off > 0 and len(freq):
            freq[largest[0]] += off
        for i in largest:                             # frequencies raised to 1 are taken back
            if off >= 0:
                break
            back = min(-off, int(freq[i]) - 1)
            freq[i] -= back
            off += back
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.index = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, np.uint32)
        self.index[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block: header, checkpoints, words."""
    n = len(ids)
    lanes, steps = min(LANES, n), -(-n // LANES)
    x = np.full(lanes, _LOW, np.uint64)
    sym = table.index[ids]
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        s = sym[t * LANES:(t + 1) * LANES]
        f, c = table.freq[s], table.start[s]
        own = x[:len(s)]
        full = np.flatnonzero(own >= (f << np.uint64(63 - SCALE_BITS)))
        if len(full):
            words.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(full)
            own[full] >>= _32
        q = own // f
        own[:] = (q << _SCALE) + (own - q * f) + c
        if t % CHECKPOINT == 0:
            marks.append((written, x.copy()))
    payload = b"".join(w.tobytes() for w in reversed(words))
    head = MAGIC + struct.pack("<QIII", n, lanes, len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    body = b"".join(struct.pack("<Q", written - at) + state.astype("<u8").tobytes() for at, state in reversed(marks))
    return head + body + payload


def decode(block: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids from a checkpoint on; a whole block (checkpoint 0) is held against its checksum."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    n, lanes, marks, crc = struct.unpack_from("<QIII", block, 4)
    at = 24 + checkpoint * (8 + 8 * lanes)
    words = np.frombuffer(block, "<u4", offset=24 + marks * (8 + 8 * lanes)).astype(np.uint64)
    if n == 0:
        return np.zeros(0, np.uint32)
    pos = struct.unpack_from("<Q", block, at)[0]
    x = np.frombuffer(block, "<u8", lanes, at + 8).copy()
    first = checkpoint * CHECKPOINT * LANES
    out = np.empty(n - first, np.uint32)
    for a in range(0, n - first, LANES):
        own = x[:min(LANES, n - first - a)]
        slot = own & _SLOT
        s = table.slots[slot.astype(np.int64)]
        out[a:a + len(own)] = s
        own[:] = table.freq[s] * (own >> _SCALE) + slot - table.start[s]
        need = np.flatnonzero(own < _LOW)
        if len(need):
            own[need] = (own[need] << _32) | words[pos:pos + len(need)]
            pos += len(need)
    out = table.symbols[out]
    if (x != _LOW).any():                             # every lane must end where the encoder began
        raise ValueError("a block does not end in the coder's first state")
    if checkpoint == 0 and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not match")
    return out
