"""A range asymmetric numeral system over token ids: static tables, interleaved lanes, independent blocks.

A file image holds, little-endian:

    magic "TRA1", table bytes u32, table, blocks u32, then per block its size u32 and the block
    table   zlib: symbols u32, their ids u32[], their frequencies u16[] less one; frequencies sum to 65536
    block   documents u32, tokens u32, lanes u32, steps u32, stride u32, checksum of the ids u32, words u32,
            zlib size u32 and zlib of document ids i64[] with null flags u8[] and token counts u32[],
            per checkpoint: first word u32 and one state u32 per lane, then words u16[], then the checksum
            of everything before it in the block, u32

Token k of a block belongs to step k // lanes and lane k % lanes; the last step is padded with the first
token.  A checkpoint stands before every `stride` steps, so stretches between checkpoints decode apart
from each other; here they advance together as further lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TRA1"
BITS = 16
TOTAL = 1 << BITS
LOW = np.uint64(1 << 16)
LANES = 2048
STRIDE = 256


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least one that sum to TOTAL, near the shares of the counts (all above zero)."""
    if len(counts) > TOTAL:
        raise ValueError("more distinct ids than the table has room for")
    share = counts / counts.sum() * TOTAL
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    while (over := int(freq.sum()) - TOTAL) > 0:
        room = freq - 1
        cut = np.minimum(room, -(-over * room // room.sum()))
        order = np.argsort(-cut, kind="stable")
        taken = np.minimum(cut[order], np.maximum(0, over - (np.cumsum(cut[order]) - cut[order])))
        freq[order] -= taken
    freq[np.argmax(share)] += TOTAL - int(freq.sum())
    return freq


class Table:
    """Frequencies of the symbols of a file, shared by its blocks."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.number = np.zeros(int(self.symbols.max()) + 1, dtype=np.int64)
        self.number[self.symbols] = np.arange(len(symbols))

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, quantise(counts[symbols]))

    def pack(self) -> bytes:
        raw = struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + (self.freq - np.uint64(1)).astype("<u2").tobytes()
        return zlib.compress(raw)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", raw)
        return cls(np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<u2", n, 4 + 4 * n).astype(np.uint64) + np.uint64(1))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def encode_block(table: Table, ids: np.ndarray, docs: list[int | None], sizes: np.ndarray, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block of whole documents; `sizes` are their token counts."""
    lanes = max(1, min(lanes, len(ids) // 32))  # few tokens: few lanes, whose states cost four bytes each
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, ids[0] if len(ids) else 0, dtype=np.uint32)
    grid[: len(ids)] = ids
    symbol = table.number[grid].reshape(steps, lanes)
    ratio = table.freq.astype(np.float64)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.zeros(0, dtype=np.uint16)] * steps
    states: dict[int, np.ndarray] = {}
    shift = np.uint64(16)
    freqs, starts, ratios = table.freq[symbol], table.start[symbol], ratio[symbol]
    limits = freqs << shift
    for t in range(steps - 1, -1, -1):
        over = x >= limits[t]
        words[t] = x[over].astype(np.uint16)
        x >>= over.astype(np.uint64) << np.uint64(4)
        # exact in doubles: a quotient below 2^32 is at least 2^-16 away from the next whole number
        quotient = (x / ratios[t]).astype(np.uint64)
        x += quotient * (np.uint64(TOTAL) - freqs[t]) + starts[t]
        if t % stride == 0:
            states[t] = x.astype(np.uint32)
    first = np.cumsum([0, *(len(w) for w in words)])
    stream = np.concatenate(words) if words else np.zeros(0, dtype=np.uint16)
    names = np.array([d or 0 for d in docs], dtype="<i8").tobytes() + bytes(d is None for d in docs) + np.asarray(sizes, dtype="<u4").tobytes()
    names = zlib.compress(names)
    head = struct.pack("<8I", len(docs), len(ids), lanes, steps, stride, _crc(ids), len(stream), len(names)) + names
    marks = b"".join(struct.pack("<I", first[t]) + states[t].astype("<u4").tobytes() for t in sorted(states))
    body = head + marks + stream.astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(table: Table, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token counts, ids); raises ValueError where a checksum disagrees."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block")
    n_docs, n, lanes, steps, stride, crc, n_words, n_names = struct.unpack_from("<8I", data)
    raw = zlib.decompress(data[32: 32 + n_names])
    names, null = np.frombuffer(raw, "<i8", n_docs), raw[8 * n_docs: 9 * n_docs]
    docs = [None if null[k] else int(names[k]) for k in range(n_docs)]
    sizes = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs)
    parts = -(-steps // stride)
    marks = np.frombuffer(data, "<u4", parts * (lanes + 1), 32 + n_names).reshape(parts, lanes + 1)
    stream = np.frombuffer(data, "<u2", n_words, 32 + n_names + marks.nbytes).astype(np.uint64)
    of_slot = np.repeat(np.arange(len(table.freq)), table.freq.astype(np.int64))
    out = np.zeros((parts, stride, lanes), dtype=np.int64)
    at, x = marks[:, 0].astype(np.int64), marks[:, 1:].astype(np.uint64)
    mask, shift = np.uint64(TOTAL - 1), np.uint64(16)
    for k in range(min(stride, steps)):
        if k == steps - (parts - 1) * stride and parts > 1:  # the last stretch may be shorter
            at, x = at[:-1], x[:-1]
        slot = x & mask
        symbol = of_slot[slot.astype(np.int64)]
        out[: len(x), k] = symbol
        x = table.freq[symbol] * (x >> shift) + slot - table.start[symbol]
        low = x < LOW
        need = low.sum(axis=1)
        if need.any():
            rank = np.cumsum(low, axis=1) - 1
            x[low] = (x[low] << shift) | stream[(at[:, None] + rank)[low]]
            at = at + need
    ids = table.symbols[out.reshape(-1)[: n]] if n else np.zeros(0, dtype=np.uint32)
    if _crc(ids) != crc:
        raise ValueError("decoded ids differ from their checksum")
    return docs, sizes, ids


def pack_file(ids: np.ndarray, docs: list[int | None], sizes: np.ndarray, block_tokens: int) -> bytes:
    """A file image of whole documents.  A block ends with the document that reaches `block_tokens`."""
    table = Table.of(ids) if len(ids) else Table(np.zeros(1), np.array([TOTAL]))
    ends = np.cumsum(sizes, dtype=np.int64)
    blocks, first = [], 0
    while first < len(docs):
        begin = int(ends[first - 1]) if first else 0
        last = min(int(np.searchsorted(ends, begin + block_tokens)), len(docs) - 1)
        blocks.append(encode_block(table, ids[begin: ends[last]], docs[first: last + 1], sizes[first: last + 1]))
        first = last + 1
    head = table.pack()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, struct.pack("<I", len(blocks)),
                     *(struct.pack("<I", len(b)) + b for b in blocks)])


def unpack_file(data: bytes):
    """Yields (document ids, token counts, ids) of each block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", data, 4)
    table, at = Table.unpack(data[8: 8 + n]), 8 + n
    (blocks,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(blocks):
        (size,) = struct.unpack_from("<I", data, at)
        yield decode_block(table, data[at + 4: at + 4 + size])
        at += 4 + size
