"""Simple-8b word-aligned coding of integer ids, with escapes and per-block offsets.

A 64-bit word holds a selector in its upper 4 bits and up to 60 bits of values, the first value lowest. Blocks hold
``BLOCK`` ids (the last one fewer) and start at a word of their own, so any block is decoded by itself; the ids that
a block's last word misses are padding. An id of 60 bits or more is an escape: its word (selector 0) holds the
number of its entry in a table of plain 64-bit values.

Layout of a shard, little-endian: magic, then as int64 the numbers part, shard, documents, ids, blocks, words,
escapes; then document ids (int64), their validity (uint8), ids per document (int64), block offsets in words
(int64, one more than blocks), words (uint64), escapes (uint64). What follows is ignored.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8BTOK01"
BLOCK = 1024
#: Values and bits a value, by selector: 0 is the escape, 15 a run of zeros.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
_NEAR = 5  # values that are looked at first; wider packings only where these are small
_HEADER = struct.Struct("<8s7q")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escapes) of non-negative ids; all blocks advance together, a word at each step."""
    ids = np.asarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    stride = BLOCK + int(COUNTS.max())
    grid = np.zeros((blocks, stride), np.uint64)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(ids) - BLOCK * (blocks - 1)
    grid[: blocks - 1, :BLOCK] = ids[: BLOCK * (blocks - 1)].reshape(-1, BLOCK)
    grid[-1, : lengths[-1]] = ids[BLOCK * (blocks - 1) :]
    flat = grid.reshape(-1)
    bits = _bit_lengths(flat)
    near = _near(bits)
    live, cursor = np.arange(blocks), np.zeros(blocks, np.int64)
    begun = np.zeros(len(flat), np.int8)  # at the first value of each word: its selector and 1
    while len(live):
        start = live * stride + cursor
        selector = near[start].astype(np.int64)
        more = np.flatnonzero(selector < 0)
        if len(more):
            selector[more] = _choose(bits, start[more])
        begun[start] = selector + 1
        cursor = cursor + COUNTS[selector]
        on = cursor < lengths[live]
        live, cursor = live[on], cursor[on]
    at = np.flatnonzero(begun)
    chosen = begun[at].astype(np.int64) - 1
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        rows, width = np.flatnonzero(chosen == selector), int(WIDTHS[selector])
        if width:
            start = at[rows]
            packed = flat[start]
            for k in range(1, int(COUNTS[selector])):
                packed |= flat[start + k] << np.uint64(width * k)
            words[rows] |= packed
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(at, np.arange(blocks + 1) * stride)
    return words, offsets.astype(np.int64), flat[at[escaped]]


def _widths_of(values: np.ndarray) -> np.ndarray:
    """The least width of any packing that holds each value; 64 where none does."""
    out = np.zeros(len(values), np.int8)
    for width in np.unique(WIDTHS[WIDTHS > 0]):
        out[(out == 0) & (values > 0) & (values < np.uint64(1 << int(width)))] = width
    out[(out == 0) & (values > 0)] = 64
    return out


#: Widths of the values that token ids have, looked up.
_USUAL = _widths_of(np.arange(1 << 18, dtype=np.uint64))


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < len(_USUAL):
        return _USUAL[values.astype(np.int64)]
    return _widths_of(values)


def _near(bits: np.ndarray) -> np.ndarray:
    """What ``_choose`` gives for a word at each place, where few values decide; -1 where more have to be looked at."""
    most, selector = bits.copy(), np.full(len(bits), 14, np.int8)
    for s in range(13, 7, -1):  # where more values fit, fewer do as well
        shift = int(COUNTS[s]) - 1
        np.maximum(most[: len(bits) - shift], bits[shift:], out=most[: len(bits) - shift])
        selector -= (most <= WIDTHS[s]).view(np.int8)
    selector[selector == 8] = -1
    selector[bits > WIDTHS[14]] = 0
    return selector


def _choose(bits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The selector with most values whose widths all hold, for a word that begins at each of ``start``."""
    most = np.maximum.accumulate(bits[start[:, None] + np.arange(_NEAR)], axis=1)
    selector = np.zeros(len(start), np.int64)
    for s in range(14, 9, -1):
        selector[most[:, COUNTS[s] - 1] <= WIDTHS[s]] = s
    # Ever fewer words go on to packings of more values.
    some, seen = np.arange(len(start)), _NEAR
    for more, packings in ((15, range(9, 3, -1)), (int(COUNTS.max()), (3, 2, 1, 15))):
        some = some[most[:, seen - 1] <= WIDTHS[packings[0]]]
        if not len(some):
            break
        most = np.maximum.accumulate(bits[start[some][:, None] + np.arange(more)], axis=1)
        seen = more
        for s in packings:
            selector[some[most[:, COUNTS[s] - 1] <= WIDTHS[s]]] = s
    return selector


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a shard, all words of a selector at once."""
    if not n:
        return np.empty(0, np.uint64)
    blocks = len(offsets) - 1
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selector])
    starts = ends - COUNTS[selector]
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    starts = starts - starts[offsets[block]]  # within the block
    stride = BLOCK + int(COUNTS.max())
    out = np.zeros(blocks * stride, np.uint64)
    place = block * stride + starts
    for s in np.unique(selector):
        rows, width = np.flatnonzero(selector == s), int(WIDTHS[s])
        if s == 0:
            out[place[rows]] = escapes[words[rows].astype(np.int64)]
        elif width:
            mask = np.uint64((1 << width) - 1)
            for k in range(int(COUNTS[s])):
                out[place[rows] + k] = (words[rows] >> np.uint64(width * k)) & mask
    return out.reshape(blocks, stride)[:, :BLOCK].reshape(-1)[:n]


def block_ids(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int) -> np.ndarray:
    """The ids of one block alone, found by its offset."""
    part = words[offsets[block] : offsets[block + 1]]
    return unpack(part, np.array([0, len(part)]), escapes, min(BLOCK, n - block * BLOCK))


def write_shard(part: int, shard: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    header = _HEADER.pack(MAGIC, part, shard, len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    return b"".join([header, numbers.tobytes(), known.tobytes(), np.asarray(lengths, np.int64).tobytes(), offsets.tobytes(), words.tobytes(), escapes.tobytes()])


def read_shard(data: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """(part, shard, document ids, ids per document, ids) of what ``write_shard`` gave."""
    magic, part, shard, docs, n, blocks, n_words, n_escapes = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = _HEADER.size
    fields = []
    for kind, count in ((np.int64, docs), (np.uint8, docs), (np.int64, docs), (np.int64, blocks + 1), (np.uint64, n_words), (np.uint64, n_escapes)):
        fields.append(np.frombuffer(data, kind, count, at))
        at += fields[-1].nbytes
    numbers, known, lengths, offsets, words, escapes = fields
    doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
    return part, shard, doc_ids, lengths, unpack(words, offsets, escapes, n)
