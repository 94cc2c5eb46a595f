"""Vectorised scanning of a batch of texts into words and word hashes.

A whole Arrow batch is scanned at once over its UTF-8 buffer, so no Python
code runs per word.  Words are maximal runs of bytes other than the blank and
0x09-0x0D; as all separators are ASCII, byte-wise scanning never cuts a
character.  Hashes are 64-bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a batch, in text order.

    data: the batch's UTF-8 bytes (lower-cased if asked for); offsets: where
    each document's bytes begin (one more than documents); starts, ends: byte
    ranges of the words in data; first: index of each document's first word
    (one more than documents); hashes: 64-bit hash of each word.
    """

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes without a copy, and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(texts: pa.Array, lower: bool = True) -> Words:
    """Split every text of the batch into words and hash them."""
    raw, offsets = text_bytes(texts)
    data = _LOWER[raw] if lower else raw
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_BLANK[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word that runs across the border of two documents is two words.
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    cut = inner[(inside[inner] == 1) & (inside[inner + 1] == 1)] if len(inner) else inner
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, first, _hash_spans(data, starts, ends))


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash byte ranges, eight bytes a step over the ranges that are still long enough."""
    n = ends - starts
    out = n.astype(np.uint64) * _BASE
    if not len(n):
        return out
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    masks = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    live, at, left = None, starts, n
    while True:
        chunk = words[at]
        short = left < 8
        chunk = np.where(short, chunk & masks[np.where(short, left, 0)], chunk)
        if live is None:
            out = mix(out ^ chunk) * _BASE
        else:
            out[live] = mix(out[live] ^ chunk) * _BASE
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(out)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words; one hash of the whole sequence if there are fewer, none of no words."""
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        h = np.array([len(hashes)], dtype=np.uint64)
        for k in range(len(hashes)):
            h = mix(h * _BASE ^ hashes[k : k + 1])
        return h
    m = len(hashes) - n + 1
    out = np.full(m, np.uint64(n))
    for k in range(n):
        out = mix(out * _BASE ^ hashes[k : k + m])
    return out


def shingle_sets(words: Words, n: int):
    """For each document its sorted distinct shingle hashes."""
    counts = np.diff(words.first)
    whole = np.full(max(len(words.hashes) - n + 1, 0), np.uint64(n))
    for k in range(n):
        whole = mix(whole * _BASE ^ words.hashes[k : k + len(whole)])
    for i, c in enumerate(counts):
        a = words.first[i]
        if c >= n:
            yield sorted_distinct(whole[a : a + c - n + 1])
        else:
            yield shingle_hashes(words.hashes[a : a + c], n)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    v = np.sort(values)
    if len(v) < 2:
        return v
    keep = np.empty(len(v), dtype=bool)
    keep[0] = True
    np.not_equal(v[1:], v[:-1], out=keep[1:])
    return v[keep]
