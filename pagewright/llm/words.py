"""Words and shingles of many texts at once, as 64-bit hashes (numpy; used inside Arrow-mapped tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the hash functions: arbitrary fixed values.
BASE, MIX_1, MIX_2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: A random 64-bit value for each byte.
BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words for license scans: digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse mod 2**64, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, by in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
                step = np.full(size, U(by))
                step[0] = 1
                _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without linear structure."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * MIX_1
        h = (h ^ (h >> U(29))) * MIX_2
        return h ^ (h >> U(32))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (one entry more, for the end)."""
    binary = texts.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of which inside[] holds, in byte positions of data, and the index of the first word of
    each text (one entry more). No run crosses from a text to the next."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = inside[data]
    turn = np.diff(flag)
    first = np.zeros(len(data) + 1, bool)
    first[np.flatnonzero(turn == 1)] = True
    last = np.zeros(len(data) + 1, bool)
    last[np.flatnonzero(turn == -1)] = True
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(flag[cut] == 1) & (flag[cut + 1] == 1)]
    first[cut] = True
    last[cut] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: sums of byte values times powers, so that all words are hashed by one running sum."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text, and where each text's shingles start (one entry more). Repeats stay.

    A text of fewer than k words has one shingle, of all its words; one without words has none."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    at = np.repeat(bounds[:-1] - begin[:-1], count) + np.arange(begin[-1])
    width = np.repeat(np.minimum(n, k), count)
    with np.errstate(over="ignore"):
        out = np.full(len(at), U(k) * MIX_2)
        padded = np.concatenate([hashes, np.zeros(k, U)])
        for i in range(k):
            out = np.where(i < width, mix(out * BASE + padded[at + i]), out)
    return out, begin


def text_shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct word-shingle hashes of each text: A-Z lower-cased, words parted by ASCII white space."""
    data, offsets = raw(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, ~SPACE)
    hashes, begin = shingles(word_hashes(data, starts, ends), bounds, k)
    return [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])]


def binary(rows: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(rows, pa.binary())


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
