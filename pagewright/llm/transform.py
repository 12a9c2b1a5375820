"""The Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column through sequential files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow.fs import FileSystem

END = 255  # no UTF-8 byte: stands for the byte before a whole string
#: Suffixes of a file that are read at once.
BLOCK = 1 << 20
NONE = np.int64(1 << 40)
NO_PREFIX = np.uint8(255)
PAIR = np.dtype("<u2")  # symbol above, prefix below


class Files:
    """The transform and common prefixes as one file of pairs of bytes in `folder` (a URI that all machines can open); a round reads one and writes the next."""

    def __init__(self, folder: str) -> None:
        self.system, root = FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.root = f"{root}/{uuid.uuid4().hex}"
        self.made: set[str] = set()

    def name(self, turn: int) -> str:
        self.made.add(f"{self.root}-{turn % 2}")
        return f"{self.root}-{turn % 2}"

    def read(self, turn: int) -> Iterator[np.ndarray]:
        """Blocks of pairs (symbol, prefix), in order."""
        with self.system.open_input_stream(self.name(turn)) as stream:
            while data := stream.read(2 * BLOCK):
                yield np.frombuffer(data, PAIR)

    def write(self, turn: int, blocks: Iterator[np.ndarray]) -> None:
        with self.system.open_output_stream(self.name(turn)) as stream:
            for block in blocks:
                stream.write(block.tobytes())

    def remove(self) -> None:
        for name in self.made:
            self.system.delete_file(name)


def pairs(symbols: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    return symbols.astype(PAIR) << 8 | prefixes.astype(PAIR)


def _least(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[first[i]:stop[i]] for each i; no range is empty."""
    if not len(first):
        return np.zeros(0, np.int64)
    at = np.empty(2 * len(first), np.int64)
    at[::2], at[1::2] = first, stop
    return np.minimum.reduceat(np.append(values, NO_PREFIX), at)[::2].astype(np.int64)


class Least:
    """Least values from the start of an array to a place, and from a place to its end, by way of spans."""

    SPAN = 256

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.append(values, NO_PREFIX)
        spans = np.minimum.reduceat(values, np.arange(0, len(values), self.SPAN))
        self.before = np.append(NO_PREFIX, np.minimum.accumulate(spans))
        self.after = np.append(np.minimum.accumulate(spans[::-1])[::-1], NO_PREFIX)

    def until(self, place: np.ndarray) -> np.ndarray:
        """Of the values up to each place, that one included."""
        span = place // self.SPAN
        return np.minimum(self.before[span], _least(self.values, span * self.SPAN, place + 1))

    def since(self, place: np.ndarray) -> np.ndarray:
        """Of the values from each place on; the end has none."""
        span = place // self.SPAN
        stop = np.minimum((span + 1) * self.SPAN, len(self.values))
        return np.minimum(self.after[np.minimum(span + 1, len(self.after) - 1)], _least(self.values, place, stop))


def _places(files: Files, turn: int, heads: np.ndarray, symbols: np.ndarray, strings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the suffixes that grow from heads (positions, ascending) by symbols go in the order to come, the prefix each has in common with the one before
    it there, and with the one after it (-1: there is none that begins alike).

    One pass: behind smaller first symbols and, among equal ones, in the order of their heads. The neighbour that begins alike has grown from the
    nearest place before with the same symbol in the transform, so one more than the least common prefix from there to the head is shared."""
    rank, before, after = np.zeros(len(heads), np.int64), np.full(len(heads), NONE), np.full(len(heads), NONE)
    seen, carry = np.zeros(256, np.int64), np.full(256, NONE)  # occurrences so far, and the least prefix since the last one
    waiting, behind = np.full(256, -1), np.full(256, NONE)  # the last head of a symbol that has met no next one, and the least prefix since
    low = 0
    for block in files.read(turn):
        b, l = block.view(np.uint8)[1::2].copy(), block.view(np.uint8)[::2].copy()
        n = len(b)
        least = Least(l)
        order = np.argsort(b, kind="stable")
        count = np.bincount(b, minlength=256)
        start = np.concatenate([[0], np.cumsum(count)])
        there = np.flatnonzero(count)
        found = there[waiting[there] >= 0]
        after[waiting[found]] = np.minimum(behind[found], least.until(order[start[found]]))
        waiting[found] = -1
        behind = np.minimum(behind, least.after[0])
        i, j = np.searchsorted(heads, (low, low + n))
        q, c = heads[i:j] - low, symbols[i:j].astype(np.int64)
        at = np.empty(j - i, np.int64)
        by_symbol = np.argsort(symbols[i:j], kind="stable")
        for mine in np.split(by_symbol, np.flatnonzero(np.diff(c[by_symbol])) + 1):
            if len(mine):
                first = start[c[mine[0]]]
                at[mine] = first + np.searchsorted(order[first : start[c[mine[0]] + 1]], q[mine])
        rank[i:j] = seen[c] + at - start[c]
        has = at > start[c]
        before[i:j][has] = _least(l, order[at[has] - 1] + 1, q[has] + 1)
        rest = ~has & (seen[c] > 0)
        before[i:j][rest] = np.minimum(carry[c[rest]], least.until(q[rest]))
        more = at + 1 < start[c + 1]
        after[i:j][more] = _least(l, q[more] + 1, order[at[more] + 1] + 1)
        last = np.flatnonzero(~more)
        waiting[c[last]], behind[c[last]] = i + last, least.since(q[last] + 1)
        carry = np.minimum(carry, least.after[0])
        carry[there] = least.since(order[start[there + 1] - 1] + 1)
        seen += count
        low += n
    smaller = strings + np.concatenate([[0], np.cumsum(seen)])
    alike = lambda x: np.where(x < NONE, x + 1, -1)
    return smaller[symbols] + rank, np.maximum(alike(before), 0), alike(after)


def _merged(files: Files, turn: int, places: np.ndarray, new: np.ndarray, after: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The old file with new pairs put in at places (ascending, in the new order), and the prefix of each one's next suffix renewed."""
    fresh = np.ones(len(places), bool)
    fresh[:-1] = places[1:] != places[:-1] + 1
    fresh &= after >= 0
    changed, value = places[fresh] + 1, np.minimum(after[fresh], most).astype(PAIR)
    old = places - np.arange(len(places))  # the old suffix before which it goes
    low, done = 0, 0

    def one(block: np.ndarray, stop: int) -> np.ndarray:
        where = old[done:stop] - low + np.arange(stop - done)
        out, stay = np.empty(len(block) + stop - done, PAIR), np.ones(len(block) + stop - done, bool)
        stay[where] = False
        out[stay], out[where] = block, new[done:stop]
        i, j = np.searchsorted(changed, (low + done, low + done + len(out)))
        at = changed[i:j] - low - done
        out[at] = out[at] & 0xFF00 | value[i:j]
        return out

    for block in files.read(turn):
        stop = int(np.searchsorted(old, low + len(block)))
        yield one(block, stop)
        low, done = low + len(block), stop
    yield one(np.zeros(0, PAIR), len(places))


def collection(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, folder: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of the strings data[begins[i]:ends[i]], none of them empty, and the common prefix of each suffix and the one before it, up to `most`.

    Round by round every string puts in one symbol more: its suffix, one longer, takes its place among those there are. The files of a round are
    read twice and written once, in order; besides them there are a block and a few numbers for each string. As many rounds as the longest has
    symbols."""
    files = Files(folder)
    try:
        strings = len(begins)
        sizes = ends - begins
        files.write(0, iter([pairs(data[ends - 1], np.zeros(strings))]))
        heads, who = np.arange(strings), np.arange(strings)
        turn = 0
        for length in range(1, int(sizes.max(initial=0)) + 1):
            able = sizes[who] >= length
            heads, who = heads[able], who[able]
            whole = sizes[who] == length
            symbols = np.where(whole, END, data[np.maximum(ends[who] - length - 1, 0)]).astype(np.uint8)
            places, prefixes, after = _places(files, turn, heads, data[ends[who] - length], strings)
            order = np.argsort(places)
            heads, who = places[order], who[order]
            new = pairs(symbols[order], np.minimum(prefixes[order], most))
            files.write(turn + 1, _merged(files, turn, heads, new, after[order], most))
            turn += 1
        done = np.concatenate(list(files.read(turn))).view(np.uint8)
        return done[1::2].copy(), done[::2].copy()
    finally:
        files.remove()


def walked(bwt: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, strings, positions) of the strings' suffixes in the transform's order, from the shortest on: each step goes from a suffix to the one that its symbol
    in the transform makes."""
    strings = len(sizes)
    step = np.empty(len(bwt), np.int64)
    step[np.argsort(bwt, kind="stable")] = strings + np.arange(len(bwt))  # whole strings' END comes last and leads nowhere
    who, at = np.arange(strings), np.arange(strings)
    for length in range(1, int(sizes.max(initial=0)) + 1):
        able = sizes[who] >= length
        who = who[able]
        at = step[at[able]]
        yield length, who, at
