"""Secret scan: base patterns, and a conditional random field over tokens that adds what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import documents, text_chunks
from .words import LOWER, mix, word_hashes, word_spans

KINDS = ("assign", "access", "hex")
#: The method's own kind, after the base kinds in order.
FOUND = "crf"
#: Fixed patterns. assign is matched in lower-cased bytes, so it needs no capitals; hex, access and assign need so many characters (assign: its value).
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Classes of bytes in a token: digits, a-f, g-z, A-F, G-Z, signs, everything outside ASCII.
CLASSES = np.zeros(256, np.uint8)
for _bit, _bytes in enumerate((b"0123456789", b"abcdef", bytes(range(0x67, 0x7B)), b"ABCDEF", bytes(range(0x47, 0x5B)), b"+/_.~-", bytes(range(0x80, 0x100)))):
    CLASSES[list(_bytes)] = 1 << _bit
HEX = (CLASSES == 1) | (CLASSES == 2)
#: Upper ends of the classes of token lengths and of changes between digits and others in a token.
LENGTHS = np.array([1, 2, 3, 4, 5, 7, 9, 12, 15, 19, 23, 31, 39, 63])
CHANGES = np.array([0, 1, 3, 7])
WORDS = 1 << 12
SHAPES = 128 * (len(LENGTHS) + 1) * (len(CHANGES) + 1)
#: Values of each group of features: the token's shape, the shapes before and after it, its characters and changes alone, the word, two words before it,
#: the word after it, the signs between it and the token before, the sign after it, the file.
SIZES = [SHAPES, SHAPES, SHAPES, 128 * (len(CHANGES) + 1), WORDS, WORDS, WORDS, WORDS, 1 << 14, 128, 64]
LEXICAL = (4, 5, 6, 7)
#: Tokens on each side of a window that the model is fitted on; texts, chosen by hash, that windows are taken from, windows a text, and windows in all,
#: of each kind: with a secret in the middle, and without.
REACH = 8
FIT_TEXTS, A_TEXT, WINDOWS = 20_000, (8, 4), (2_000, 4_000)
#: An unlabelled token of so many characters with digits and letters may be a secret: no window around it is taken as free of secrets.
UNSURE = 16
CHUNK = 2 << 20
SLICE = crf.BLOCK << 11


class Scan:
    """Tokens and base spans of a chunk of texts. Positions are those of data, the texts' bytes with a byte 0 after each."""

    def __init__(self, texts: pa.Array) -> None:
        joined = b"\0".join([*texts.cast(pa.large_binary()).to_pylist(), b""])
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts.cast(pa.large_binary()).to_pylist()], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        lower = LOWER[self.data]
        self.base = [(0, m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(lower.tobytes()) if m.end(1) - m.start(1) >= LEAST_VALUE]
        self.base += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(joined) if m.end() - m.start() >= LEAST_ACCESS]
        a, b, _ = word_spans(self.data, self.offsets, HEX)
        long = b - a >= LEAST_HEX
        self.base += [(2, i, j, i) for i, j in zip(a[long].tolist(), b[long].tolist())]
        self.starts, self.ends, self.bounds = word_spans(self.data, self.offsets, CLASSES > 0)
        self.words = word_hashes(lower, self.starts, self.ends)
        self._describe()

    def _describe(self) -> None:
        data, n = self.data, len(self.starts)
        opens = np.zeros(n + 1, bool)
        opens[self.bounds[:-1]] = True
        self.opens = opens[:n]
        kinds = CLASSES[data]
        if n:
            self.bits = np.bitwise_or.reduceat(kinds, self.starts).astype(np.int64)
            digit = kinds == 1
            turn = np.zeros(len(data), np.int32)
            turn[1:] = (digit[1:] != digit[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
            self.turns = np.searchsorted(CHANGES, np.add.reduceat(turn, self.starts))
        else:
            self.bits = self.turns = np.zeros(0, np.int64)
        self.length = np.searchsorted(LENGTHS, self.ends - self.starts)
        self.shape = (self.bits * (len(LENGTHS) + 1) + self.length) * (len(CHANGES) + 1) + self.turns
        self.hashed = (self.words % np.uint64(WORDS - 1)).astype(np.int64) + 1
        blank = (data == 32) | (data == 9)
        place = np.arange(len(data), dtype=np.int64)
        sign_before = np.maximum.accumulate(np.where(blank, -1, place)) if len(data) else place
        sign_after = np.minimum.accumulate(np.where(blank, len(data), place)[::-1])[::-1] if len(data) else place
        value = lambda at, inside: np.where(inside, np.append(data, 0)[at] & 127, 0).astype(np.int64)
        prior = np.where(self.opens, self.offsets[np.searchsorted(self.bounds, np.arange(n), "right") - 1], np.append(0, self.ends[:-1]))
        near, far = np.append(sign_before, -1)[self.starts - 1], np.append(sign_after, len(data))[prior]
        self.between = value(far, (far < self.starts)) * 128 + value(near, (near >= prior))
        next_sign = np.append(sign_after, len(data))[self.ends]
        self.after = value(next_sign, next_sign < np.append(self.starts[1:], len(data)))
        self.file = self._files()

    def _files(self) -> np.ndarray:
        """For each text: its size (8 classes), its share of signs of code (4) and of digits (2)."""
        sizes = np.diff(self.offsets)
        code = np.zeros(256, np.int32)
        code[list(b"{}[]()<>=;:\"'_|#$")] = 1
        counted = lambda flag: np.add.reduceat(np.append(flag, 0), self.offsets[:-1]) if len(sizes) else np.zeros(0, np.int64)
        signs, digits = counted(code[self.data]) / sizes, counted((CLASSES[self.data] == 1).astype(np.int32)) / sizes
        size = np.minimum(np.log2(sizes) // 2, 7).astype(np.int64)
        return size * 8 + np.searchsorted([0.01, 0.03, 0.08], signs, "right") * 2 + (digits > 0.05)

    def features(self, low: int, high: int) -> list[np.ndarray]:
        """The values of each group for tokens low to high."""
        at = np.arange(low, high)
        doc = np.searchsorted(self.bounds, at, "right") - 1
        first, end = self.bounds[doc], self.bounds[doc + 1]

        def beside(values: np.ndarray, by: int) -> np.ndarray:
            inside = (at + by >= first) & (at + by < end)
            return np.where(inside, values[np.clip(at + by, 0, len(values) - 1)], 0)

        return [
            self.shape[low:high], beside(self.shape, -1), beside(self.shape, 1), self.bits[low:high] * (len(CHANGES) + 1) + self.turns[low:high],
            self.hashed[low:high], beside(self.hashed, -1), beside(self.hashed, -2), beside(self.hashed, 1), self.between[low:high], self.after[low:high], self.file[doc],
        ]

    def labels(self) -> np.ndarray:
        """The labels that the base spans give: of assign the value alone."""
        out = np.zeros(len(self.starts), np.int64)
        for _, _, end, value in sorted(self.base, key=lambda s: s[3]):
            a, b = np.searchsorted(self.ends, value, "right"), np.searchsorted(self.starts, end)
            if a < b and not out[a:b].any():
                out[a:b] = crf.I
                out[a] = crf.B
        return out

    def added(self, model: crf.Model) -> list[tuple[int, int, int, int]]:
        """Spans of the tokens that the model tags, where no base span is."""
        chain = crf.Chain(model)
        for low in range(0, len(self.starts), SLICE):
            high = min(low + SLICE, len(self.starts))
            chain.add(model.emissions(self.features(low, high)), self.opens[low:high])
        tags = chain.labels()
        first = np.flatnonzero(tags == crf.B)
        outside = np.flatnonzero(np.append(tags != crf.I, True))
        last = outside[np.searchsorted(outside, first, "right")] - 1
        starts, ends = self.starts[first], self.ends[last]
        ends = ends - np.array([len(t) - len(t.rstrip(b".")) for t in (self.data[a:b].tobytes() for a, b in zip(starts, ends))], np.int64).reshape(len(ends))
        covered = np.zeros(len(self.data) + 1, np.int32)
        for _, a, b, _ in self.base:
            covered[a] += 1
            covered[b] -= 1
        taken = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
        free = (taken[ends] == taken[starts]) & (ends > starts)
        return [(len(KINDS), a, b, a) for a, b in zip(starts[free].tolist(), ends[free].tolist())]

    def points(self, at: np.ndarray) -> np.ndarray:
        """Places in data as code points of their text."""
        before = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return before[at] - before[self.offsets[np.searchsorted(self.offsets, at, "right") - 1]]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of tokens, with a secret in the middle or without any, some of each text by hash."""
    for (texts,) in text_chunks(batches, CHUNK):
        scan = Scan(texts)
        n, labels = len(scan.starts), scan.labels()
        if not n:
            continue
        doc = np.repeat(np.arange(len(texts)), np.diff(scan.bounds))
        unsure = (labels == crf.O) & (scan.ends - scan.starts >= UNSURE) & ((scan.bits & 1) > 0) & ((scan.bits & 0b11110) > 0)
        near = np.concatenate([[0], np.cumsum(unsure | (labels != crf.O))])
        at = np.arange(n)
        clear = near[np.minimum(at + REACH + 1, n)] == near[np.maximum(at - REACH, 0)]
        key = mix(scan.words + at.astype(np.uint64))
        for kind, there in enumerate((labels == crf.B, clear)):
            some = np.flatnonzero(there)
            some = some[np.lexsort((key[some], doc[some]))]
            rank = np.arange(len(some)) - np.searchsorted(doc[some], doc[some])
            some = some[rank < A_TEXT[kind]]
            if not len(some):
                continue
            place = some[:, None] + np.arange(-REACH, REACH + 1)
            inside = (place >= scan.bounds[doc[some]][:, None]) & (place < scan.bounds[doc[some] + 1][:, None])
            place = np.clip(place, 0, n - 1)
            values = np.stack([f[place] for f in scan.features(0, n)], axis=2)
            marks = np.where(inside, labels[place], -1)
            content = mix((np.where(inside, scan.words[place], np.uint64(0)) * (np.arange(2 * REACH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(axis=1))
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.full(len(some), kind, np.int32)), "key": pa.array(content.view(np.int64)),
                "features": pa.array(values.reshape(len(some), -1).tolist(), pa.list_(pa.int32())), "labels": pa.array(marks.tolist(), pa.list_(pa.int32())),
            })


def fit(docs: DataFrame) -> crf.Model | None:
    """The model of docs(text): labels are what the base patterns match. None without any match.

    Fitted on a bounded sample: windows of up to FIT_TEXTS texts, the smallest WINDOWS of each kind by hash of their words, whatever the rows' order. Each window
    counts twice, once without its words, so that shapes and signs carry weight of their own."""
    rows = docs.count()
    texts = docs.select("text")
    if rows > FIT_TEXTS:
        chance = F.shiftrightunsigned(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), 11)
        texts = docs.where(chance < int(FIT_TEXTS / rows * (1 << 53))).select("text")
    found = texts.mapInArrow(_windows, "kind int, key long, features array<int>, labels array<int>").dropDuplicates(["kind", "key"])
    taken = [found.where(F.col("kind") == k).orderBy("key").limit(n) for k, n in enumerate(WINDOWS)]
    sample = sorted(taken[0].unionByName(taken[1]).collect(), key=lambda r: (r["kind"], r["key"]))
    if not sample or sample[0]["kind"]:
        return None
    values = np.array([r["features"] for r in sample]).reshape(len(sample), 2 * REACH + 1, len(SIZES))
    bare = values.copy()
    bare[:, :, LEXICAL] = 0
    labels = np.array([r["labels"] for r in sample])
    return crf.fit(np.concatenate([values, bare]), np.concatenate([labels, labels]), SIZES)


SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"


def secret_spans(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """doc_id, spans (array of start, rank, end, kind, value) of every row of docs(doc_id, text): base spans, and those that the model adds outside them
    (kind `crf`), by start, then kind. Offsets are code points, end exclusive.

    Null or empty text: no spans. Every token of every text is tagged, in one chain a text. Repeated rows get the same spans each. Other columns are
    ignored. Without a model there are base spans only. Empty table: no rows."""
    names = (*KINDS, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, CHUNK):
            scan = Scan(texts)
            spans = scan.base + (scan.added(model) if model else [])
            kinds, starts, ends = (np.array([s[i] for s in spans], np.int64) for i in range(3))
            order = np.lexsort((ends, kinds, starts))
            kinds, starts, ends = kinds[order], starts[order], ends[order]
            data = scan.data
            rows = pa.StructArray.from_arrays([
                pa.array(scan.points(starts)), pa.array(kinds.astype(np.int32)), pa.array(scan.points(ends)), pa.array([names[k] for k in kinds], pa.string()),
                pa.array([data[a:b].tobytes().decode() for a, b in zip(starts, ends)], pa.string()),
            ], ["start", "rank", "end", "kind", "value"])
            bounds = pa.array(np.searchsorted(starts, scan.offsets), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(bounds, rows)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def op13_secret_crf(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, as strings and counts."""
    docs = documents(spark, sf_dir)
    found = secret_spans(docs, fit(docs))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
