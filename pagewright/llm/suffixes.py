"""Exact removal of repeated 100-byte strings: anchored pieces, and a column-wise multi-document Burrows-Wheeler transform of those that differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts, remove, shared_uri, text_chunks, written
from .transform import collection, walked
from .words import BASE, BYTES, MIX_1, U, mix, powers, raw

#: Length of the strings that may not repeat, and of the grams whose smallest hash anchors each of them.
WINDOW, GRAM = 100, 24
#: Places of the anchor in a string, 0 to 76, that fall into one band: strings of an anchor and a band have a core of 62 or 63 bytes in common.
BAND = 39
#: Pieces of a task are compared before they are shuffled once so many bytes of text are read.
HELD_BYTES = 32 << 20
#: A core with more different pieces than a task should hold is split: its strings become pieces of their own, each dealt by its own bytes.
SPLIT = 20_000
#: Bytes of pieces in one collection.
COLLECTION = 8 << 20
#: A buffer position takes 24 bits beside 40 bits of hash.
SEGMENT = 1 << 23
LEAST_DOC = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on, by doubling: 1, 2, 4, 8, 16, then 16 + 8."""
    with np.errstate(over="ignore"):
        h, step = BYTES[data], BASE
        held = {1: h}
        for n in (1, 2, 4, 8):
            h = held[n]
            held[2 * n] = h[: len(h) - n] * step + h[n:]
            step = step * step * MIX_1
        h = held[16]
        return mix(h[: len(h) - 8] * step + held[8][16:])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def pieces(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every WINDOW of every text belongs to the piece of consecutive windows with the same anchor (leftmost smallest gram hash) in the same band.

    text: index; start: of the first window in its text; windows: how many; core: hash of the bytes that all windows of that anchor and band share.
    Equal windows have equal anchors at the same place, so they lie in pieces of one core."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "windows", "core")}
    for low in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
        part = data[low : low + SEGMENT + WINDOW - 1]
        n = len(part) - WINDOW + 1
        turn = np.zeros(n + 1, np.int32)
        full = np.diff(offsets) >= WINDOW
        np.add.at(turn, np.clip(offsets[:-1][full] - low, 0, n), 1)
        np.add.at(turn, np.clip(offsets[1:][full] - WINDOW + 1 - low, 0, n), -1)
        whole = np.cumsum(turn[:-1]) > 0
        grams = gram_hashes(part)
        place = np.arange(len(grams), dtype=np.uint64)
        smallest = sliding_min((grams & ~U((1 << 24) - 1)) | place, WINDOW - GRAM + 1)
        anchor = (smallest & U((1 << 24) - 1)).astype(np.int64)
        band = (anchor - np.arange(n)) // BAND
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1]) | ~whole[:-1]
        first = np.flatnonzero(change & whole)
        stop = np.ones(n, bool)
        stop[:-1] = change[1:] | ~whole[1:]
        last = np.flatnonzero(stop & whole)
        at, b = anchor[first], band[first]
        # of windows whose anchor stands b * BAND to b * BAND + BAND - 1 (76 at most) after their start
        begin, end = at - b * BAND, at - np.minimum(b * BAND + BAND - 1, WINDOW - GRAM) + WINDOW
        up, down = powers(len(grams) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(grams) + 1, U)
            np.cumsum(grams * up[: len(grams)], out=sums[1:])
            core = mix((sums[end - GRAM + 1] - sums[begin]) * down[begin] + b.astype(U))
        text = np.searchsorted(offsets, first + low, "right") - 1
        for k, v in (("text", text), ("start", first + low - offsets[text]), ("windows", last - first + 1), ("core", core)):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit cryptographic digests of data[begins[i]:ends[i]], as rows of two longs: equal ones stand for equal bytes."""
    view, hashed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    return np.frombuffer(b"".join([hashed(view[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)


#: doc and tie name a document: its id, and a digest of its text where ids may be null or repeated (0 else).
PLACES = "kind int, core long, d1 long, d2 long, doc long, tie long, place long"
WIDTH = 8  # bits of `place` for the number of windows
KEYS = ("core", "d1", "d2", "doc", "tie", "place")


def _emit(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(columns[0]), kind, np.int32)), **{k: pa.array(c) for k, c in zip(KEYS, columns)}})


def _settle(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by core, digest and place, and which rows in that order come after another place of their digest."""
    order = np.lexsort(columns[::-1])
    core, d1, d2, doc, tie, place = (c[order] for c in columns)
    again = np.zeros(len(order), bool)
    same = (core[1:] == core[:-1]) & (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
    again[1:] = same
    twin = np.zeros(len(order), bool)
    twin[1:] = same & (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (place[1:] == place[:-1])
    return order[~twin], again[~twin]


REPEAT, OPEN = 0, 1


def _ties(texts: pa.Array, told: bool) -> np.ndarray:
    """What tells texts of one id apart: digests if `told`, else 0."""
    if not told:
        return np.zeros(len(texts), np.int64)
    data, offsets = raw(texts)
    return np.ascontiguousarray(digests(data, offsets[:-1], offsets[1:])[:, 0])


def _pieces_of(batches: Iterator[pa.RecordBatch], told: bool) -> Iterator[pa.RecordBatch]:
    """The task's pieces; those that repeat an earlier one of the same task are settled here (REPEAT), so a hot piece leaves a task once."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held)]
        order, again = _settle(*columns)
        for kind, rows in ((REPEAT, order[again]), (OPEN, order[~again])):
            for i in range(0, len(rows), 100_000):
                yield _emit(kind, *(c[rows[i : i + 100_000]] for c in columns))

    for ids, texts in text_chunks(batches):
        data, offsets = raw(texts)
        p = pieces(data, offsets)
        doc = ids.to_numpy(zero_copy_only=False)[p["text"]] if len(p["text"]) else np.zeros(0, np.int64)
        tie = _ties(texts, told)[p["text"]] if len(p["text"]) else np.zeros(0, np.int64)
        begins = p["start"] + offsets[p["text"]] if len(p["text"]) else np.zeros(0, np.int64)
        d = digests(data, begins, begins + p["windows"] - 1 + WINDOW)
        held.append((p["core"].view(np.int64), d[:, 0], d[:, 1], doc.astype(np.int64), tie, (p["start"] << WIDTH) | p["windows"]))
        size += len(data)
        if size >= HELD_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of kind, core, digest, doc, place: the settled ones as they are, REPEAT rows for all but a digest's first place, and OPEN rows for the
    firsts of those cores that have several digests. Nothing but the last row is kept from batch to batch."""
    last, waiting, shown = None, None, False
    for batch in batches:
        settled = batch.column("kind").to_numpy() == REPEAT
        if settled.any():
            yield batch.filter(pa.array(settled))
            batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in KEYS]
        prior = [np.concatenate([[c[0] if last is None else v], c[:-1]]) for c, v in zip(cols, last or [0] * len(cols))]
        core, d1, d2, doc, tie, place = (a == b for a, b in zip(cols, prior))
        same = core & d1 & d2
        twin = same & doc & tie & place
        if last is None:
            same[0] = twin[0] = False
        last = [c[-1] for c in cols]
        again = np.flatnonzero(same & ~twin)
        if len(again):
            yield _emit(REPEAT, *[c[again] for c in cols])
        fresh = np.flatnonzero(~same)
        if not len(fresh):
            continue
        heads = [c[fresh] for c in cols]
        if waiting is not None:
            heads = [np.concatenate([[w], h]) for w, h in zip(waiting, heads)]
        next_too = heads[0][1:] == heads[0][:-1]
        several = np.append(next_too, False) | np.append(False, next_too)
        one = len(several) == 1 and shown
        if waiting is not None and shown:
            several[0] = False
        if several.any():
            yield _emit(OPEN, *[h[several] for h in heads])
        waiting = [h[-1] for h in heads]
        shown = bool(several[-1]) or one


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the open pieces of each text; those of split cores as a piece for each window, dealt by its digest."""

    def record(rows: list[tuple]) -> pa.RecordBatch:
        names = ("split", *KEYS, "bytes")
        kinds = (pa.bool_(), *(pa.int64(),) * len(KEYS), pa.binary())
        return pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, zip(*rows), kinds)})

    rows: list[tuple] = []
    for batch in batches:
        for doc, tie, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "packed", "wanted"))):
            text = _unpack(packed)
            for w in wanted:
                start, n = w["place"] >> WIDTH, w["place"] & ((1 << WIDTH) - 1)
                if not w["split"]:
                    rows.append((False, w["core"], 0, 0, doc, tie, w["place"], text[start : start + n - 1 + WINDOW]))
                else:
                    begins = np.arange(start, start + n)
                    for s, (d1, d2) in zip(begins.tolist(), digests(np.frombuffer(text, np.uint8), begins, begins + WINDOW).tolist()):
                        rows.append((True, d1, d1, d2, doc, tie, (s << WIDTH) | 1, None))
                if len(rows) > 20_000:
                    yield record(rows)
                    rows = []
    if rows:
        yield record(rows)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, zstandard.frame_content_size(packed))) if packed else b""


def repeated_windows(doc: np.ndarray, start: np.ndarray, contents: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of the windows in contents (pieces of texts, from start on) whose bytes also occur at an earlier place in contents: suffixes that have
    WINDOW bytes in common stand beside each other in the collection's transform."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum([len(c) for c in contents])
    sizes = np.diff(ends, prepend=0)
    bwt, common = collection(data, ends - sizes, ends, folder, WINDOW)
    alike = common >= WINDOW
    member = alike | np.append(alike[1:], False)
    group = np.cumsum(~alike)
    found = []
    for length, who, at in walked(bwt, sizes):
        if length >= WINDOW:
            mine = member[at]
            found.append((group[at[mine]], doc[who[mine]], start[who[mine]] + sizes[who[mine]] - length))
    g, d, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((s, d, g))
    g, d, s = g[order], d[order], s[order]
    later = np.zeros(len(g), bool)
    later[1:] = g[1:] == g[:-1]
    # the same place may lie in two pieces only if the row repeats; it is not earlier than itself
    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(g))))
    later &= (d != d[first]) | (s != s[first])
    return d[later], s[later]


def _collections(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over contents in order of cores: collections of whole cores of about COLLECTION bytes."""
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            doc, tie, place, contents = zip(*held)
            known, who = np.unique(np.array([doc, tie], np.int64), axis=1, return_inverse=True)  # in order of doc, then tie
            d, s = repeated_windows(who.ravel(), np.array(place, np.int64) >> WIDTH, list(contents), folder)
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            keep = np.ones(len(d), bool)
            keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            d, s = d[keep], s[keep]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1) | (np.arange(1, len(d)) % 64 == 0)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(d)))
            zero = np.zeros(len(at), np.int64)
            return _emit(REPEAT, zero, zero, zero, known[0, d[at]], known[1, d[at]], (s[at] << WIDTH) | n)

        for batch in batches:
            for core, *where, content in zip(*(batch.column(c).to_pylist() for c in ("core", "doc", "tie", "place", "bytes"))):
                if size >= COLLECTION and core != last:
                    yield flush()
                    held.clear()
                    size = 0
                held.append((*where, content))
                size += len(content)
                last = core
        if held:
            yield flush()

    return run


def _packed(told: bool):
    def run(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        data = [press.compress(t) if t else b"" for t in texts.cast(pa.large_binary()).to_pylist()]
        return pa.RecordBatch.from_pydict({"doc": ids, "tie": pa.array(_ties(texts, told)), "packed": pa.array(data, pa.binary())})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc", "n_bytes", "n_removed", "n_spans", "kept")}
        for doc, packed, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "places"))):
            text = _unpack(packed)
            kept, removed, spans = text, 0, 0
            if places:
                at = np.sort(np.array(places, np.int64))
                start, stop = at >> WIDTH, (at >> WIDTH) + (at & ((1 << WIDTH) - 1)) - 1 + WINDOW
                reach = np.maximum.accumulate(stop)
                cut = np.concatenate([[True], start[1:] > reach[:-1]])
                lo, hi = start[cut], np.concatenate([reach[np.flatnonzero(cut)[1:] - 1], reach[-1:]])
                spans, removed, parts, prior = len(lo), int((hi - lo).sum()), [], 0
                for a, b in zip(lo.tolist(), hi.tolist()):
                    parts.append(text[prior:a])
                    prior = b
                kept = b"".join([*parts, text[prior:]])
            for k, v in (("doc", doc), ("n_bytes", len(text)), ("n_removed", removed), ("n_spans", spans), ("kept", kept)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})


def _settled(found: DataFrame) -> DataFrame:
    """found(PLACES) with equal digests settled, dealt by core and digest; what is settled already needs no key and is dealt evenly."""
    deal = F.when(F.col("kind") == REPEAT, F.xxhash64("doc", "tie", "place")).otherwise(F.col("core"))
    return found.withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("kind", *KEYS).mapInArrow(_later, PLACES)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row of docs(doc_id, text): without the bytes covered by a WINDOW-byte string
    that also starts earlier (smaller doc_id, or earlier in the document).

    1. Texts are cut into pieces by anchors (content-defined), so that equal strings meet under one core. Pieces go to their core; all but the first of
       equal pieces (128-bit digests of their bytes) are repeats, and a piece without a different one of its core is done.
    2. Different pieces of one core form collections: column by column, each puts its strings' symbols into the transform and the common prefixes
       (transform.collection, through files in the shared folder), and strings of WINDOW bytes that stand together there are repeats. The strings of
       a core with over SPLIT different pieces are dealt by their own digests first, so that only different ones are left.
    3. The repeats of a document are cut out.

    Null or empty text: 0 bytes. Repeated rows (same doc_id and text) count as one document, and each gets its result. Rows of one doc_id with different
    texts are documents of their own, in order of the texts' digests; so are those without doc_id, which come before all others. The digests travel only
    where an id is null or repeated, which changes no result. Texts under WINDOW bytes stay whole. Empty table: no rows."""
    mine = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_DOC)).alias("doc"), "text")
    told = not mine.groupBy("doc").count().where((F.col("count") > 1) | (F.col("doc") == LEAST_DOC)).isEmpty()
    settled = written(_settled(mine.mapInArrow(lambda batches: _pieces_of(batches, told), PLACES)), "pieces")
    still = settled.where(F.col("kind") == OPEN).select("core", "doc", "tie", "place")
    large = still.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("core", F.lit(True).alias("split"))
    wanted = still.join(large, "core", "left").groupBy("doc", "tie").agg(F.collect_set(F.struct("core", "place", F.coalesce("split", F.lit(False)).alias("split"))).alias("wanted"))
    packed = map_texts(mine, _packed(told), "doc long, tie long, packed binary", ("doc", "text"))
    contents = written(packed.join(wanted, ["doc", "tie"]).mapInArrow(_cut, f"split boolean, {PLACES.removeprefix('kind int, ')}, bytes binary"), "contents")
    folder = shared_uri(docs.sparkSession, "transform")
    whole = contents.where("not split").repartition("core").sortWithinPartitions("core", "doc", "tie", "place").mapInArrow(_collections(folder), PLACES)
    whole = written(whole, "repeats")
    remove(docs.sparkSession, folder)
    single = _settled(contents.where("split").select(F.lit(OPEN).alias("kind"), *KEYS))
    repeats = settled.where(F.col("kind") == REPEAT).unionByName(whole).unionByName(single)
    covers = repeats.groupBy("doc", "tie").agg(F.collect_list("place").alias("places"))
    out = packed.join(covers, ["doc", "tie"], "left").mapInArrow(_kept, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc") != LEAST_DOC, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op10_column_bwt_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
