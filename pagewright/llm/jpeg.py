"""Progressive JPEG as a media column: payload bytes as quantised coefficients, read back scan by scan, inverted, upsampled, kept as RGB."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts, written

UNIT = 576
#: A payload byte b is the coefficient b + 256: all coefficients have 9 bits, none is 0.
SHIFT = 256
#: Units of 16 x 16 pixels in a row, as long as the rows are no more than MOST: the format counts up to 65,535 lines.
ACROSS, MOST = 64, 4095
SAMPLING = ((2, 2), (1, 1), (1, 1))  # luma, two chromas
#: Fixed values of the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
CODES = {"dc": [(s, 4) for s in range(9)], "first": [(0x08, 1)], "refine": [(0x00, 1)]}
#: Spectral bands of the first pass, by component.
BANDS = (((1, 9), (10, 63)), ((1, 63),), ((1, 63),))


def _inverse() -> np.ndarray:
    """64 zigzag coefficients to 64 pixels, in rows."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 1 / 2)[None, :]
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return full[ZIGZAG]


INVERSE = _inverse()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _huffman(kind: int, number: int, codes: list[tuple[int, int]]) -> bytes:
    counts = bytes(sum(n == length for _, n in codes) for length in range(1, 17))
    return _segment(0xC4, bytes([kind << 4 | number]) + counts + bytes(s for s, _ in codes))


def _entropy(bits: np.ndarray) -> bytes:
    """Bits as bytes, ended by ones, a zero byte after each FF."""
    if fill := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(fill, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(parts: list[tuple[int, int, int]], start: int, end: int, high: int, low: int, bits: np.ndarray) -> bytes:
    head = bytes([len(parts), *(x for c, dc, ac in parts for x in (c + 1, dc << 4 | ac)), start, end, high << 4 | low])
    return _segment(0xDA, head) + _entropy(bits)


def _grid(units: int) -> tuple[int, int]:
    across = max(min(max(units, 1), ACROSS), -(-units // MOST))
    return across, -(-units // across)


def _by_unit(plane: np.ndarray, across: int, down: int, c: int) -> np.ndarray:
    """Blocks of component c (rows of blocks) as (units, blocks of a unit)."""
    h, v = SAMPLING[c]
    return plane.reshape(down, v, across, h).transpose(0, 2, 1, 3).reshape(across * down, v * h)


def _from_unit(rows: np.ndarray, across: int, down: int, c: int) -> np.ndarray:
    h, v = SAMPLING[c]
    return rows.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(-1)


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose quantised coefficients are the payload's bytes, in the order luma, chroma, chroma by block rows."""
    units = -(-len(payload) // 384)
    across, down = _grid(units)
    values = np.full(across * down * 384, 255, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = np.split(values.reshape(-1, 64), np.cumsum([across * down * h * v for h, v in SAMPLING])[:-1])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + parts))
    out += [_huffman(0, 0, CODES["dc"]), _huffman(1, 0, CODES["first"]), _huffman(1, 1, CODES["refine"])]
    # mean coefficients without their lowest bit, as differences
    every = [(c, 0, 0) for c in range(3)]
    dc = [_by_unit(b[:, 0].astype(np.int64) + SHIFT, across, down, c) for c, b in enumerate(blocks)]
    steps = np.concatenate([np.diff((d >> 1).reshape(-1), prepend=0).reshape(d.shape) for d in dc], axis=1).reshape(-1)
    size = np.ceil(np.log2(np.abs(steps) + 1)).astype(np.int64)
    word = (size << size) | np.where(steps < 0, steps + (1 << size) - 1, steps)
    length = size + 4
    end = np.cumsum(length)
    shift = np.repeat(end, length) - 1 - np.arange(end[-1])
    out.append(_scan(every, 0, 0, 0, 1, ((np.repeat(word, length) >> shift) & 1).astype(np.uint8)))
    # bands without their lowest bit: code 0, then the 8 bits of (b + 256) >> 1
    for c, bands in enumerate(BANDS):
        for a, b in bands:
            coded = np.zeros((len(blocks[c]) * (b - a + 1), 9), np.uint8)
            coded[:, 1:] = np.unpackbits(((blocks[c][:, a : b + 1] >> 1) | 128).reshape(-1, 1), axis=1)
            out.append(_scan([(c, 0, 0)], a, b, 0, 1, coded.reshape(-1)))
    # the lowest bits
    out.append(_scan(every, 0, 0, 1, 0, (np.concatenate(dc, axis=1) & 1).astype(np.uint8).reshape(-1)))
    for c in range(3):
        coded = blocks[c] & 1
        coded[:, 0] = 0  # the code of "no new coefficients in this block"
        out.append(_scan([(c, 0, 1)], 1, 63, 1, 0, coded.reshape(-1)))
    return b"".join([*out, b"\xff\xd9"])


class Bits:
    """Reads a scan's bits in order."""

    def __init__(self, data: bytes):
        self.all = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.all[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.get((n, code))) is not None:
                return found
        raise ValueError("no such code")


def _signed(value: int, size: int) -> int:
    return value if size and value >> (size - 1) else value - (1 << size) + 1


def _dc_first(bits: Bits, table: dict, n: int) -> np.ndarray:
    """n differences: the code and value at every bit place at once, then the chain of places that are used."""
    b = np.concatenate([bits.all, np.ones(32, np.uint8)]).astype(np.int64)
    window = np.zeros(len(b) - 31, np.int64)
    for i in range(28):
        window = window << 1 | b[i : i + len(window)]
    size = np.full(len(window), -1)
    length = np.zeros(len(window), np.int64)
    for (k, code), s in table.items():
        hit = window >> (28 - k) == code
        size[hit], length[hit] = s, k
    step = (length + np.maximum(size, 0)).tolist()
    places, at = [], 0
    for _ in range(n):
        places.append(at)
        at += step[at]
    p = np.array(places)
    size, length = size[p], length[p]
    if (size < 0).any():
        raise ValueError("no such code")
    value = (window[p] >> (28 - length - size)) & ((1 << size) - 1)
    return np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value) * (size > 0)


def _ac_first(bits: Bits, table: dict, blocks: np.ndarray, a: int, b: int, low: int) -> None:
    if len(table) == 1:  # one symbol with a value and no gap: all coefficients have the same width
        ((n, code), s), width = next(iter(table.items())), b - a + 1
        if s and s < 16:
            rows = bits.all[: blocks.shape[0] * width * (n + s)].reshape(-1, n + s)
            if n == 1 and s == 8 and code == 0 and not rows[:, 0].any():
                value = np.packbits(rows[:, 1:], axis=1).reshape(-1, width).astype(np.int64)
                blocks[:, a : b + 1] = np.where(value < 128, value - 255, value) << low
                return
    run = 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = a
        while k <= b:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                block[k] = _signed(bits.take(size), size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + bits.take(zeros)
                break


def _ac_refine(bits: Bits, table: dict, blocks: np.ndarray, a: int, b: int, low: int) -> None:
    if table == {(1, 0): 0}:  # no new coefficients anywhere
        some = blocks[:, a : b + 1] != 0
        if some.all():
            rows = bits.all[: len(blocks) * (b - a + 2)].reshape(len(blocks), -1)
            if not rows[:, 0].any():
                more = rows[:, 1:].astype(np.int64) << low
                blocks[:, a : b + 1] += np.where(blocks[:, a : b + 1] > 0, more, -more)
                return
    run = 0
    for block in blocks:
        k = a
        while not run and k <= b:
            s = bits.symbol(table)
            zeros, new = s >> 4, 0
            if s & 15:
                new = (1 if bits.take(1) else -1) << low
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= b:
                if block[k]:
                    if bits.take(1):
                        block[k] += (1 if block[k] > 0 else -1) << low
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for i in range(k, b + 1):
                if block[i] and bits.take(1):
                    block[i] += (1 if block[i] > 0 else -1) << low
            run -= 1


SCAN_END = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def coefficients(media: bytes) -> tuple[list[np.ndarray], tuple[int, int], int | None, list[np.ndarray]]:
    """The coefficients of each component in zigzag order (whole units, block rows), units across and down, the payload's length if it is
    noted, and each component's quantisation. All scans are added up, whatever their order, bands and bits; no restart markers."""
    at, noted, grid, planes, tables, quant, of = 2, None, (0, 0), [], {}, {}, []
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        n = struct.unpack(">H", media[at + 2 : at + 4])[0]
        body = media[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFE and body.startswith(b"payload "):
            noted = int(body[8:])
        elif marker == 0xDB:
            for i in range(0, len(body), 65):
                quant[body[i]] = np.frombuffer(body[i + 1 : i + 65], np.uint8).astype(np.int64)
        elif marker == 0xC2:
            _, height, width, count = struct.unpack(">BHHB", body[:6])
            found = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(count))
            if found != SAMPLING:
                raise ValueError(f"sampling {found}: only 4:2:0 is read")
            grid = (-(-width // 16), -(-height // 16))
            planes = [np.zeros((grid[0] * grid[1] * h * v, 64), np.int64) for h, v in found]
            of = [body[8 + 3 * i] for i in range(count)]
        elif marker == 0xC4:
            while body:
                counts, code, table, i = body[1:17], 0, {}, 17
                for length, k in enumerate(counts, 1):
                    for _ in range(k):
                        table[length, code] = body[i]
                        code, i = code + 1, i + 1
                    code <<= 1
                tables[body[0] >> 4, body[0] & 15] = table
                body = body[i:]
        elif marker == 0xDA:
            parts = [(body[1 + 2 * i] - 1, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            a, b, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            end = SCAN_END.search(media, at)
            bits = Bits(media[at : end.start()])
            at = end.start()
            if a == 0:
                split = np.cumsum([SAMPLING[c][0] * SAMPLING[c][1] for c, _, _ in parts])[:-1]
                if high:
                    n = sum(len(planes[c]) for c, _, _ in parts)
                    for (c, _, _), rows in zip(parts, np.split(bits.all[:n].reshape(grid[0] * grid[1], -1), split, axis=1)):
                        planes[c][:, 0] |= _from_unit(rows.astype(np.int64), *grid, c) << low
                else:
                    steps = _dc_first(bits, tables[0, parts[0][1]], sum(len(planes[c]) for c, _, _ in parts)).reshape(grid[0] * grid[1], -1)
                    for (c, _, _), rows in zip(parts, np.split(steps, split, axis=1)):
                        planes[c][:, 0] = _from_unit(np.cumsum(rows.reshape(-1)), *grid, c) << low
            else:
                c, _, ac = parts[0]
                (_ac_refine if high else _ac_first)(bits, tables[1, ac], planes[c], a, b, low)
    return planes, grid, noted, [quant[q] for q in of]


def rgb(planes: list[np.ndarray], grid: tuple[int, int], quant: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3 bytes: inverse transform, chroma repeated to full resolution, colour conversion."""
    full = []
    for (h, v), blocks, q in zip(SAMPLING, planes, quant):
        pixels = np.clip((blocks * q).astype(np.float64) @ INVERSE + 128, 0, 255)
        plane = pixels.reshape(grid[1] * v, grid[0] * h, 8, 8).transpose(0, 2, 1, 3).reshape(grid[1] * v * 8, grid[0] * h * 8).astype(np.float32)
        full.append(np.repeat(np.repeat(plane, 2 // v, axis=0), 2 // h, axis=1) if (h, v) != (2, 2) else plane)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(plane), 0, 255)
    return out


def payload_of(planes: list[np.ndarray], noted: int) -> bytes:
    return (np.concatenate([p.reshape(-1) for p in planes]) - SHIFT).astype(np.uint8)[:noted].tobytes()


MEDIA = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, width int, height int, rgb binary, payload binary"


def _store_batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    data = texts.cast(pa.large_binary()).to_pylist()
    media = [encode(t + b"\xff" * ((-len(t)) % UNIT or (0 if t else UNIT))) for t in data]
    return pa.RecordBatch.from_pydict({"doc_id": ids, "n_bytes": pa.array([len(t) for t in data], pa.int64()), "media": pa.array(media, pa.binary())})


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text of docs(doc_id, text) as a progressive JPEG of its bytes, filled with 255 to a multiple of UNIT.

    Null and empty texts: one UNIT of 255. Repeated rows: each. Other columns are ignored. Empty table: no rows."""
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), _store_batch, MEDIA)


def read(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) with width, height, rgb (full-resolution bytes by row, pixel, channel) and the payload read back."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = {k: [] for k in ("width", "height", "rgb", "payload")}
                for data in part.column("media").to_pylist():
                    planes, grid, noted, quant = coefficients(data)
                    image = rgb(planes, grid, quant)
                    for k, v in (("width", image.shape[1]), ("height", image.shape[0]), ("rgb", image.tobytes()), ("payload", payload_of(planes, noted))):
                        out[k].append(v)
                kinds = {"width": pa.int32(), "height": pa.int32(), "rgb": pa.binary(), "payload": pa.binary()}
                yield pa.RecordBatch.from_pydict({**{n: part.column(n) for n in ("doc_id", "n_bytes", "media")}, **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    return media.mapInArrow(run, READ)


def op1_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    """Every document as a stored image, and what is read back from the table of images."""
    found = read(written(store(documents(spark, sf_dir)), "media", compression="zstd"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height", F.lit(3)), F.hex(F.crc32("rgb"))).alias("feature"),
    )
