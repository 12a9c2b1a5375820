import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import jpeg


def padded(text):
    data = (text or "").encode()
    return data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))


def test_edges_round_trip(edge, edge_texts):
    got = {r.doc_id: r for r in jpeg.read(jpeg.store(edge)).collect()}
    for i, t in enumerate(edge_texts):
        assert bytes(got[i].payload) == padded(t)
        assert got[i].n_bytes == len((t or "").encode())
        assert len(got[i].rgb) == got[i].width * got[i].height * 3
    assert bytes(got[5].media) == bytes(got[6].media)


def test_empty_table(nothing):
    assert jpeg.read(jpeg.store(nothing)).count() == 0


def test_many_sizes():
    rng = random.Random(1)
    for units in (1, 2, 3, 64, 65, 200):
        data = rng.randbytes(576 * units)
        planes, grid, noted, _ = jpeg.coefficients(jpeg.encode(data))
        assert jpeg.payload_of(planes, noted) == data


def test_inverse_transform_is_the_textbook_sum():
    rng = np.random.default_rng(2)
    c = rng.integers(-40, 40, 64)
    grid = np.zeros((8, 8))
    for k, place in enumerate(jpeg.ZIGZAG):
        grid[place // 8, place % 8] = c[k]
    a = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = np.array([[sum(0.25 * a(u) * a(v) * grid[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    assert np.allclose((c @ jpeg.INVERSE).reshape(8, 8), want)


def test_sparse_scans_with_runs_and_refinement():
    """Scans as other encoders write them: gaps, ends of bands over several blocks, new coefficients in a refinement."""
    want = np.zeros((3, 64), np.int64)
    want[0, 1], want[0, 20], want[2, 5] = 4, -6, 2
    table = {(2, 0): 0x01, (2, 1): 0xF0, (3, 4): 0x31, (3, 5): 0x02, (3, 6): 0x00, (4, 14): 0x10, (5, 30): 0x12, (6, 62): 0x21}
    code = {s: format(c, f"0{n}b") for (n, c), s in table.items()}
    # first pass without the lowest bit: 4 -> 2, -6 -> -3, 2 -> 1
    first = code[0x02] + "10" + code[0xF0] + code[0x21] + "0"
    out = np.zeros((3, 64), np.int64)
    bits = code[0x02] + "10" + code[0x00] + code[0x10] + "0"
    jpeg._ac_first(_bits(bits), table, out[:2], 1, 63, 1)
    assert out[0, 1] == 4 and not out[1].any()
    refine = code[0x31] + "1" + "0" + code[0x00]
    some = out[:1].copy()
    jpeg._ac_refine(_bits(refine), table, some, 1, 63, 0)
    assert some[0, 1] == 4 and some[0, 5] == 1 and first


def _bits(text):
    out = jpeg.Bits(b"")
    out.all = np.array([int(c) for c in text + "1" * 64], np.uint8)
    return out


def test_query_columns(edge, edge_texts):
    found = jpeg.read(jpeg.store(edge)).select("doc_id", F.sha2("payload", 256).alias("h"), F.crc32(F.substring("payload", -32, 32)).alias("c"))
    for r in found.collect():
        assert r.h == hashlib.sha256(padded(edge_texts[r.doc_id])).hexdigest()
        assert r.c == zlib.crc32(padded(edge_texts[r.doc_id])[-32:])


def test_pixels_by_the_formula():
    """Inverse transform, repeated chroma and colour conversion, sample by sample."""
    rng = np.random.default_rng(3)
    grid = (2, 1)
    planes = [rng.integers(-60, 60, (2 * h * v, 64)).astype(np.int64) for h, v in jpeg.SAMPLING]
    got = jpeg.rgb(planes, grid, [np.ones(64, np.int64)] * 3)
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0

    def sample(block, x, y):
        total = sum(c(z % 8) * c(z // 8) * block[n] * math.cos((2 * x + 1) * (z % 8) * math.pi / 16) * math.cos((2 * y + 1) * (z // 8) * math.pi / 16) for n, z in enumerate(zigzag))
        return min(255.0, max(0.0, total / 4 + 128))

    for px, py in ((0, 0), (7, 3), (8, 2), (15, 15), (16, 9), (31, 15)):
        luma = planes[0][(py // 8) * 4 + px // 8]
        y = sample(luma, px % 8, py % 8)
        cb, cr = (sample(planes[k][px // 16], px // 2 % 8, py // 2 % 8) - 128 for k in (1, 2))
        want = (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)
        assert all(abs(int(a) - min(255, max(0, b))) <= 1 for a, b in zip(got[py, px], want)), (px, py)


def test_lines_that_the_format_can_count():
    for units in (0, 1, 64, 65, 64 * 4095, 64 * 4095 + 1, 4095 * 4095):
        across, down = jpeg._grid(units)
        assert 16 * across < 65536 and 16 * down < 65536 and across * down >= units
