import itertools

import numpy as np
import pytest

from pagewright.functions import raster


def test_kernels_on_flat_and_ramp():
    flat = np.full((13, 17, 3), 77, np.uint8)
    for kernel in raster.KERNELS:
        assert (raster.resized(flat, 31, 7, kernel) == 77).all() and (raster.resized(flat, 5, 29, kernel) == 77).all()
        assert raster.resized(flat, 17, 13, kernel) is flat
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (4, 1))
    wide = raster.resized(ramp, 40, 4, "linear")[0].astype(int)
    assert (np.diff(wide[1:-1]) == 5).all() or set(np.diff(wide[1:-1])) <= {4, 5, 6}
    assert raster.resized(flat, 0, 5).shape == (5, 0, 3)


def test_area_and_bins_are_means():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 10)).astype(np.uint8)
    half = raster.resized(image, 5, 3, "area")
    assert half.tolist() == raster.rounded(image.reshape(3, 3, 5, 2).mean(axis=(1, 3))).tolist()
    m = 4
    bins = raster.resized(image, 10, m, "bins")
    assert bins.tolist() == [raster.rounded(image[i * 9 // m : -(-(i + 1) * 9 // m)].mean(axis=0)).tolist() for i in range(m)]
    third = [sum(max(0, min((i + 1) * 2.25, r + 1) - max(i * 2.25, r)) * image[r].astype(float) for r in range(9)) / 2.25 for i in range(m)]
    assert np.abs(raster.resized(image, 10, m, "area") - np.array(third)).max() <= 0.51


@pytest.mark.parametrize("kernel,shape,reach", [("linear", lambda x: max(0, 1 - abs(x)), 1), ("cubic", lambda x: float(raster._cubic(np.array(x))), 2)])
def test_kernels_by_a_plain_loop(kernel, shape, reach):
    rng = np.random.default_rng(1)
    line = rng.integers(0, 256, (1, 11)).astype(np.uint8)
    for m in (5, 11, 23):
        want = []
        for i in range(m):
            c = (i + 0.5) * 11 / m - 0.5
            taps = range(int(np.floor(c - reach)) + 1, int(np.floor(c - reach)) + 1 + 2 * reach)
            want.append(sum(shape(k - c) * float(line[0, min(max(k, 0), 10)]) for k in taps) / sum(shape(k - c) for k in taps))
        assert np.abs(raster.resized(line, m, 1, kernel)[0] - np.clip(want, 0, 255)).max() <= 0.51


def plain_equalised(image, clip, tiles):
    """Tile by tile, pixel by pixel."""
    h, w = image.shape
    fits = h % tiles == 0 and w % tiles == 0
    th, tw = (h // tiles, w // tiles) if fits else (h // tiles + 1, w // tiles + 1)
    mirror = lambda i, n: i if i < n else 2 * n - 2 - i
    tables = {}
    for a, b in itertools.product(range(tiles), repeat=2):
        counts = [0] * 256
        for y, x in itertools.product(range(a * th, a * th + th), range(b * tw, b * tw + tw)):
            counts[image[mirror(y, h), mirror(x, w)]] += 1
        most = max(1, int(clip * th * tw / 256))
        cut = sum(max(0, c - most) for c in counts)
        counts = [min(c, most) + cut // 256 for c in counts]
        rest = cut % 256
        i = 0
        while i < 256 and rest > 0:
            counts[i] += 1
            rest -= 1
            i += max(256 // (cut % 256), 1)
        tables[a, b] = [round(min(255.0, sum(counts[: v + 1]) * 255 / (th * tw))) for v in range(256)]
    out = np.zeros((h, w))
    for y, x in itertools.product(range(h), range(w)):
        v, u = y / th - 0.5, x / tw - 0.5
        a, b = int(np.floor(v)), int(np.floor(u))
        keep = lambda i: min(max(i, 0), tiles - 1)
        t = [tables[keep(a + i), keep(b + j)][image[y, x]] for i in (0, 1) for j in (0, 1)]
        v, u = v - a, u - b
        out[y, x] = (t[0] * (1 - u) + t[1] * u) * (1 - v) + (t[2] * (1 - u) + t[3] * u) * v
    return out


@pytest.mark.parametrize("size", [(40, 48), (37, 50), (40, 50)])
def test_equalisation_by_a_plain_loop(size):
    rng = np.random.default_rng(2)
    image = np.clip(rng.normal(120, 12, size), 0, 255).astype(np.uint8)
    assert np.abs(raster.equalised(image, 2.0, 4) - plain_equalised(image, 2.0, 4)).max() <= 1.6  # two roundings


def test_enhancement_raises_contrast():
    rng = np.random.default_rng(3)
    page = np.full((120, 160, 3), 150, np.uint8)
    page[np.arange(120) // 6 % 2 == 0] = 130
    page = np.clip(page + rng.integers(-3, 4, page.shape), 0, 255).astype(np.uint8)
    better = raster.enhanced(page)
    assert better.shape == page.shape and (better[:, :, 0] == better[:, :, 2]).all()
    assert better.std() > 1.2 * raster.gray(page).std()
    assert raster.enhanced(np.full((1, 1, 3), 9, np.uint8)).shape == (1, 1, 3)


def flood(mask, diagonal):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            a, b = todo.pop()
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                if (diagonal or not dy * dx) and 0 <= a + dy < mask.shape[0] and 0 <= b + dx < mask.shape[1] and mask[a + dy, b + dx] and not label[a + dy, b + dx]:
                    label[a + dy, b + dx] = n
                    todo.append((a + dy, b + dx))
    return label, n


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_by_flood_fill(diagonal):
    rng = np.random.default_rng(4)
    for share in (0.0, 0.2, 0.4, 0.6, 1.0):
        mask = rng.random((23, 31)) < share
        got, n = raster.components(mask, diagonal)
        want, m = flood(mask, diagonal)
        assert n == m and ((got > 0) == mask).all()
        assert len(set(zip(got[mask].tolist(), want[mask].tolist()))) == n


def test_dilation_outline_and_rectangle():
    rng = np.random.default_rng(5)
    mask = rng.random((20, 25)) < 0.05
    wide = np.pad(mask, 2)
    assert (raster.dilated(mask, 5) == np.array([[wide[y : y + 5, x : x + 5].any() for x in range(25)] for y in range(20)])).all()
    ring = np.zeros((30, 40), bool)
    ring[5:25, 5:35] = True
    ring[8:20, 8:30] = False
    assert raster.outline_area(ring) == 19 * 29
    tilt = np.array([(0, 10), (10, 0), (30, 20), (20, 30), (15, 15)])
    corners = raster.smallest_rectangle(tilt)
    assert sorted(map(tuple, np.rint(corners).astype(int).tolist())) == [(0, 10), (10, 0), (20, 30), (30, 20)]
    cloud = rng.normal(size=(60, 2))
    area = lambda c: np.linalg.norm(c[1] - c[0]) * np.linalg.norm(c[2] - c[1])
    turns = []
    for a in np.linspace(0, np.pi / 2, 2000):
        r = cloud @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        turns.append(np.prod(r.max(0) - r.min(0)))
    assert area(raster.smallest_rectangle(cloud)) <= min(turns) + 1e-9
    assert raster.smallest_rectangle(np.array([(3, 4)])).tolist() == [[3, 4]] * 4


def test_largest_outline_of_a_page():
    image = np.full((120, 160, 3), 30, np.uint8)
    y, x = np.mgrid[0:120, 0:160]
    inside = (np.abs((x - 80) * 0.9 + (y - 60) * 0.3) < 50) & (np.abs((y - 60) * 0.9 - (x - 80) * 0.3) < 35)
    image[inside] = 220
    corners, area = raster.largest_outline(image)
    # sides of 2 * 50 and 2 * 35 in units of 1 / 0.949, each widened by four pixels of dilation
    assert area == pytest.approx((100 / 0.9487 + 8) * (70 / 0.9487 + 8), rel=0.05)
    centre = corners.mean(axis=0)
    assert np.abs(centre - (80, 60)).max() < 1.5
    assert raster.largest_outline(np.full((50, 50, 3), 9, np.uint8)) is None
    small = np.full((120, 160, 3), 30, np.uint8)
    small[10:30, 10:30] = 220
    assert raster.largest_outline(small) is None
