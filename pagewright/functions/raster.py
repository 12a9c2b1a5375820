"""Images as numpy arrays (height, width, channels; bytes): gray values, resampling, enhancement, edges, components and the rectangle of the largest outline.

Everything here works on one image; pixels.py maps it over tables of images in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Fixed weights of red, green and blue in 2**14 parts.
GRAY = np.array([4899, 9617, 1868])
#: Fixed steps of the enhancement: clip of the tiles' histograms, tiles a side, width of the blur, shares of the image and of its blur.
CLIP, TILES, SIGMA, SHARP = 1.5, 8, 1.0, (1.15, -0.15)
#: Fixed steps of the outline: blur, gradients of weak and sure edges, side of the dilation and how often.
BLUR, WEAK, SURE, DILATION, TIMES = np.array([1, 4, 6, 4, 1]) / 16, 50, 150, 5, 2


def gray(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int32) @ GRAY + (1 << 13)) >> 14).astype(np.uint8)


# --- resampling: each output place is a weighted sum of taps along an axis


def _area(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each output interval of n / m that input pixels cover."""
    size = n / m
    low = np.arange(m) * size
    at = np.floor(low + 1e-9).astype(int)[:, None] + np.arange(int(np.ceil(size)) + 1)
    share = np.minimum(low[:, None] + size, at + 1) - np.maximum(low[:, None], at)
    return at, np.maximum(share, 0)


def _bins(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Plain means of all the pixels that an output interval touches."""
    low, high = np.arange(m) * n // m, -(-(np.arange(m) + 1) * n // m)
    at = low[:, None] + np.arange(int((high - low).max()))
    return at, (at < high[:, None]).astype(float)


def _kernel(shape: Callable[[np.ndarray], np.ndarray], reach: float, widen: bool) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """Weights by distance from the output pixel's centre; widen: over as many pixels as one output pixel takes when the image shrinks."""

    def taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        wide = max(1.0, n / m) if widen else 1.0
        centre = (np.arange(m) + 0.5) * (n / m) - 0.5
        at = np.floor(centre - reach * wide).astype(int)[:, None] + 1 + np.arange(int(np.ceil(2 * reach * wide)))
        weights = shape((at - centre[:, None]) / wide)
        return at, np.where((at >= 0) & (at < n), weights, 0) if widen else weights

    return taps


def _cubic(x: np.ndarray, a: float = -0.75) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * a - 4 * a, 0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


KERNELS = {
    "area": _area, "bins": _bins, "linear": _kernel(lambda x: np.maximum(0, 1 - np.abs(x)), 1, False),
    "cubic": _kernel(_cubic, 2, False), "lanczos": _kernel(_lanczos, 3, True),
}


@lru_cache(64)
def _taps(kernel: str, n: int, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and weights of each tap that counts. Crops of a size are many, so they are worked out once."""
    at, weights = KERNELS[kernel](n, m)
    weights = weights / weights.sum(axis=1, keepdims=True)
    return [(np.clip(at[:, k], 0, n - 1), weights[:, k].astype(np.float32)) for k in range(at.shape[1]) if weights[:, k].any()]


def _along(image: np.ndarray, m: int, kernel: str, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n == m:
        return image
    shape = [1] * image.ndim
    shape[axis] = m
    out = 0.0
    for at, weights in _taps(kernel, n, m):
        out = out + image.take(at, axis=axis) * weights.reshape(shape)
    return out


def rounded(image: np.ndarray) -> np.ndarray:
    """Halves go up, also those that a sum of shares misses by its last bits."""
    return np.clip(np.floor(image + np.float32(0.5001)), 0, 255).astype(np.uint8)


def resized(image: np.ndarray, w: int, h: int, kernel: str = "area") -> np.ndarray:
    """image as w x h. area: shares of pixels; bins: means of whole pixels; linear, cubic: 2 or 4 pixels beside a place, edges repeated; lanczos: 6, more when it
    shrinks."""
    if not (w > 0 and h > 0 and image.size):
        return np.zeros((max(h, 0), max(w, 0), *image.shape[2:]), np.uint8)
    if image.shape[:2] == (h, w):
        return image
    return rounded(_along(_along(image.astype(np.float32), h, kernel, 0), w, kernel, 1))


# --- enhancement


def _mirrored(image: np.ndarray, by: int, axis: int) -> np.ndarray:
    """image with `by` more pixels on both sides of an axis, mirrored at the edge pixel."""
    n = image.shape[axis]
    at = np.arange(-by, n + by)
    if n == 1:
        return image.take(np.zeros_like(at), axis=axis)
    at = np.abs((at + n - 1) % (2 * n - 2) - (n - 1)) if n > 1 else at
    return image.take(at, axis=axis)


def blurred(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A separable sum of neighbours with symmetric weights; edges are mirrored."""
    out, by = image.astype(np.float32), len(weights) // 2
    for axis in (0, 1):
        wide, n = _mirrored(out, by, axis), out.shape[axis]
        out = sum(wide.take(np.arange(k, k + n), axis=axis) * np.float32(x) for k, x in enumerate(weights))
    return out


def gaussian(sigma: float) -> np.ndarray:
    reach = int(round(sigma * 3))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def equalised(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """A gray image with its contrast evened out by tile: each tile's histogram is clipped, what is cut off is spread over all values, and a pixel takes its
    value from the tables of the four tiles around it, by distance."""
    h, w = image.shape
    if h % tiles or w % tiles:  # mirrored pixels fill both sides up to the next multiple, a whole one if a side fits already
        down, right = tiles - h % tiles, tiles - w % tiles
        wide = _mirrored(_mirrored(image, down, 0)[down:], right, 1)[:, right:] if min(h, w) > 1 else np.pad(image, ((0, down), (0, right)), "edge")
    else:
        wide = image
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    tile = (np.arange(wide.shape[0]) // th)[:, None] * tiles + np.arange(wide.shape[1]) // tw
    counts = np.bincount((tile * 256 + wide).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    most = max(1, int(clip * th * tw / 256))
    cut = np.maximum(counts - most, 0).sum(axis=1)
    counts = np.minimum(counts, most) + (cut // 256)[:, None]
    rest = cut % 256
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    value = np.arange(256)
    counts += (value % step[:, None] == 0) & (value // step[:, None] < rest[:, None])
    table = np.rint(np.clip(np.cumsum(counts, axis=1) * np.float32(255 / (th * tw)), 0, 255)).astype(np.float32).reshape(tiles, tiles, 256)

    def near(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n, dtype=np.float32) / size - np.float32(0.5)
        low = np.floor(at)
        return np.clip(low, 0, tiles - 1).astype(int), np.clip(low + 1, 0, tiles - 1).astype(int), at - low

    y0, y1, v = near(h, th)
    x0, x1, u = near(w, tw)
    out = np.empty((h, w), np.uint8)
    for low in range(0, h, 256):  # a band of rows at a time
        s = slice(low, low + 256)
        p, top, bottom, vv = image[s], y0[s, None], y1[s, None], v[s, None]
        upper = table[top, x0, p] * (1 - u) + table[top, x1, p] * u
        under = table[bottom, x0, p] * (1 - u) + table[bottom, x1, p] * u
        out[s] = np.rint(upper * (1 - vv) + under * vv)
    return out


def enhanced(rgb: np.ndarray) -> np.ndarray:
    """A photographed page made easier to read: gray, contrast evened out at half the size, sharpened; as three equal channels."""
    g = gray(rgb)
    h, w = g.shape
    small = resized(g, max(1, int(w * 0.5 + 0.5)), max(1, int(h * 0.5 + 0.5)), "area")
    even = resized(equalised(small), w, h, "linear").astype(np.float32)
    sharp = rounded(even * SHARP[0] + rounded(blurred(even, gaussian(SIGMA))) * np.float32(SHARP[1]))
    return np.repeat(sharp[:, :, None], 3, axis=2)


# --- outlines


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels from 1 of the connected parts of mask (0 outside), and how many there are. Runs of rows are joined where they touch, by passing on the smallest
    label until nothing changes."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    turn = np.diff(padded, axis=1)
    row, start = np.nonzero(turn == 1)
    end = np.nonzero(turn == -1)[1]
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int64), 0
    # runs a, b in neighbouring rows touch if a.start < b.end + d and b.start < a.end + d
    d = int(diagonal)
    key_start, key_end = row * (w + 3) + start, row * (w + 3) + end
    first = np.searchsorted(key_end, (row + 1) * (w + 3) + start + 1 - d, "left")
    last = np.searchsorted(key_start, (row + 1) * (w + 3) + end + d, "left")
    below = np.searchsorted(row, row + 1, "left"), np.searchsorted(row, row + 1, "right")
    first, last = np.maximum(first, below[0]), np.minimum(last, below[1])
    many = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    names, label = np.unique(root, return_inverse=True)
    line = np.zeros((h, w + 1), np.int64)
    np.add.at(line, (row, start), label + 1)
    np.add.at(line, (row, end), -(label + 1))
    return np.cumsum(line, axis=1)[:, :-1], len(names)


def edges(image: np.ndarray, weak: int = WEAK, sure: int = SURE) -> np.ndarray:
    """Thin edges of a gray image: places where the gradient is largest across the edge, over `weak`, and joined to one over `sure`."""
    wide = np.pad(image.astype(np.int32), 1, "edge")
    across, down = wide[:, 2:] - wide[:, :-2], wide[2:] - wide[:-2]
    dx = across[:-2] + 2 * across[1:-1] + across[2:]
    dy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    size = np.abs(dx) + np.abs(dy)
    round_ = np.pad(size, 1)
    beside = lambda y, x: round_[1 + y : round_.shape[0] - 1 + y, 1 + x : round_.shape[1] - 1 + x]
    flat, steep = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx), np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    same = (dx < 0) == (dy < 0)
    before = np.where(flat, beside(0, -1), np.where(steep, beside(-1, 0), np.where(same, beside(-1, -1), beside(-1, 1))))
    after = np.where(flat, beside(0, 1), np.where(steep, beside(1, 0), np.where(same, beside(1, 1), beside(1, -1))))
    top = (size > weak) & (size > before) & np.where(flat | steep, size >= after, size > after)
    label, n = components(top)
    kept = np.zeros(n + 1, bool)
    kept[label[top & (size > sure)]] = True
    kept[0] = False
    return kept[label]


def dilated(mask: np.ndarray, side: int) -> np.ndarray:
    """True where any place in a square of `side` around is."""
    by = side // 2
    for axis in (0, 1):
        wide = np.pad(mask, [(by, by) if a == axis else (0, 0) for a in (0, 1)])
        sums = np.cumsum(wide, axis=axis, dtype=np.int32)
        n = mask.shape[axis]
        high = sums.take(np.arange(side - 1, side - 1 + n), axis=axis)
        low = np.concatenate([np.zeros_like(high.take([0], axis=axis)), sums.take(np.arange(n - 1), axis=axis)], axis=axis)
        mask = high > low
    return mask


def outline_area(part: np.ndarray) -> float:
    """Area inside the outer outline of a connected part, drawn through its pixels' centres; holes count as filled."""
    wide = np.pad(part, 1)
    outside, _ = components(~wide, diagonal=False)
    full = (outside != outside[0, 0]).astype(np.int8)
    squares = full[1:, 1:] + full[1:, :-1] + full[:-1, 1:] + full[:-1, :-1]
    return float((squares == 4).sum() + (squares == 3).sum() / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (x, y), counter-clockwise."""
    points = np.unique(points, axis=0).tolist()
    if len(points) < 3:
        return np.array(points, float)

    def half(ordered: list) -> list:
        out: list = []
        for x, y in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(half(points) + half(points[::-1]), float)


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """The four corners of the rectangle of least area around points: one of its sides lies on a side of their hull."""
    corner = hull(points)
    side = np.roll(corner, -1, axis=0) - corner
    length = np.hypot(side[:, 0], side[:, 1])
    along = side[length > 0] / length[length > 0, None]
    if not len(along):
        return np.repeat(corner[:1], 4, axis=0)
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    u, v = along @ corner.T, across @ corner.T
    area = (u.max(1) - u.min(1)) * (v.max(1) - v.min(1))
    k = int(area.argmin())
    ends = [(u[k].min(), v[k].min()), (u[k].max(), v[k].min()), (u[k].max(), v[k].max()), (u[k].min(), v[k].max())]
    return np.array([a * along[k] + b * across[k] for a, b in ends])


def largest_outline(rgb: np.ndarray, least: float = 0.12) -> tuple[np.ndarray, float] | None:
    """The smallest rectangle around the largest outline of an image's edges, and the outline's area; None if it has less than `least` of the image. Of equal
    ones the first from the top, then the left."""
    image = gray(rgb)
    mask = edges(rounded(blurred(image, BLUR)))
    for _ in range(TIMES):
        mask = dilated(mask, DILATION)
    label, n = components(mask)
    if not n:
        return None
    at = np.flatnonzero(label)
    of, y, x = label.ravel()[at], at // label.shape[1], at % label.shape[1]
    box = np.zeros((4, n + 1), int)
    box[:2] = max(label.shape)
    np.minimum.at(box[0], of, y)
    np.minimum.at(box[1], of, x)
    np.maximum.at(box[2], of, y)
    np.maximum.at(box[3], of, x)
    spans = (box[2] - box[0]) * (box[3] - box[1])
    best, found = least * image.size, None
    for k in np.argsort(-spans[1:], kind="stable") + 1:
        if spans[k] < best:
            break
        part = label[box[0, k] : box[2, k] + 1, box[1, k] : box[3, k] + 1] == k
        area = outline_area(part)
        if area > best or (found is None and area >= best):
            left, right = part.argmax(axis=1), part.shape[1] - 1 - part[:, ::-1].argmax(axis=1)
            rows = np.arange(len(part))
            points = np.concatenate([np.stack([left, rows], axis=1), np.stack([right, rows], axis=1)]) + box[[1, 0], k]
            best, found = area, (smallest_rectangle(points), area)
    return found
