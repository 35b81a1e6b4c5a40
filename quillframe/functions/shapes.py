"""From pixels to boxes: thresholds, edges, connected components, outlines and lines, on grey numpy images of 8 bits.

Components are labelled in two passes over runs of pixels with union-find. Outlines go through pixel centres, as do the areas and
lengths measured on them. `shape_udf` runs one of the box functions on a column of raw images: image -> array of boxes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .kernels import grey

# Gradients between which an edge needs a stronger neighbour; the tangent of 22.5 degrees in 15 bits.
EDGE_LOW, EDGE_HIGH, TANGENT = 50, 150, 13573
# Lines of so many votes and pixels, gaps that they may have, and how far from the axes they may lean.
LINE_VOTES, LINE_LENGTH, LINE_GAP, LINE_LEAN = 80, 50, 10, 10


def otsu(image: np.ndarray) -> int:
    """The level that parts the values into the two groups farthest apart; the lowest of equal ones."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    levels = np.arange(256)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * levels)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * (total - below) * (sums / below - (sums[-1] - sums) / (total - below)) ** 2
    return int(np.nan_to_num(apart).argmax())


def gaussian(image: np.ndarray, taps: int) -> np.ndarray:
    """Smoothed by a Gaussian of so many taps; edges repeat the last pixel."""
    sigma = 0.3 * ((taps - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(taps) - taps // 2) ** 2) / (2 * sigma**2))
    weights, out = weights / weights.sum(), image.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (taps // 2, taps // 2)
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="edge"), taps, axis) @ weights
    return out


def ink(image: np.ndarray, taps: int = 25, darker: int = 12) -> np.ndarray:
    """Pixels so much darker than their surroundings."""
    return image <= np.round(gaussian(image, taps)) - darker


def spread(mask: np.ndarray, height: int, width: int, times: int = 1) -> np.ndarray:
    """Dilation by a rectangle whose anchor is its middle."""
    for _ in range(times):
        for axis, n in ((0, height), (1, width)):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (n // 2 + 1, n - 1 - n // 2)
            sums = np.cumsum(np.pad(mask.astype(np.int32), pad), axis=axis)
            mask = np.take(sums, np.arange(n, sums.shape[axis]), axis) > np.take(sums, np.arange(sums.shape[axis] - n), axis)
    return mask


def closed(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Dilation, then erosion; what lies outside the image hinders neither."""
    return ~spread(~spread(mask, height, width), height, width)


def labels(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Component numbers from 1 (0: background), in order of their first pixels, and how many there are.

    First pass: each row's runs of pixels are joined with the runs above that they touch, by union-find. Second pass: roots become numbers.
    """
    height, width = mask.shape
    steps = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(steps == 1)
    ends = np.nonzero(steps == -1)[1]
    reach, first = int(diagonal), np.searchsorted(rows, np.arange(height + 1))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y in range(1, height):
        above = slice(first[y - 1], first[y])
        lo = first[y - 1] + np.searchsorted(ends[above], starts[first[y] : first[y + 1]] - reach, side="right")
        hi = first[y - 1] + np.searchsorted(starts[above], ends[first[y] : first[y + 1]] + reach, side="left")
        for run, (a, b) in enumerate(zip(lo.tolist(), hi.tolist()), int(first[y])):
            for other in range(a, b):
                i, j = find(run), find(other)
                root[max(i, j)] = min(i, j)
    roots, number = np.unique([find(i) for i in range(len(rows))], return_inverse=True) if len(rows) else (np.zeros(0), np.zeros(0, int))
    change = np.zeros((height, width + 1), np.int64)
    np.add.at(change, (rows, starts), number + 1)
    np.add.at(change, (rows, ends), -(number + 1))
    return np.cumsum(change, axis=1)[:, :-1], len(roots)


_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of the component with the first pixel, followed around once: points (y, x)."""
    m = np.pad(mask, 1)
    start = tuple(int(v) for v in np.argwhere(m)[0])
    at, came, points, first_step = start, 4, [start], None
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            to = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if m[to]:
                break
        else:
            break  # a single pixel
        if first_step is None:
            first_step = (at, d)
        elif (at, d) == first_step:
            points.pop()
            break
        at, came = to, (d + 4) % 8
        points.append(at)
    return np.array(points) - 1


def enclosed(points: np.ndarray) -> float:
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def around(points: np.ndarray) -> float:
    return float(np.hypot(*(points - np.roll(points, -1, axis=0)).T.astype(float)).sum())


def corners(points: np.ndarray, slack: float) -> int:
    """Points left when a closed line is simplified: farther than `slack` from the chords between their neighbours."""
    p = points.astype(float)
    a = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    b = int(((p - p[a]) ** 2).sum(axis=1).argmax())
    lo, hi = min(a, b), max(a, b)
    if lo == hi:
        return 1
    kept, work = 0, [np.arange(lo, hi + 1), np.concatenate([np.arange(hi, len(p)), np.arange(lo + 1)])]
    while work:
        chain = work.pop()
        inner = p[chain[1:-1]]
        if len(inner):
            start, along = p[chain[0]], p[chain[-1]] - p[chain[0]]
            size = np.hypot(*along)
            off = np.abs(along[0] * (inner - start)[:, 1] - along[1] * (inner - start)[:, 0]) / size if size else np.hypot(*(inner - start).T)
            if off.max() > slack:
                cut = int(off.argmax()) + 1
                work += [chain[: cut + 1], chain[cut:]]
                continue
        kept += 1
    return kept


@dataclass
class Border:
    """A component's outer border, or that of a hole in one, with its box."""

    points: np.ndarray
    x: int
    y: int
    w: int
    h: int


def _boxes(number: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """(y, x, height, width) of each component."""
    ys, xs = np.nonzero(number)
    of = number[ys, xs]
    lo, hi = np.full((2, n + 1), 1 << 30), np.full((2, n + 1), -1)
    for k, v in enumerate((ys, xs)):
        np.minimum.at(lo[k], of, v)
        np.maximum.at(hi[k], of, v)
    return [(int(lo[0, i]), int(lo[1, i]), int(hi[0, i] - lo[0, i] + 1), int(hi[1, i] - lo[1, i] + 1)) for i in range(1, n + 1)]


def borders(mask: np.ndarray, holes: bool = True) -> list[Border]:
    """Outer borders of all components, then of the holes in them (the pixels that surround a hole)."""
    out = []
    number, n = labels(mask)
    for i, (y, x, h, w) in enumerate(_boxes(number, n), 1):
        out.append(Border(outline(number[y : y + h, x : x + w] == i) + [y, x], x, y, w, h))
    if holes:
        back, m = labels(~np.pad(mask, 1), diagonal=False)
        for i, (y, x, h, w) in enumerate(_boxes(back, m), 1):
            if i != back[0, 0]:
                inside = np.pad(back[y : y + h, x : x + w] == i, 1)
                ring = inside | spread(inside, 3, 1) | spread(inside, 1, 3)
                out.append(Border(outline(ring) + [y - 2, x - 2], x - 2, y - 2, w + 2, h + 2))
    return out


def edges(image: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Gradient edges, thinned across their direction; weak ones stay where they touch a chain with a strong one."""
    g = np.pad(image.astype(np.int64), 1, mode="edge")
    dx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    dy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)

    def beside(y: int, x: int) -> np.ndarray:
        return m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]

    flat, steep = np.abs(dx) * TANGENT, np.abs(dy) << 15
    across, down = steep < flat, steep > flat + (np.abs(dx) << 16)
    falling = (dx ^ dy) < 0
    slanted = np.where(falling, (size > beside(-1, 1)) & (size > beside(1, -1)), (size > beside(-1, -1)) & (size > beside(1, 1)))
    peak = np.where(across, (size > beside(0, -1)) & (size >= beside(0, 1)), np.where(down, (size > beside(-1, 0)) & (size >= beside(1, 0)), slanted))
    weak = peak & (size > low)
    number, n = labels(weak)
    strong = np.zeros(n + 1, bool)
    strong[number[weak & (size > high)]] = True
    strong[0] = False
    return strong[number]


def lines(mask: np.ndarray, votes: int = LINE_VOTES, length: int = LINE_LENGTH, gap: int = LINE_GAP) -> list[tuple[int, int, int, int]]:
    """Straight lines (x1, y1, x2, y2): pixels vote for the angles (whole degrees) and distances of lines through them; the line
    with most votes is walked, its pieces without a gap over `gap` are cut out with their pixels, and the vote goes on."""
    left = mask.copy()
    angles = np.deg2rad(np.arange(180))
    cos, sin = np.cos(angles), np.sin(angles)
    far = int(np.hypot(*mask.shape)) + 1
    ys, xs = np.nonzero(mask)
    bins = np.round(xs[:, None] * cos + ys[:, None] * sin).astype(np.int64) + far
    table = np.zeros((180, 2 * far + 1), np.int64)
    for a in range(180):
        table[a] = np.bincount(bins[:, a], minlength=2 * far + 1)
    index = np.full(mask.shape, -1)
    index[ys, xs] = np.arange(len(ys))
    found = []
    while True:
        a, r = np.unravel_index(int(table.argmax()), table.shape)
        if table[a, r] < votes:
            return found
        flat = 45 <= a < 135  # nearer to the horizontal: one pixel a column
        walk = np.arange(mask.shape[1] if flat else mask.shape[0])
        other = np.round(((r - far) - walk * (cos[a] if flat else sin[a])) / (sin[a] if flat else cos[a])).astype(np.int64)
        inside = (other >= 0) & (other < mask.shape[0 if flat else 1])
        walk, other = walk[inside], other[inside]
        y, x = (other, walk) if flat else (walk, other)
        on = np.zeros(len(walk), bool)
        spot = np.full(len(walk), -1)
        for off in (0, -1, 1):  # pixels whose distance rounds to this one lie at most a pixel beside
            yy, xx = (np.clip(y + off, 0, mask.shape[0] - 1), x) if flat else (y, np.clip(x + off, 0, mask.shape[1] - 1))
            hit = left[yy, xx] & ~on
            hit &= np.where(hit, bins[index[yy, xx], a] == r, False) if len(bins) else False
            spot[hit] = index[yy, xx][hit]
            on |= hit
        at = np.nonzero(on)[0]
        pieces = np.split(at, np.nonzero(np.diff(at) > gap)[0] + 1) if len(at) else []
        for piece in pieces:
            if len(piece) and piece[-1] - piece[0] >= length:
                ends = spot[piece[[0, -1]]]
                found.append((int(xs[ends[0]]), int(ys[ends[0]]), int(xs[ends[1]]), int(ys[ends[1]])))
        members = np.nonzero((bins[:, a] == r) & left[ys, xs])[0]
        for k in range(180):
            np.subtract.at(table[k], bins[members, k], 1)
        left[ys[members], xs[members]] = False


def line_counts(image: np.ndarray) -> tuple[int, int]:
    """Lines across and down, within LINE_LEAN degrees."""
    across = down = 0
    for x1, y1, x2, y2 in lines(edges(grey(image).astype(np.uint8))):
        angle = 90.0 if x1 == x2 else abs(np.degrees(np.arctan2(y2 - y1, x2 - x1)))
        across += angle < LINE_LEAN or angle > 180 - LINE_LEAN
        down += abs(angle - 90) < LINE_LEAN
    return int(across), int(down)


def block_boxes(image: np.ndarray) -> list[dict]:
    """Boxes of blocks of text: ink spread sideways and down until it touches."""
    blocks = spread(spread(ink(image), 3, 25, 2), 10, 3)
    return [dict(x=b.x, y=b.y, w=b.w, h=b.h) for b in borders(blocks, holes=False)]


def _measured(image: np.ndarray, b: Border) -> dict:
    area, rim = enclosed(b.points), around(b.points)
    part = image[b.y : b.y + b.h, b.x : b.x + b.w]
    inner = image[b.y + 2 : b.y + b.h - 2, b.x + 2 : b.x + b.w - 2] if b.h > 6 and b.w > 6 else part
    return dict(x=b.x, y=b.y, w=b.w, h=b.h, extent=area / (b.w * b.h), circularity=4 * np.pi * area / rim**2 if rim else None, fill=float((part <= 128).mean()),
                vertices=corners(b.points, 0.04 * rim) if rim else 1, mean=float(inner.mean()), std=float(inner.std()))


def dark_shapes(image: np.ndarray) -> list[dict]:
    """Shapes of what is dark by Otsu's level, with what marks are told by: extent, circularity, fill."""
    return [_measured(image, b) for b in borders(image <= otsu(image)) if around(b.points)]


def dark_components(image: np.ndarray) -> list[dict]:
    """Boxes and pixels of the components of what is dark by Otsu's level."""
    number, n = labels(image <= otsu(image))
    sizes = np.bincount(number.ravel(), minlength=n + 1)
    return [dict(x=x, y=y, w=w, h=h, area=int(sizes[i])) for i, (y, x, h, w) in enumerate(_boxes(number, n), 1)]


def edge_shapes(image: np.ndarray) -> list[dict]:
    """Shapes of the edges, with what form fields are told by: vertices, mean and deviation inside."""
    return [_measured(image, b) for b in borders(edges(image))]


def ruled_regions(image: np.ndarray) -> list[dict]:
    """Regions where lines across and down are dense, with the pixels of either: the candidates for bordered tables."""
    e, (height, width) = edges(image), image.shape
    rows, columns = spread(closed(e, 1, max(40, width // 20)), 3, 1), spread(closed(e, max(40, height // 20), 1), 1, 3)
    dense = np.round(gaussian(np.minimum(rows * 255 + columns * 255, 255), 15)) > 30
    boxes = borders(spread(dense, 20, 20, 2), holes=False)
    return [dict(x=b.x, y=b.y, w=b.w, h=b.h, across=int(rows[b.y : b.y + b.h, b.x : b.x + b.w].sum()), down=int(columns[b.y : b.y + b.h, b.x : b.x + b.w].sum())) for b in boxes]


_PLACE = "x:int,y:int,w:int,h:int"
#: The fields of each box function.
FIELDS = {
    dark_components: f"{_PLACE},area:int",
    block_boxes: _PLACE, ruled_regions: f"{_PLACE},across:int,down:int",
    dark_shapes: f"{_PLACE},extent:double,circularity:double,fill:double,vertices:int,mean:double,std:double", edge_shapes: f"{_PLACE},extent:double,circularity:double,fill:double,vertices:int,mean:double,std:double",
}


def shape_udf(boxes: Callable[[np.ndarray], list[dict]], fields: str | None = None):
    """An Arrow UDF (height, width, grey pixels) -> array of boxes; null for an unreadable image."""
    @F.pandas_udf(f"array<struct<{fields or FIELDS[boxes]}>>")
    def run(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.Series:
        def one(h, w, raw):
            if raw is None or pd.isna(h) or pd.isna(w) or len(raw) != h * w or not h * w:
                return None
            return boxes(np.frombuffer(raw, dtype=np.uint8).reshape(int(h), int(w)))

        return pd.Series([one(*x) for x in zip(height, width, pixels)], dtype=object)

    return run
