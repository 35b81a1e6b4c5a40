"""Pixel kernels on numpy arrays, and an Arrow UDF to run one on a column of images.

Images are grey (height x width) or colour (height x width x 3, blue-green-red), 8 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.114, 0.587, 0.299])


def blur_score(image: np.ndarray) -> float:
    """Variance of the Laplacian over 5000, 1 at most; edges are mirrored without the edge pixel."""
    g = np.pad(grey(image).astype(float), 1, mode="reflect")
    laplacian = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return round(min(float(laplacian.var()) / 5000, 1.0), 4)


def stability(a: np.ndarray, b: np.ndarray) -> float:
    """1 - mean squared difference on the scale of a pixel."""
    return round(min(max(1 - float(((grey(a).astype(float) - grey(b)) ** 2).mean()) / 255**2, 0.0), 1.0), 4)


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area mean of a grey image on a smaller grid."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        lo, hi = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
        return np.clip(np.minimum(hi, edges[1:, None]) - np.maximum(lo, edges[:-1, None]), 0, None) * m / n

    g = grey(image).astype(float)
    return weights(g.shape[0], height) @ g @ weights(g.shape[1], width).T


def average_hash(image: np.ndarray) -> str:
    """64 signs: an 8 x 8 reduction above its mean or not."""
    small = shrink(image, 8, 8)
    return "".join("1" if x else "0" for x in (small > small.mean()).ravel())


def hash_similarity(a: str, b: str) -> float:
    """Share of equal signs; 0 for empty or unequal lengths."""
    if not a or len(a) != len(b):
        return 0.0
    return round(sum(x == y for x, y in zip(a, b)) / len(a), 4)


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def dct_hash(image: np.ndarray) -> np.ndarray:
    """256 booleans: the low frequencies of a 32 x 32 reduction above their median or not."""
    c = _cosines(32)
    low = (c @ shrink(image, 32, 32) @ c.T)[:16, :16]
    return (low > np.median(low)).ravel()


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity under an 11-tap Gaussian (sigma 1.5)."""
    x, y = grey(a).astype(float), grey(b).astype(float)
    taps = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    taps /= taps.sum()

    def smooth(z: np.ndarray) -> np.ndarray:
        z = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 5, mode="reflect"), taps, "valid"), 0, z)
        return np.apply_along_axis(lambda r: np.convolve(np.pad(r, 5, mode="reflect"), taps, "valid"), 1, z)

    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = smooth(x), smooth(y)
    vx, vy, vxy = smooth(x * x) - mx * mx, smooth(y * y) - my * my, smooth(x * y) - mx * my
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def histogram_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of 8 x 8 x 8 colour histograms."""
    def histogram(z: np.ndarray) -> np.ndarray:
        cells = (z.reshape(-1, 3) >> 5).astype(int)
        return np.bincount(cells[:, 0] * 64 + cells[:, 1] * 8 + cells[:, 2], minlength=512).astype(float)

    x, y = histogram(a), histogram(b)
    x, y = x - x.mean(), y - y.mean()
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / norm) if norm else 1.0


def _slid(z: np.ndarray, height: int, width: int, best) -> np.ndarray:
    """The largest or smallest value under a window around each pixel; windows end at the edges."""
    edge = -np.inf if best is np.max else np.inf
    for axis, n in ((0, height), (1, width)):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (n // 2, n // 2)
        z = best(np.lib.stride_tricks.sliding_window_view(np.pad(z, pad, constant_values=edge), n, axis), axis=-1)
    return z


def text_density(image: np.ndarray) -> float:
    """Share of pixels in closed areas (15 x 3) of what is 10 darker than its Gaussian surroundings (15 taps)."""
    g = grey(image).astype(float)
    sigma = 0.3 * ((15 - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-((np.arange(15) - 7) ** 2) / (2 * sigma**2))
    taps /= taps.sum()
    mean = g
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (7, 7)
        mean = np.lib.stride_tricks.sliding_window_view(np.pad(mean, pad, mode="edge"), 15, axis) @ taps
    ink = (g <= np.round(mean) - 10).astype(float)
    return float((_slid(_slid(ink, 3, 15, np.max), 3, 15, np.min) > 0).mean())


def hash_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """First pass of the change detector: share of equal low frequencies."""
    return float((dct_hash(a) == dct_hash(b)).mean())


def precise_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Second pass: 0.65 of structural similarity and 0.35 of the correlation of colour histograms."""
    return 0.65 * ssim(a, b) + 0.35 * histogram_correlation(a, b)


def thumbnail_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The sampler's: mean-centred correlation of 160 x 90 grey thumbnails; 1 if either is flat."""
    x, y = shrink(a, 90, 160), shrink(b, 90, 160)
    x, y = x - x.mean(), y - y.mean()
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return 1.0 if norm < 1e-6 else float((x * y).sum() / norm)


def image(raw: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))


def kernel_udf(kernel: Callable[[np.ndarray], float], channels: int = 1):
    """An Arrow UDF (height, width, pixels) -> kernel value for a column of raw images; null for an unreadable one."""
    @F.pandas_udf("double")
    def run(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.Series:
        def one(h: int, w: int, raw: bytes) -> float | None:
            if raw is None or len(raw) != h * w * channels:
                return None
            image = np.frombuffer(raw, dtype=np.uint8).reshape((h, w) if channels == 1 else (h, w, channels))
            return float(kernel(image))

        return pd.Series([one(h, w, p) for h, w, p in zip(height, width, pixels)])

    return run
