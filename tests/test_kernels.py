"""Pixel kernels."""

import numpy as np

from quillframe.functions import kernels as K


def page(seed=0):
    r = np.random.default_rng(seed)
    image = np.full((120, 160), 230, dtype=np.uint8)
    for i in range(10, 110, 12):
        image[i : i + 4, 10:150] = r.integers(0, 90, (4, 140))
    return image


def smoothed(image):
    z = image.astype(float)
    for _ in range(4):
        z = (z + np.roll(z, 1, 0) + np.roll(z, -1, 0) + np.roll(z, 1, 1) + np.roll(z, -1, 1)) / 5
    return z.astype(np.uint8)


def test_sharp_over_blurred():
    assert K.blur_score(page()) > K.blur_score(smoothed(page()))


def test_identity():
    a = page()
    assert K.stability(a, a) == 1.0 and abs(K.ssim(a, a) - 1) < 1e-9 and K.hash_similarity(K.average_hash(a), K.average_hash(a)) == 1.0
    assert (K.dct_hash(a) == K.dct_hash(a)).all() and K.hash_similarity("", "") == 0.0


def test_difference():
    a, b = page(), 255 - page()
    assert K.ssim(a, b) < 0.5 and K.hash_similarity(K.average_hash(a), K.average_hash(b)) < 0.5
    colour = np.random.default_rng(1).integers(0, 255, (20, 20, 3), dtype=np.uint8)
    assert abs(K.histogram_correlation(colour, colour) - 1) < 1e-9


def test_text_density_and_passes():
    a, flat = page(), np.full((120, 160), 230, dtype=np.uint8)
    assert K.text_density(flat) == 0.0 and 0.1 < K.text_density(a) < 0.9
    dot = flat.copy()
    dot[60, 80] = 0  # a closing leaves a single dark pixel as it is
    assert round(K.text_density(dot) * dot.size) == 1
    colour = np.repeat(a[:, :, None], 3, axis=2)
    assert K.hash_likeness(colour, colour) == 1.0 and abs(K.precise_likeness(colour, colour) - 1) < 1e-9 and abs(K.thumbnail_likeness(a, a) - 1) < 1e-9
    assert K.thumbnail_likeness(a, 255 - a) < 0 and K.thumbnail_likeness(flat, a) == 1.0


def test_udf(spark):
    from quillframe.shipping import ship

    ship(spark)
    a = page()
    df = spark.createDataFrame([(120, 160, bytearray(a.tobytes())), (120, 160, bytearray(b"x")), (None, None, None)], "h int, w int, p binary")
    got = [r[0] for r in df.select(K.kernel_udf(K.blur_score)("h", "w", "p")).collect()]
    assert got[0] == K.blur_score(a) and got[1] is None and got[2] is None
