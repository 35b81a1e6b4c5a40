"""From pixels to boxes: drawn shapes, labelling against flood fill, lines counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import shapes
from quillframe.operators import layout, scoring


def page(height, width):
    return np.full((height, width), 255, np.uint8)


def frame(image, x, y, w, h, thick=2, value=0):
    image[y : y + h, x : x + w] = np.where(np.pad(np.zeros((h - 2 * thick, w - 2 * thick), bool), thick, constant_values=True), value, image[y : y + h, x : x + w])


def disc(image, x, y, r, value=0):
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    image[(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = value


def images(spark, *pages):
    return spark.createDataFrame([(i, p.shape[0], p.shape[1], bytearray(p.tobytes())) for i, p in enumerate(pages)] + [(99, 5, 5, bytearray(b"x")), (98, 3, 3, None)], "id int, height int, width int, pixels binary")


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels_are_flood_fills(diagonal):
    rng = np.random.default_rng(1)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (diagonal or not dy * dx)]
    for density in (0.2, 0.45, 0.6, 0.9):
        mask = rng.random((23, 31)) < density
        number, n = shapes.labels(mask, diagonal)
        want, k = np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask):
            if not want[y, x]:
                k += 1
                stack = [(y, x)]
                want[y, x] = k
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < 23 and 0 <= d < 31 and mask[c, d] and not want[c, d]:
                            want[c, d] = k
                            stack.append((c, d))
        assert n == k and (number == want).all()
    assert shapes.labels(np.zeros((3, 4), bool))[1] == 0


def test_outlines_measure_shapes():
    image = np.zeros((40, 40), bool)
    image[5:15, 7:27] = True
    (b,) = shapes.borders(image)
    assert (b.x, b.y, b.w, b.h) == (7, 5, 20, 10) and shapes.enclosed(b.points) == 19 * 9 and shapes.around(b.points) == 56 and shapes.corners(b.points, 2) == 4
    image[8:12, 10:20] = False
    outer, hole = shapes.borders(image)
    assert (hole.x, hole.y, hole.w, hole.h) == (9, 7, 12, 6) and 11 * 5 - 4 < shapes.enclosed(hole.points) <= 11 * 5
    one = np.zeros((5, 5), bool)
    one[2, 3] = True
    assert shapes.borders(one)[0].points.tolist() == [[2, 3]]
    thin = np.zeros((5, 9), bool)
    thin[2, 1:8] = True
    assert shapes.enclosed(shapes.borders(thin)[0].points) == 0 and shapes.around(shapes.borders(thin)[0].points) == 12


def test_otsu_parts_two_groups():
    image = np.concatenate([np.full(60, 40), np.full(30, 50), np.full(90, 200)]).astype(np.uint8).reshape(9, 20)
    values, best = image.ravel().astype(float), None
    for t in range(256):
        a, b = values[values <= t], values[values > t]
        if len(a) and len(b):
            apart = len(a) * len(b) * (a.mean() - b.mean()) ** 2
            if best is None or apart > best[0] + 1e-9:
                best = (apart, t)
    assert shapes.otsu(image) == best[1] == 50


def test_spread_covers_as_a_sliding_window():
    rng = np.random.default_rng(3)
    mask = rng.random((12, 17)) < 0.1
    for h, w in ((3, 5), (10, 3), (4, 1)):
        want = np.zeros_like(mask)
        for y, x in np.ndindex(mask.shape):
            want[y, x] = mask[max(y - h // 2, 0) : max(y + h - h // 2, 0), max(x - w // 2, 0) : max(x + w - w // 2, 0)].any()
        assert (shapes.spread(mask, h, w) == want).all()


def test_marks(spark):
    image = page(200, 300)
    frame(image, 20, 20, 20, 20)  # an empty check box
    frame(image, 60, 20, 20, 20)
    image[24:36, 64:76] = 0  # a checked one: the cross inside is no mark of its own
    disc(image, 120, 30, 12)  # a radio button
    image[20:28, 200:290] = 0  # too wide
    got = {(r.x, r.y): (r.w, r.h, r.kind, r.checked) for r in layout.detect_marks(images(spark, image), "id").collect()}
    assert {at: x[2:] for at, x in got.items()} == {(20, 20): ("radio", False), (60, 20): ("radio", True), (108, 18): ("radio", True)}  # a square is rounder than 0.75


def test_fields_and_elements(spark):
    image = page(300, 400)
    frame(image, 50, 50, 200, 30)
    frame(image, 50, 150, 200, 60)
    found = layout.detect_fields(images(spark, image), "id").collect()
    assert {r.kind for r in found} >= {"text_input", "textarea"} and all(abs(r.x - 50) <= 2 and abs(r.w - 200) <= 5 for r in found)
    elements = spark.createDataFrame([(0, 40, 40, 300, 60)], "id int, x int, y int, w int, h int")
    left = layout.detect_fields(images(spark, image), "id", elements).collect()
    assert {r.kind for r in left} == {"textarea"}


def test_blocks_and_tables(spark):
    image = page(400, 600)
    for line in range(3):
        for word in range(12):
            image[60 + 14 * line : 68 + 14 * line, 50 + 20 * word : 64 + 20 * word] = 30
    (block,) = layout.detect_blocks(images(spark, image), "id").collect()
    assert block.x < 50 < 280 < block.x + block.w and block.y < 60 and block.y + block.h > 96
    table = page(400, 600)
    for i in range(5):
        table[50 + 40 * i : 52 + 40 * i, 60:400] = 0
        table[50:212, 60 + 85 * i : 62 + 85 * i] = 0
    (region,) = layout.detect_bordered_tables(images(spark, table), "id").collect()
    assert region.x <= 60 and region.x + region.w >= 400 and region.y <= 50 and region.y + region.h >= 210
    assert layout.detect_bordered_tables(images(spark, page(90, 90)), "id").collect() == []


def test_lines_are_counted():
    image = page(200, 260)
    assert shapes.line_counts(image) == (0, 0)
    image[50:150, 30:36] = 0
    across, down = shapes.line_counts(image)
    assert across == 0 and down == 2  # both sides of the stroke
    for y in (40, 90, 140):
        image[y : y + 4, 20:240] = 0
    across, down = shapes.line_counts(image)
    assert across >= 6 and down >= 2
    diagonal = page(200, 200)
    for i in range(180):
        diagonal[10 + i, 10 + i : 13 + i] = 0
    assert shapes.line_counts(diagonal) == (0, 0)
    dashed = np.zeros((50, 200), bool)
    dashed[20, 10:100] = dashed[20, 108:190] = True
    assert len(shapes.lines(dashed)) == 1
    dashed[20, 80:120] = False
    assert len(shapes.lines(dashed)) == 2


def test_structure_of_images(spark):
    plain, ruled = page(200, 260), page(200, 260)
    for y in (20, 60, 100, 140, 180):
        ruled[y : y + 3, 20:240] = 0
        ruled[20:182, 20 + y : 23 + y] = 0
    got = {r.id: r.structure for r in images(spark, plain, ruled).select("id", scoring.image_structure(F.col("height"), F.col("width"), F.col("pixels")).alias("structure")).collect()}
    assert got[0] == 0 and got[1] >= 0.9 and got[99] is None and got[98] is None
