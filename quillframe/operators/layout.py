"""Recognised words, boxes and table cells of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import shapes
from quillframe.shipping import ship

from .lookups import overlaps


def page_text(words: DataFrame, key: str, order: str, least: int = 30) -> DataFrame:
    """Words of at least that confidence joined by blanks, with their number and mean confidence."""
    good = words.filter((F.col("conf") >= least) & (F.trim("text") != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return good.groupBy(key).agg(joined.alias("text"), F.count("*").alias("n_words"), F.avg("conf").alias("mean_conf"))


def page_layout(words: DataFrame, key: str, order: str, least_text: int = 20, least_word: int = 30) -> DataFrame:
    """Lines of (block, par, line), a blank line between paragraphs; mean confidence of the surer words."""
    good = words.filter((F.col("conf") >= least_text) & (F.trim("text") != ""))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    lines = good.groupBy(key, "block", "par", "line").agg(in_order.alias("text"))
    joined = lambda by, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "text"))), lambda x: x["text"]), sep)
    pars = lines.groupBy(key, "block", "par").agg(joined(["line"], "\n").alias("text"))
    pages = pars.groupBy(key).agg(joined(["block", "par"], "\n\n").alias("text"))
    sure = good.filter(F.col("conf") >= least_word).groupBy(key).agg(F.avg("conf").alias("mean_conf"))
    return pages.join(sure, key, "left")


def strategy_score(conf: Column, length: Column) -> Column:
    return 0.7 * conf + 30 * F.least(length / 500, F.lit(1.0))


def best_strategy(results: DataFrame, key: str, strategy: str, attempt: str, enough: float = 75.0) -> DataFrame:
    """The best of all attempts (columns conf, length) up to the strategy that brings the best confidence to `enough`; the earlier of equals."""
    score = strategy_score(F.col("conf"), F.col("length"))
    scored = results.withColumn("score", score)
    # The confidence that counts is that of the best-scored attempt so far; strategies after it reaches `enough` aren't run.
    w = Window.partitionBy(key).orderBy(strategy, attempt).rowsBetween(Window.unboundedPreceding, 0)
    best_so_far = F.max(F.struct("score", (-F.col(strategy)).alias("s"), (-F.col(attempt)).alias("a"), "conf")).over(w)["conf"]
    last = Window.partitionBy(key, strategy)
    ended = scored.withColumn("_c", best_so_far).withColumn("_end", F.max_by("_c", attempt).over(last))
    stop = ended.groupBy(key).agg(F.min(F.when(F.col("_end") >= enough, F.col(strategy))).alias("_stop"))
    run = ended.join(stop, key).filter(F.col("_stop").isNull() | (F.col(strategy) <= F.col("_stop")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), strategy, attempt))
    return run.withColumn("_r", rank).filter("_r = 1").select(*results.columns, "score")


BOX = "struct<x:int,y:int,w:int,h:int,ord:int>"


def _fold_boxes(df: DataFrame, image: str, rank: Column, clash) -> DataFrame:
    """Boxes (x, y, w, h, ord) kept in the order of rank unless they clash with a kept one."""
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h", "ord")])
    sorted_ = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("ord").alias("o"), box.alias("b"))))
    keep = lambda kept, item: F.when(F.exists(kept, lambda k: clash(item["b"], k)), kept).otherwise(F.concat(kept, F.array(item["b"])))
    kept = df.groupBy(image).agg(F.aggregate(sorted_, F.array().cast(f"array<{BOX}>"), keep).alias("kept"))
    return kept.select(image, F.inline("kept"))


def merge_boxes(df: DataFrame, image: str, share: float = 0.3) -> DataFrame:
    """Largest first, drops a box that a kept one covers by `share` of its own area."""
    return _fold_boxes(df, image, -(F.col("w") * F.col("h")), lambda b, k: overlaps(b, k) >= share * b["w"] * b["h"])


def suppress(df: DataFrame, image: str, share: float = 0.8) -> DataFrame:
    """Best score first, drops a box that shares `share` of the smaller area with a kept one."""
    return _fold_boxes(df, image, -F.col("score"), lambda b, k: overlaps(b, k) >= share * F.least(b["w"] * b["h"], k["w"] * k["h"]))


def candidate_boxes(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Contours of a thousandth to four fifths of the image, over 20 by 10 pixels."""
    share = F.col("w") * F.col("h") / (width * height)
    return df.filter(share.between(0.001, 0.8) & (F.col("w") > 20) & (F.col("h") > 10))


def element_kind(width: Column, height: Column) -> Column:
    """The kind of a region (x, y, w, h) from its shape and pixel features (std, edges, density, lines across and down): the first rule that holds."""
    c = F.col
    aspect, share, top = c("w") / F.greatest(c("h"), F.lit(1)), c("w") * c("h") / (width * height), c("y") / height
    return (
        F.when((aspect > 5) & (top < 0.15) & (share > 0.02), "navbar").when((aspect > 5) & (top > 0.85), "footer")
        .when((aspect > 1.5) & (aspect < 8) & (share < 0.02) & (c("h") > 20) & (c("h") < 80) & (c("std") < 50), "button")
        .when((aspect > 3) & (c("h") > 20) & (c("h") < 60) & (share < 0.03) & (c("edges") > 0.05), "input_field")
        .when((share > 0.03) & (c("density") < 0.1), "image").when((c("across") + c("down") > 6) & (c("across") > 2) & (c("down") > 2), "table").otherwise("text_block")
    )


def bordered_regions(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Regions of half a per cent of the image, 60 by 40 pixels, with line pixels both ways (counts across and down)."""
    area = F.col("w") * F.col("h")
    return df.filter((area >= 0.005 * width * height) & (F.col("w") >= 60) & (F.col("h") >= 40) & (F.col("across") / area > 0.005) & (F.col("down") / area > 0.005))


def borderless_tables(lines: DataFrame, image: str, width: Column, bordered: DataFrame | None = None, gap: int = 40, least: int = 3) -> DataFrame:
    """Text lines stacked closely: groups of three or more, their hull over 100 by 60 pixels, not 30 % inside a bordered table."""
    good = lines.filter((F.col("w") > 0.15 * width) & (F.col("h") > 8) & (F.col("h") < 60))
    w = Window.partitionBy(image).orderBy("y", "ord")
    between = F.col("y") - (F.lag("y").over(w) + F.lag("h").over(w))
    grouped = good.withColumn("new", F.when((between >= 0) & (between < gap), 0).otherwise(1)).withColumn("group", F.sum("new").over(w))
    hull = grouped.groupBy(image, "group").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    hull = hull.filter(F.col("n") >= least).select(image, "n", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))
    hull = hull.filter("w > 100 and h > 60")
    if bordered is None:
        return hull
    boxes = bordered.groupBy(image).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_b"))  # tables of one image
    own = F.struct("x", "y", "w", "h")
    inside = F.exists(F.coalesce("_b", F.array().cast("array<struct<x:int,y:int,w:int,h:int>>")), lambda b: overlaps(own, b) > 0.3 * F.col("w") * F.col("h"))
    return hull.join(boxes, image, "left").filter(~inside).drop("_b")


def mark_kind(df: DataFrame) -> DataFrame:
    """Check boxes and radio buttons among shapes (w, h, extent, circularity, fill)."""
    ratio = F.col("w") / F.col("h")
    good = F.col("w").between(10, 50) & F.col("h").between(10, 50) & ratio.between(0.7, 1.4) & (F.col("extent") >= 0.3)
    return df.filter(good).withColumns({"kind": F.when(F.col("circularity") > 0.75, "radio").otherwise("checkbox"), "checked": F.col("fill") > 0.4})


def field_kind(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Form fields among shapes (w, h, vertices, mean, std)."""
    share = F.col("w") * F.col("h") / (width * height)
    good = (F.col("w") >= 50) & F.col("h").between(15, 80) & share.between(0.001, 0.15) & (F.col("w") / F.col("h") >= 2) & F.col("vertices").between(4, 6)
    kind = F.when(F.col("h") > 50, "textarea").when((F.col("mean") > 200) & (F.col("std") < 30), "text_input").when(F.col("mean") > 150, "filled")
    return df.filter(good).withColumn("kind", kind).filter("kind is not null")


def _detected(images: DataFrame, key: str, boxes) -> DataFrame:
    """key, height, width, ord and the fields of each box; images: key, height, width, pixels (grey, 8 bits). Unreadable images have none."""
    ship(images.sparkSession)
    return images.select(key, "height", "width", F.posexplode(shapes.shape_udf(boxes)("height", "width", "pixels")).alias("ord", "s")).select(key, "height", "width", "ord", "s.*")


def detect_blocks(images: DataFrame, key: str) -> DataFrame:
    """key, x, y, w, h, ord: blocks of an image, those that a larger one covers by 30 % left out."""
    return merge_boxes(candidate_boxes(_detected(images, key, shapes.block_boxes), F.col("width"), F.col("height")), key)


def detect_bordered_tables(images: DataFrame, key: str) -> DataFrame:
    """key, x, y, w, h, ord: regions ruled across and down."""
    return bordered_regions(_detected(images, key, shapes.ruled_regions), F.col("width"), F.col("height")).select(key, "x", "y", "w", "h", "ord")


def larger_marks(marks: DataFrame, key: str) -> DataFrame:
    """Of marks that overlap at all, the largest stay."""
    kept = _fold_boxes(marks, key, -(F.col("w") * F.col("h")), lambda b, k: overlaps(b, k) > 0).select(key, "ord")
    return marks.join(kept, [key, "ord"], "left_semi")


def detect_marks(images: DataFrame, key: str) -> DataFrame:
    """key, x, y, w, h, ord, kind, checked, fill: check boxes and radio buttons, of overlapping ones the largest."""
    found = mark_kind(_detected(images, key, shapes.dark_shapes).filter("circularity is not null"))
    return larger_marks(found, key).select(key, "x", "y", "w", "h", "ord", "kind", "checked", F.round("fill", 3).alias("fill"))


def free_fields(fields: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """Fields of which no element (key, x, y, w, h) covers more than half."""
    boxes = elements.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")])).alias("_elements"))  # of one image
    none = F.array().cast("array<struct<x:int,y:int,w:int,h:int>>")
    covered = F.exists(F.coalesce("_elements", none), lambda e: overlaps(F.struct("x", "y", "w", "h"), e) > 0.5 * F.col("w") * F.col("h"))
    return fields.join(boxes, key, "left").filter(~covered).drop("_elements")


def detect_fields(images: DataFrame, key: str, elements: DataFrame | None = None) -> DataFrame:
    """key, x, y, w, h, ord, kind: form fields by their edges, without those that an element covers by more than half."""
    found = field_kind(_detected(images, key, shapes.edge_shapes), F.col("width"), F.col("height")).select(key, "x", "y", "w", "h", "ord", "kind")
    return found if elements is None else free_fields(found, elements, key)


def line_positions(profile: DataFrame, key: str, at: str, value: str, above: float) -> DataFrame:
    """Midpoints of runs of a projection profile that are above a threshold."""
    w = Window.partitionBy(key).orderBy(at)
    on = profile.filter(F.col(value) > above).withColumn("run", F.sum(F.when(F.col(at) - F.lag(at).over(w) == 1, 0).otherwise(1)).over(w))
    return on.groupBy(key, "run").agg(F.floor((F.min(at) + F.max(at)) / 2).alias("mid")).select(key, "mid")


def cell_grid(rows: DataFrame, columns: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Cells between neighbouring row lines and column lines of one table; those under ten pixels go."""
    def spans_(df: DataFrame, a: str, b: str, n: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("mid")
        return df.select(key, F.col("mid").alias(a), F.lead("mid").over(w).alias(b), (F.row_number().over(w) - 1).alias(n)).filter(F.col(b) - F.col(a) >= least)

    return spans_(rows, "y1", "y2", "row").join(spans_(columns, "x1", "x2", "col"), key)


def dense_table(cells: DataFrame, key: str) -> DataFrame:
    """Cells (row, col, text) as a grid with '' in gaps, and the grid as tab-separated lines."""
    size = cells.groupBy(key).agg(F.max("row").alias("r"), F.max("col").alias("c"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "row", "col"), "text"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.col("r")), lambda i: F.transform(F.sequence(F.lit(0), F.col("c")), lambda j: F.coalesce(F.element_at("m", F.concat_ws(",", i, j)), F.lit(""))))
    done = size.select(key, grid.alias("rows"), (F.col("r") + 1).alias("num_rows"), (F.col("c") + 1).alias("num_cols"))
    return done.withColumn("raw_text", F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n"))
