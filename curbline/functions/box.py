"""Bounding boxes as column expressions. A box is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Intersection over union (+ eps); 0 where boxes do not overlap or have no area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / (union + eps)).otherwise(F.lit(0.0))


def pixels_to_centre(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Normalised centre and size of a pixel box."""
    return F.struct(((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"))


def coco_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel x, y, width, height clamped to the image, to two decimals."""
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    x1, y1 = clamp((cx - w / 2) * width, width), clamp((cy - h / 2) * height, height)
    x2, y2 = clamp((cx + w / 2) * width, width), clamp((cy + h / 2) * height, height)
    return F.struct(F.round(x1, 2).alias("x"), F.round(y1, 2).alias("y"), F.round(x2 - x1, 2).alias("w"), F.round(y2 - y1, 2).alias("h"))


def percent_box(b: Column) -> Column:
    """x, y, width, height in percent of the image."""
    return F.struct((b["x1"] * 100).alias("x"), (b["y1"] * 100).alias("y"), ((b["x2"] - b["x1"]) * 100).alias("width"), ((b["y2"] - b["y1"]) * 100).alias("height"))


def size_bucket(area_share: Column) -> Column:
    # Upper bounds of the size classes.
    return F.when(area_share < 0.001, "tiny").when(area_share < 0.005, "small").when(area_share < 0.02, "medium").otherwise("large")


def aspect(w: Column, h: Column) -> Column:
    return F.when(h > 0, w / h).otherwise(F.lit(0.0))


def thumbnail(b: Column, width: Column, height: Column, pad: float = 0.4, most_w: int = 320, most_h: int = 240) -> Column:
    """The padded crop of a normalised box in pixels and its scale to fit; the pixels are somebody else's."""
    w, h = (b["x2"] - b["x1"]) * width, (b["y2"] - b["y1"]) * height
    x1, y1 = F.greatest(F.lit(0.0), b["x1"] * width - pad * w), F.greatest(F.lit(0.0), b["y1"] * height - pad * h)
    x2, y2 = F.least(width, b["x2"] * width + pad * w), F.least(height, b["y2"] * height + pad * h)
    scale = F.least(F.lit(1.0), most_w / F.greatest(x2 - x1, F.lit(1.0)), most_h / F.greatest(y2 - y1, F.lit(1.0)))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), scale.alias("scale"))


def context_patch(cell: Column, half: Column, width: Column, height: Column) -> Column:
    """The square of half a side around a cell's centre in whole pixels, cut at the image; null if under 4 pixels either way."""
    cx, cy = (cell["x1"] + cell["x2"]) / 2, (cell["y1"] + cell["y2"]) / 2
    whole = lambda v: v.cast("int")
    x1, y1 = whole(F.greatest(F.lit(0.0), cx - half)), whole(F.greatest(F.lit(0.0), cy - half))
    x2, y2 = whole(F.least(width.cast("double"), cx + half)), whole(F.least(height.cast("double"), cy + half))
    return F.when((x2 - x1 >= 4) & (y2 - y1 >= 4), box(x1, y1, x2, y2))


def grid_cells(width: Column, height: Column, stride: int) -> Column:
    """The cell boxes of a tiling, as an array: cells past the edge are cut at it."""
    xs = F.sequence(F.lit(0), F.greatest(F.ceil(width / stride) - 1, F.lit(0)).cast("int"))
    ys = F.sequence(F.lit(0), F.greatest(F.ceil(height / stride) - 1, F.lit(0)).cast("int"))
    cell = lambda i, j: box((i * stride).cast("double"), (j * stride).cast("double"), F.least((i + 1) * stride, width).cast("double"), F.least((j + 1) * stride, height).cast("double"))
    return F.flatten(F.transform(ys, lambda j: F.transform(xs, lambda i: cell(i, j))))
