"""Pixel operators: boxes, strides, tiles, overlays and assembled images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 4


def filter_box(rows: DataFrame, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    return rows.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def filter_strided(rows: DataFrame, first: dict[str, int], last: dict[str, int], step: dict[str, int]) -> DataFrame:
    """Every step-th place of each axis from first to last."""
    for axis in first:
        c = F.col(axis)
        rows = rows.where(c.between(first[axis], last[axis]) & (F.pmod(c - first[axis], F.lit(step[axis])) == 0))
    return rows


def tiles(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """Pixels packed into tiles: one row a tile, values as structs."""
    at = lambda c: F.floor((F.col(c) - 1) / size).cast("int")
    return pixels.groupBy("image_id", at("x").alias("tile_x"), at("y").alias("tile_y")).agg(F.collect_list(F.struct("x", "y", "v")).alias("data"))


def join_box_tiles(boxes: DataFrame, tiled: DataFrame, size: int = TILE, keep: list[str] | None = None) -> DataFrame:
    """Boxes meet the tiles that they cover by equal tile numbers, then their pixels."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - 1) / size).cast("int"), F.floor((F.col(hi) - 1) / size).cast("int"))
    wanted = boxes.withColumn("tile_x", F.explode(span("xmin", "xmax"))).withColumn("tile_y", F.explode(span("ymin", "ymax")))
    rows = wanted.join(tiled, ["image_id", "tile_x", "tile_y"]).select(*(keep or []), "image_id", "xmin", "ymin", "xmax", "ymax", F.inline("data"))
    return filter_box(rows, F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))


def join_overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pixels of an image with those of a subset written over them."""
    over = new.withColumnRenamed("v", "new_v")
    return old.join(over, ["image_id", "x", "y"], "left").withColumn("v", F.coalesce("new_v", "v")).drop("new_v")


def agg_any_null(rows: DataFrame, null_value: float) -> DataFrame:
    """Nulls replaced, and whether there were any."""
    return rows.groupBy("image_id").agg(F.bool_or(F.col("v").isNull()).alias("any_null"), F.min(F.coalesce("v", F.lit(null_value))).alias("low"), F.max(F.coalesce("v", F.lit(null_value))).alias("high"), F.count("*").alias("n"))


def agg_subset_bytes(boxes: DataFrame, pixel_size: int) -> DataFrame:
    side = F.array(F.col("xmax") - F.col("xmin") + 1, F.col("ymax") - F.col("ymin") + 1)
    return boxes.select("image_id", F.aggregate(side, F.lit(pixel_size).cast("long"), lambda a, b: a * b).alias("n_bytes"))


def cut_rows(boxes: DataFrame, tiles: DataFrame, keep: list[str], tile: int | None) -> DataFrame:
    """Rows of pixels of boxes (path, hdu_num, xmin ...), as bytes, from binary tiles.

    Boxes meet the tiles that they cover by equal numbers; each gives the part of its pixel rows
    that lies in the box, and the parts of a row, as many as tiles lie side by side, are put
    together. Without `tile` the boxes have the tiles' sides, tile_w and tile_h. Boxes with a `plane` take that one of an image of more axes, others all of them. The
    result has `keep`, plane, y (from 1 in the box) and content.
    """
    side = lambda c: F.col(c) if tile is None else F.lit(tile)
    span = lambda lo, hi, n: F.sequence(F.floor((F.col(lo) - 1) / n).cast("int"), F.floor((F.col(hi) - 1) / n).cast("int"))
    wanted = boxes.withColumn("tile_x", F.explode(span("xmin", "xmax", side("tile_w")))).withColumn("tile_y", F.explode(span("ymin", "ymax", side("tile_h"))))
    met = wanted.hint("merge").join(tiles.drop("status", "error"), ["path", "hdu_num", *["plane"] * ("plane" in boxes.columns), "tile_x", "tile_y"])
    last = lambda x0, n: F.col(x0) + F.col(n) - 1
    met = met.withColumns({"lo": F.greatest("xmin", "x0"), "hi": F.least("xmax", last("x0", "width")), "bytes": F.abs("bitpix") / 8})
    met = met.withColumn("row", F.explode(F.sequence(F.greatest("ymin", "y0"), F.least("ymax", last("y0", "height")))))
    start = ((F.col("row") - F.col("y0")) * F.col("width") + F.col("lo") - F.col("x0")) * F.col("bytes") + 1
    part = F.substring("data", start.cast("int"), ((F.col("hi") - F.col("lo") + 1) * F.col("bytes")).cast("int"))
    rows = met.groupBy(*keep, "plane", (F.col("row") - F.col("ymin") + 1).alias("y")).agg(F.array_sort(F.collect_list(F.struct("tile_x", part.alias("part")))).alias("parts"))
    return rows.select(*keep, "plane", "y", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["part"])).alias("content"))


def planes_of(ranges: DataFrame) -> DataFrame:
    """Boxes of images of any number of axes (naxes, first and last, from 1) as one box for each plane
    of the first two axes: plane, the place of its other axes with the first of them running fastest, xmin ..."""
    n = F.col("naxes")
    stride = lambda j: F.aggregate(F.slice(n, 3, j - 2), F.lit(1).cast("long"), lambda a, b: a * b)
    every = F.sequence(F.lit(0).cast("long"), stride(F.size(n)) - 1)
    inside = lambda p: F.forall(F.sequence(F.lit(2), F.greatest(F.size(n) - 1, F.lit(2))), lambda j: (j >= F.size(n)) | (F.floor(p / stride(j)) % F.get(n, j) + 1).between(F.get("first", j), F.get("last", j)))
    edges = [F.get(c, i).alias(f"{'xy'[i]}{m}") for c, m in (("first", "min"), ("last", "max")) for i in (0, 1)]
    return ranges.select("*", F.explode(F.filter(every, inside)).alias("plane")).select("*", *edges)


def from_bytes(content: Column, bitpix: int) -> Column:
    """Numbers of big-endian bytes, as doubles."""
    kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix]

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([None if x is None else np.frombuffer(x, kind).astype(float) for x in batch.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(content)
