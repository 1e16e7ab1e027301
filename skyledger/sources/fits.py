"""Tables as FITS images, pixels of tiles, listings of stored files, and whole files on request.

Files are read by byte ranges in fits_store, which also writes what is made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.requests import content_type
from ..operators.headers import card_format
from .fits_store import TYPES, header_text, relative


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """Files with their length, and all directories above them up to the root, as paths from the root; directories end in /."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.select(relative(F.col("path"), root).alias("path"), "length")
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n > 0, "/").otherwise("")))
    return files.unionAll(files.select(F.explode(ups).alias("path")).distinct().select("path", F.lit(None).cast("long")))


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """One row a pixel of a plane's tiles, with whole numbers kept whole. Tiles that could not be read have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                v = np.frombuffer(r.data, TYPES[r.bitpix])
                at = np.arange(len(v))
                whole = r.bitpix > 0
                yield pd.DataFrame({"path": r.path, "hdu_num": r.hdu_num, "plane": r.plane, "x": r.x0 + at % r.width, "y": r.y0 + at // r.width, "raw_int": v.astype("int64") if whole else pd.array([None] * len(v), "Int64"), "raw_float": None if whole else v.astype("float64")})

    ok = tiles.where("status = 'ok'").drop("status", "error")
    return ok.mapInPandas(run, "path string, hdu_num int, plane bigint, x bigint, y bigint, raw_int bigint, raw_float double")


def packed(width: Column, places: Column, values: Column, bitpix: int, blank: float = 0) -> Column:
    """A row of `width` pixels as big-endian bytes: values at their places (from 1), else `blank`."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for widths, xs, vs in batches:
            out = []
            for n, x, v in zip(widths.to_pylist(), xs.to_pylist(), vs.to_pylist(), strict=True):
                row = np.full(n, blank, TYPES[bitpix])
                if x:
                    row[np.asarray(x) - 1] = v
                out.append(row.tobytes())
            yield pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(width, places, values)


def sink_fits(pixels: DataFrame, bitpix: int = -32, blank: float = 0, cards: Column | None = None) -> DataFrame:
    """Parts for write_products of two-dimensional images from their pixels (path, hdu_num, x, y, v).

    Rows of pixels are put together, not images: a place without a pixel is `blank`. `cards` are more
    cards for all headers. Unit 1 is a file's first, others are extensions.
    """
    sides = pixels.groupBy("path", "hdu_num").agg(F.max("x").alias("nx"), F.max("y").alias("ny"))
    text = lambda c: F.col(c).cast("string")
    card = lambda n, v: card_format(F.lit(n), v, F.lit(""))
    first = F.when(F.col("hdu_num") == 1, card("SIMPLE", F.lit("T"))).otherwise(card("XTENSION", F.lit("'IMAGE'")))
    own = F.array(first, card("BITPIX", F.lit(str(bitpix))), card("NAXIS", F.lit("2")), card("NAXIS1", text("nx")), card("NAXIS2", text("ny")))
    own = F.concat(own, F.when(F.col("hdu_num") == 1, F.array().cast("array<string>")).otherwise(F.array(card("PCOUNT", F.lit("0")), card("GCOUNT", F.lit("1")))))
    head = sides.select("path", "hdu_num", F.lit(0).cast("long").alias("part"), header_text(own if cards is None else F.concat(own, cards)).alias("content"))
    lines = pixels.groupBy("path", "hdu_num", F.col("y").alias("part")).agg(F.collect_list(F.struct("x", "v")).alias("line"))
    rows = sides.select("path", "hdu_num", "nx", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ny").cast("long"))).alias("part")).join(lines, ["path", "hdu_num", "part"], "left")
    return head.unionByName(rows.select("path", "hdu_num", "part", packed(F.col("nx"), F.col("line.x"), F.col("line.v"), bitpix, blank).alias("content")))


def fetch_file(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted files' content, length and type."""
    return files.join(requests.select("path").distinct(), "path", "left_semi").select("path", F.length("content").alias("length"), content_type(F.col("path")).alias("type"), "content")
