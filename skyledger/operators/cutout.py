"""Cutouts from requests: units of files, boxes, copied and cut units, headers, and whole products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import requests as rq
from ..functions.once import once
from ..scratch import stored
from ..sources import fits_store as fs
from . import headers as hd
from . import pixels as px

BOX = "struct<xmin:bigint,ymin:bigint,xmax:bigint,ymax:bigint>"


def with_box(rows: DataFrame) -> DataFrame:
    """Add `box`, clamped to the image, and `box_status`: 400 for a bad centre or size, 500 off scale or without overlap.

    `centre` and `size` are parsed coordinates, each in pixels or in units of the sky; the
    coordinate system and the sides of the image are columns.
    """
    c, z = F.col("centre"), F.col("size")
    rows = once(
        rows,
        at_pixel=c["units"] == "pixel",
        in_pixels=z["units"] == "pixel",
        c0=F.when(c["units"] == "pixel", c["c0"]).otherwise(g.norm_ra(rq.unit_to_deg(c["c0"], c["units"]))),
        c1=F.when(c["units"] == "pixel", c["c1"]).otherwise(rq.unit_to_deg(c["c1"], c["units"])),
        w=F.when(z["units"] == "pixel", z["c0"]).otherwise(rq.unit_to_rad(z["c0"], z["units"])) / 2,
        h=F.when(z["units"] == "pixel", z["c1"]).otherwise(rq.unit_to_rad(z["c1"], z["units"])) / 2,
    )
    rows = once(rows, place=F.when(~F.col("at_pixel"), g.sky_to_pixel(F.col("c0"), F.col("c1"))))
    rows = once(rows, x0=F.when(F.col("at_pixel"), F.col("c0")).otherwise(F.col("place.x")), y0=F.when(F.col("at_pixel"), F.col("c1")).otherwise(F.col("place.y")))

    def edge(axis: str, k: int) -> Column:
        own, half = F.col(f"{axis}0"), F.col("w" if axis == "x" else "h")
        return F.when(F.col("in_pixels"), g.pixcen(own + k * half)).otherwise(g.pixel_search(F.col("x0"), F.col("y0"), axis, k, half))

    rows = once(rows, **{f"{a}{n}": edge(a, k) for a in "xy" for k, n in ((-1, "lo"), (1, "hi"))})
    rows = once(rows, found=g.clamp_box(F.col("xlo"), F.col("ylo"), F.col("xhi"), F.col("yhi"), F.col("naxis1"), F.col("naxis2")))
    bad = c.isNull() | z.isNull() | (~F.col("at_pixel") & ~g.check_dec(F.col("c1"))) | (F.col("w") < 0) | (F.col("h") < 0)
    status = F.when(F.coalesce(bad, F.lit(True)), 400).when(F.col("x0").isNull() | F.col("found").isNull(), 500).otherwise(200)
    rows = rows.withColumns({"box": F.when(status == 200, F.col("found")).cast(BOX), "box_status": status})
    return rows.drop("at_pixel", "in_pixels", "c0", "c1", "w", "h", "place", "x0", "y0", "xlo", "xhi", "ylo", "yhi", "found")


def join_request_hdus(requests: DataFrame, hdus: DataFrame) -> DataFrame:
    """Each request with every unit of its file, and what is to be done with it."""
    return requests.join(hdus, "image_id").withColumn("kind", hd.hdu_kind(F.col("ext_type"), F.col("naxes")))


def union_product(copied: DataFrame, cut: DataFrame) -> DataFrame:
    """Units of a product: copied and cut ones together, by their number in the file."""
    columns = ["request_id", "image_id", "hdu_num", "kind", "naxes", "box"]
    return copied.withColumn("box", F.lit(None).cast(BOX)).select(*columns).unionByName(cut.select(*columns))


def cutout(requests: DataFrame, hdus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, status) of every request, and the units of the products of those that succeed.

    One unit that can't be cut fails its request, and the first one's status counts. The boxes of
    the units meet the tiles later. Requests with their units and boxes are worked out once and kept.
    """
    rows = join_request_hdus(requests, hdus).withColumns({"naxis1": F.get("naxes", 0), "naxis2": F.get("naxes", 1)})
    rows = with_box(rows).select("request_id", "image_id", "hdu_num", "kind", "naxes", F.when(F.col("kind") == "cut", F.col("box")).alias("box"), F.when(F.col("kind") == "copy", 200).when(F.col("kind") == "error", 500).otherwise(F.col("box_status")).alias("unit_status"))
    rows = stored(rows, "units")
    failed = rows.where("unit_status <> 200").groupBy("request_id").agg(F.min_by("unit_status", "hdu_num").alias("bad"))
    status = requests.select("request_id").join(failed, "request_id", "left").select("request_id", F.coalesce("bad", F.lit(200)).alias("status"))
    fine = rows.join(failed.select("request_id"), "request_id", "left_anti")
    new = F.array((F.col("box.xmax") - F.col("box.xmin") + 1), (F.col("box.ymax") - F.col("box.ymin") + 1))
    return status, union_product(fine.where("kind = 'copy'"), fine.where("kind = 'cut'").withColumn("naxes", new))


def cut_pixels(units: DataFrame, tiled: DataFrame) -> DataFrame:
    """(request_id, hdu_num, x, y, v) of the cut units, at their new places."""
    boxes = units.where("kind = 'cut'").select("request_id", "hdu_num", "image_id", "box.*")
    rows = px.join_box_tiles(boxes, tiled, keep=["request_id", "hdu_num"])
    return rows.select("request_id", "hdu_num", (F.col("x") - F.col("xmin") + 1).alias("x"), (F.col("y") - F.col("ymin") + 1).alias("y"), "v")


def product_headers(units: DataFrame, keywords: DataFrame) -> DataFrame:
    """(request_id, hdu_num, content) of every unit's header: the cards as they are, but for those that a cut changes."""
    rows = keywords.join(units.select("request_id", "path", "hdu_num", (F.col("kind") == "cut").alias("is_cut"), "box.*"), ["path", "hdu_num"])
    rows = rows.where(~F.col("is_cut") | ~F.col("name").isin(hd.DROPPED))
    new = F.when(F.col("is_cut"), hd.rewrite_value()).otherwise(F.col("value"))
    card = F.when(new.eqNullSafe(F.col("value")), F.col("card")).otherwise(hd.card_format(F.col("name"), new, F.col("comment")))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("pos", card.alias("card")))), lambda x: x["card"])
    return rows.groupBy("request_id", "hdu_num").agg(fs.header_text(cards).alias("content"))


def packed_headers(units: DataFrame, keywords: DataFrame) -> DataFrame:
    """(request_id, hdu_num, content) of cut units that were compressed: the image's own header, as an extension."""
    cut = units.select("request_id", F.col("path").alias("image_id"), "hdu_num", "box.*")
    own = keywords.withColumnRenamed("path", "image_id").join(cut.select("image_id", "hdu_num").distinct(), ["image_id", "hdu_num"], "left_semi")
    plain = hd.union_header(hd.plain_header(own))
    rows = hd.filter_keywords_drop(plain).join(cut, ["image_id", "hdu_num"])
    value = F.when(F.col("name") == "XTENSION", "'IMAGE   '").otherwise(hd.rewrite_value())
    card = hd.card_format(F.col("name"), value, F.lit(""))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("pos", card.alias("card")))), lambda x: x["card"])
    return rows.groupBy("request_id", "hdu_num").agg(fs.header_text(cards).alias("content"))


def packed_parts(units: DataFrame, keywords: DataFrame, tiles: DataFrame) -> DataFrame:
    """Parts of cut units that were compressed, for write_products: `units` have tile_w and tile_h, `tiles` are those of scan_packed_tiles."""
    head = packed_headers(units, keywords).select("request_id", "hdu_num", F.lit(0).cast("long").alias("part"), "content")
    boxes = units.select("request_id", "path", "hdu_num", "tile_w", "tile_h", "box.*")
    cut = px.cut_rows(boxes, tiles, ["request_id", "hdu_num"], None).select("request_id", "hdu_num", F.col("y").alias("part"), "content")
    return head.unionByName(cut).withColumn("path", F.concat(F.col("request_id").cast("string"), F.lit(".fits")))


def product_parts(units: DataFrame, source: DataFrame, keywords: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Parts of the products for write_products.

    `units` are those of cutout() with the `path` of their file, `source` the file's units, `tiles`
    their pixels. Part 0 of a unit is its header. Copied data follow in runs of bytes, cut ones as
    rows of pixels, which stay bytes from the tile to the product.
    """
    head = product_headers(units, keywords).select("request_id", "hdu_num", F.lit(0).cast("long").alias("part"), "content")
    copied = units.where("kind = 'copy'").select("request_id", "path", "hdu_num").join(source.select("path", "hdu_num", "data_at", "data_bytes"), ["path", "hdu_num"])
    raw = fs.raw_parts(copied, ["request_id", "hdu_num"])
    boxes = units.where("kind = 'cut'").select("request_id", "path", "hdu_num", "box.*")
    cut = px.cut_rows(boxes, tiles, ["request_id", "hdu_num"], tile).select("request_id", "hdu_num", F.col("y").alias("part"), "content")
    return head.unionByName(raw).unionByName(cut).withColumn("path", F.concat(F.col("request_id").cast("string"), F.lit(".fits")))


def radius_boxes(rows: DataFrame) -> DataFrame:
    """The box of a radius (`width`, in degrees) round a sky position, clamped to the image; images that it misses go."""
    rows = with_radius(rows).where("box IS NOT NULL")
    return rows.select("image_id", "crpix1", "crpix2", "box.*")


def with_radius(rows: DataFrame) -> DataFrame:
    """Add `box`: that of a radius (`width`, in degrees) round a sky position (`ra`, `dec`), clamped; null where the image is missed."""
    rows = once(rows, p=g.sky_to_pixel(F.col("ra"), F.col("dec")))
    rows = once(rows, x0=F.col("p.x"), y0=F.col("p.y"))
    rows = once(rows, **{f"{a}{n}": g.radius_bounds(F.col("x0"), F.col("y0"), a, k, F.radians("width")) for a in "xy" for k, n in ((-1, "lo"), (1, "hi"))})
    rows = once(rows, box=g.clamp_box(F.col("xlo"), F.col("ylo"), F.col("xhi"), F.col("yhi"), F.col("naxis1"), F.col("naxis2")))
    return rows.drop("p", "x0", "y0", "xlo", "xhi", "ylo", "yhi")


# How the types of the sky's two axes begin.
LNG, LAT = "^(RA--|.LON|..LN)", "^(DEC-|.LAT|..LT)"


def world(keywords: DataFrame) -> DataFrame:
    """The coordinate system of every unit that has one of the sky: which axes of the array (from 0) are
    its longitude and latitude, and the tangent plane's numbers for these two, whatever their order."""
    own = keywords.where(F.col("name").rlike("^(CTYPE|CRVAL|CRPIX|CDELT)[0-9]+$|^CD[0-9]+_[0-9]+$"))
    own = own.groupBy("path", "hdu_num", "name").agg(F.min_by("value", "pos").alias("value"))
    rows = own.groupBy("path", "hdu_num").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    axis = lambda kind: F.array_min(F.transform(F.filter(F.map_entries("m"), lambda e: e["key"].startswith("CTYPE") & F.trim(F.regexp_replace(e["value"], "'", "")).rlike(kind)), lambda e: F.substring(e["key"], 6, 9).cast("int")))
    rows = rows.withColumns({"a": axis(LNG), "b": axis(LAT)}).where("a IS NOT NULL AND b IS NOT NULL")
    text = lambda c: c.cast("string")
    value = lambda *name: F.try_element_at("m", F.concat(*[F.lit(x) if isinstance(x, str) else text(x) for x in name])).try_cast("double")
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    cd = lambda i, j, step: F.coalesce(value("CD", i, "_", j), step)
    numbers = {"crval1": value("CRVAL", a), "crval2": value("CRVAL", b), "crpix1": value("CRPIX", a), "crpix2": value("CRPIX", b), "cd11": cd(a, a, value("CDELT", a)), "cd12": cd(a, b, zero), "cd21": cd(b, a, zero), "cd22": cd(b, b, value("CDELT", b))}
    return rows.select("path", "hdu_num", (a - 1).alias("lng"), (b - 1).alias("lat"), *[c.alias(n) for n, c in numbers.items()])


def radius_ranges(units: DataFrame, systems: DataFrame, targets: DataFrame) -> DataFrame:
    """What a radius cutout does with every unit, and the range of each axis.

    `targets` are (path, ra, dec, width), in degrees. Only the sky's axes are cut. Tables, images
    of fewer than two axes or without pixels, and units without sky axes are copied; `missed` ones
    do not reach the place.
    """
    # all grow with the files, and cards pack so well that their tables look small enough to broadcast
    rows = units.join(targets.hint("merge"), "path").join(systems.hint("merge"), ["path", "hdu_num"], "left")
    rows = with_radius(rows.withColumns({"naxis1": F.get("naxes", F.col("lng")), "naxis2": F.get("naxes", F.col("lat"))}))
    fit = (F.col("ext_type") == "image") & (F.size("naxes") >= 2) & (F.array_min("naxes") > 0) & F.col("naxis1").isNotNull() & F.col("naxis2").isNotNull()
    kind = F.when(~F.coalesce(fit, F.lit(False)), "copy").when(F.col("box").isNull(), "missed").otherwise("cut")
    edge = lambda end, whole: F.transform("naxes", lambda n, i: F.when(i == F.col("lng"), F.col(f"box.x{end}")).when(i == F.col("lat"), F.col(f"box.y{end}")).otherwise(whole(n)))
    one = F.lit(1).cast("long")
    rows = rows.withColumns({"kind": kind, "first": edge("min", lambda n: one), "last": edge("max", lambda n: n)})
    return rows.select("path", "hdu_num", "bitpix", "naxes", "lng", "lat", "kind", "first", "last", "box")


def radius_headers(ranges: DataFrame, keywords: DataFrame) -> DataFrame:
    """(path, hdu_num, content) of the cut units: a new image's own cards, then the source's whose names it lacks, with the places of the sky's axes moved."""
    cut = ranges.where("kind = 'cut'")
    sides = F.zip_with("first", "last", lambda a, b: b - a + 1)
    card = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    begin = F.when(F.col("hdu_num") == 1, card(F.lit("SIMPLE"), F.lit("T"))).otherwise(card(F.lit("XTENSION"), F.lit("'IMAGE   '")))
    end = F.when(F.col("hdu_num") == 1, F.array(card(F.lit("EXTEND"), F.lit("T")))).otherwise(F.array(card(F.lit("PCOUNT"), F.lit("0")), card(F.lit("GCOUNT"), F.lit("1"))))
    own = F.concat(F.array(begin, card(F.lit("BITPIX"), F.col("bitpix").cast("string")), card(F.lit("NAXIS"), F.size("naxes").cast("string"))), F.transform(sides, lambda n, i: card(F.concat(F.lit("NAXIS"), (i + 1).cast("string")), n.cast("string"))), end)
    new = cut.select(F.col("path").alias("image_id"), "hdu_num", F.posexplode(own).alias("pos", "c")).select("image_id", "hdu_num", "pos", "c.*")
    source = keywords.where(~F.col("name").isin("SIMPLE", "XTENSION", "PCOUNT", "GCOUNT", "EXTEND") & (F.col("name") != "")).withColumnRenamed("path", "image_id")
    kept = hd.join_keywords_new(source, new).join(cut.select(F.col("path").alias("image_id"), "hdu_num", "lng", "lat", "box").hint("merge"), ["image_id", "hdu_num"])
    name, number = F.col("name"), F.col("value").try_cast("double")
    moved = lambda axis, lo: F.when(name == F.concat(F.lit("CRPIX"), (F.col(axis) + 1).cast("string")), F.format_string("%.8E", (number + 1 - F.col(lo)).cast("float")))
    value = F.coalesce(moved("lng", "box.xmin"), moved("lat", "box.ymin"))
    card_text = F.when(value.isNull(), F.col("card")).otherwise(hd.card_format(name, value, F.col("comment")))
    rows = new.select("image_id", "hdu_num", F.col("pos").cast("int").alias("at"), hd.card_format(name, F.col("value"), F.lit("")).alias("card")).unionByName(kept.select("image_id", "hdu_num", (F.col("pos") + 1000).alias("at"), card_text.alias("card")))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("at", "card"))), lambda x: x["card"])
    return rows.groupBy(F.col("image_id").alias("path"), "hdu_num").agg(fs.header_text(cards).alias("content"))


def radius_parts(ranges: DataFrame, source: DataFrame, keywords: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """Parts of the products of radius cutouts, for write_products: copied units as they are, cut ones plane by plane."""
    head = radius_headers(ranges, keywords).withColumn("part", F.lit(0).cast("long"))
    copied = source.join(ranges.where("kind = 'copy'").select("path", "hdu_num").hint("merge"), ["path", "hdu_num"], "left_semi")
    text = copied.select("path", "hdu_num", fs.header_text(F.col("cards")).alias("content"), F.lit(0).cast("long").alias("part"))
    raw = fs.raw_parts(copied.withColumn("file", F.col("path")), ["file", "hdu_num"]).withColumnRenamed("file", "path")
    boxes = px.planes_of(ranges.where("kind = 'cut'")).select("path", F.col("path").alias("file"), "hdu_num", "plane", "xmin", "ymin", "xmax", "ymax", F.get("naxes", 1).alias("n2"))
    cut = px.cut_rows(boxes, tiles, ["file", "hdu_num", "n2"], tile)
    cut = cut.select(F.col("file").alias("path"), "hdu_num", "content", (F.col("plane") * F.col("n2") + F.col("y")).alias("part"))
    return head.unionByName(text).unionByName(raw).unionByName(cut)
