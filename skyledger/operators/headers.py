"""Header operators: cards, dropped and rewritten keywords, positions, drift and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords that a cut image never keeps, and those of a compressed one.
DROPPED = ["CHECKSUM", "DATASUM"]
DROPPED_COMPRESSED = ["EXTEND", "PCOUNT", "GCOUNT"]
# Bytes of a card and of a block, and keywords that hold free text.
CARD, BLOCK = 80, 2880
FREE = ["COMMENT", "HISTORY", ""]


# How the comments begin that a compressed image does not keep.
DROPPED_COMMENTS = ["FITS (Flexible Image Transport System) format is", "and Astrophysics', volume 376, page 3"]


def filter_keywords_drop(rows: DataFrame, compressed: bool = False) -> DataFrame:
    rows = rows.where(~F.col("name").isin(DROPPED + (DROPPED_COMPRESSED if compressed else [])))
    for text in DROPPED_COMMENTS if compressed else []:
        rows = rows.where((F.col("name") != "COMMENT") | ~F.col("value").startswith(text))
    return rows


def rewrite_value(box: dict[str, Column] | None = None) -> Column:
    """The value of a keyword in a cut image: sides, and shifted reference places."""
    b = box or {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    name, value = F.col("name"), F.col("value").try_cast("double")
    shifted = lambda x: F.format_string("%.15E", x)
    return (
        F.when(name == "NAXIS1", (b["xmax"] - b["xmin"] + 1).cast("string"))
        .when(name == "NAXIS2", (b["ymax"] - b["ymin"] + 1).cast("string"))
        .when(name == "LTV1", shifted(value + b["xmin"] - 1))
        .when(name == "LTV2", shifted(value + b["ymin"] - 1))
        .when(name.rlike("^CRPIX1[A-Z]?$"), shifted(value + 1 - b["xmin"]))
        .when(name.rlike("^CRPIX2[A-Z]?$"), shifted(value + 1 - b["ymin"]))
        .otherwise(F.col("value"))
    )


def rewrite_header(keywords: DataFrame, boxes: DataFrame) -> DataFrame:
    # a box for each image: too many to broadcast, whatever their estimated size
    own = boxes.select("image_id", "xmin", "ymin", "xmax", "ymax").hint("merge")
    rows = filter_keywords_drop(keywords).join(own, "image_id")
    return rows.select("image_id", "hdu_num", "pos", "name", rewrite_value().alias("value"))


def union_header(keywords: DataFrame) -> DataFrame:
    """A plain image header of a compressed one: kept cards, with XTENSION first, PCOUNT and GCOUNT behind NAXIS2; numbered anew."""
    new = lambda n, x, k: F.struct(F.lit(n).alias("name"), F.lit(x).alias("value"), k.alias("key"))
    own, at = F.struct("name", "value", F.col("pos").cast("double").alias("key")), F.col("pos")
    more = F.array(own, new("XTENSION", "IMAGE", F.lit(0.0)), new("PCOUNT", "0", at + 0.1), new("GCOUNT", "1", at + 0.2))
    rows = filter_keywords_drop(keywords, True).where("name <> 'SIMPLE'")
    rows = rows.select("image_id", "hdu_num", F.inline(F.when(F.col("name") == "NAXIS2", more).otherwise(F.array(own))))
    return rows.select("image_id", "hdu_num", F.row_number().over(Window.partitionBy("image_id", "hdu_num").orderBy("key")).alias("pos"), "name", "value")


# What stands for a plain image's keyword in a compressed one, in the order that a header begins with.
PLAIN = {"ZSIMPLE": "SIMPLE", "ZTENSION": "XTENSION", "ZBITPIX": "BITPIX", "ZNAXIS": "NAXIS", "ZNAXIS1": "NAXIS1", "ZNAXIS2": "NAXIS2", "ZNAXIS3": "NAXIS3", "ZEXTEND": "EXTEND", "ZBLOCKED": "BLOCKED", "ZPCOUNT": "PCOUNT", "ZGCOUNT": "GCOUNT", "ZHECKSUM": "CHECKSUM", "ZDATASUM": "DATASUM"}
# Keywords of the table that holds a compressed image.
OF_TABLE = "XTENSION|BITPIX|NAXIS[0-9]*|PCOUNT|GCOUNT|TFIELDS|THEAP|CHECKSUM|DATASUM|T(?:TYPE|FORM|UNIT|SCAL|ZERO|NULL|DISP|DIM)[0-9]+|ZIMAGE|ZCMPTYPE|ZQUANTIZ|ZDITHER0|ZMASKCMP|ZSCALE|ZZERO|Z(?:TILE|NAME|VAL)[0-9]+"


def is_compressed_image(keywords: DataFrame) -> DataFrame:
    """(image_id, hdu_num, compressed) of every unit: whether it is a table that holds an image in tiles."""
    return keywords.groupBy("image_id", "hdu_num").agg(_compressed(lambda c: c).alias("compressed"))


def _compressed(over) -> Column:
    """Whether a unit's keywords are those of a table that holds an image in tiles; `over` makes an aggregate one of a group or a window."""
    plain = F.trim(F.regexp_replace("value", "'", ""))
    is_table = over(F.bool_or((F.col("name") == "XTENSION") & (F.lower(plain) == "bintable")))
    return is_table & over(F.bool_or((F.col("name") == "ZIMAGE") & (F.col("value") == "T")))


def plain_header(keywords: DataFrame) -> DataFrame:
    """The headers of compressed images as those of the images: the table's own keywords go, the image's
    get their names and come first, the others keep their order; numbered anew. Other units are not in it.
    The keywords are read once, and those of a unit meet in windows, so no list of units is broadcast."""
    unit = Window.partitionBy("image_id", "hdu_num")
    rows = keywords.where("image_id IS NOT NULL AND hdu_num IS NOT NULL").withColumn("compressed", _compressed(lambda c: c.over(unit))).where("compressed")
    named = F.create_map(*[F.lit(x) for kv in PLAIN.items() for x in kv])
    title = (F.col("name") == "EXTNAME") & F.col("value").contains("COMPRESSED_IMAGE")
    rows = rows.where(~F.col("name").rlike(f"^(?:{OF_TABLE})$") & ~title)
    rank = F.create_map(*[x for i, k in enumerate(list(PLAIN)[:7]) for x in (F.lit(k), F.lit(i))])
    order = F.coalesce(F.try_element_at(rank, F.col("name")), F.lit(len(PLAIN)))
    at = F.row_number().over(unit.orderBy(order, "pos"))
    return rows.select("image_id", "hdu_num", at.alias("pos"), F.coalesce(F.try_element_at(named, F.col("name")), F.col("name")).alias("name"), "value")


def join_keywords_new(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source keywords whose name the new header lacks; comments always.

    Both sides grow with the files and are larger than Spark takes keywords made by generators for, so neither is broadcast.
    """
    own = target.select("image_id", "hdu_num", "name").distinct().hint("merge")
    free = source.where(F.col("name").isin("COMMENT", "HISTORY"))
    return source.where(~F.col("name").isin("COMMENT", "HISTORY")).join(own, ["image_id", "hdu_num", "name"], "left_anti").unionByName(free)


def win_hdu_number(hdus: DataFrame) -> DataFrame:
    """Ordinal of each unit in its file, and the next one's place."""
    w = Window.partitionBy("image_id").orderBy("offset")
    return hdus.select("image_id", "offset", F.row_number().over(w).alias("hdu_num"), F.lead("offset").over(w).alias("next_offset"))


def win_keyword_schema_drift(hdus: DataFrame) -> DataFrame:
    """From the third unit on: whether its keyword names differ from those of the one before."""
    w = Window.partitionBy("image_id").orderBy("offset")
    rows = hdus.withColumn("hdu_num", F.row_number().over(w)).withColumn("before", F.lag("names").over(w))
    return rows.where("hdu_num >= 3").select("image_id", "hdu_num", (~F.col("names").eqNullSafe(F.col("before"))).alias("drift"))


def card_format(name: Column, value: Column, comment: Column) -> Column:
    """80 characters: name, value, comment. Text in quotes stands left, at least 8 characters of it, other values right; comment cards have no value."""
    inner = F.regexp_extract(value, "^'(.*)'$", 1)
    quoted = F.rpad(F.concat(F.lit("'"), F.when(F.length(inner) < 8, F.rpad(inner, 8, " ")).otherwise(inner), F.lit("'")), F.greatest(F.length(value), F.lit(20)), " ")
    shown = F.when(value.startswith("'"), quoted).when(F.length(value) > 20, value).otherwise(F.lpad(value, 20, " "))
    body = F.concat(F.rpad(name, 8, " "), F.lit("= "), shown, F.when(comment != "", F.concat(F.lit(" / "), comment)).otherwise(""))
    return F.rpad(F.when(name.isin(FREE), F.concat(F.rpad(name, 8, " "), comment)).otherwise(body), CARD, " ")


def card_parse(card: Column) -> Column:
    """struct<name, value, comment>; a slash within quotes belongs to the value. A card without `= ` has a comment alone."""
    body = F.substring(card, 11, CARD)
    pattern = r"^\s*('(?:[^']|'')*'\s*|[^/]*)(?:/\s?(.*))?$"
    has = F.substring(card, 9, 2) == "= "
    value, note = (F.trim(F.regexp_extract(body, pattern, k)) for k in (1, 2))
    return F.struct(F.trim(F.substring(card, 1, 8)).alias("name"), F.when(has, value).otherwise("").alias("value"), F.when(has, note).otherwise(F.rtrim(F.substring(card, 9, CARD))).alias("comment"))


def blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK) * BLOCK


def agg_output_bytes(keywords: DataFrame, boxes: DataFrame, pixel_size: int) -> DataFrame:
    """Bytes of a product: cards with END, and pixels, each in whole blocks."""
    cards = keywords.groupBy("image_id").agg(F.count("*").alias("n"))
    data = (F.col("xmax") - F.col("xmin") + 1) * (F.col("ymax") - F.col("ymin") + 1) * pixel_size
    return cards.join(boxes, "image_id").select("image_id", (blocks((F.col("n") + 1) * CARD) + blocks(data)).cast("long").alias("n_bytes"))


# Pixel kinds by BITPIX, and the bytes of each kind.
PIXEL_TYPES = {8: "byte", 16: "short", 32: "int", 64: "long", -32: "float", -64: "double"}
TYPE_BYTES = {"byte": 1, "short": 2, "int": 4, "long": 8, "float": 4, "double": 8}


def pixel_size(bitpix: Column) -> Column:
    """Bytes of a pixel."""
    return (F.abs(bitpix) / 8).cast("int")


def pixel_data_type(bitpix: Column) -> Column:
    """The kind of a pixel; null for an unknown BITPIX."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PIXEL_TYPES.items() for x in kv]), bitpix)


def data_type_size(kind: Column) -> Column:
    """Bytes of a kind; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_BYTES.items() for x in kv]), kind)


def hdu_kind(ext_type: Column, naxes: Column) -> Column:
    """What a rectangular cutout does with a unit: `cut` a two-dimensional image, `copy` tables and images without axes, else `error`."""
    return F.when((ext_type != "image") | (F.size(naxes) == 0), "copy").when((F.size(naxes) == 2) & (F.array_min(naxes) > 0), "cut").otherwise("error")


def copy_hdus(hdus: DataFrame) -> DataFrame:
    """The units that a cutout passes on as they are."""
    return hdus.where(hdu_kind(F.col("ext_type"), F.col("naxes")) == "copy")


def rewrite_header_radius(keywords: DataFrame, boxes: DataFrame, compressed: Column) -> DataFrame:
    """Keywords of a radius cutout: sides, reference places as 32-bit numbers, the name of a compressed image; empty names go.

    The sky's axes are the columns `lng` and `lat` of the boxes, from 0, where they have them, else the first two.
    """
    axes = [F.col(c) if c in boxes.columns else F.lit(i).alias(c) for i, c in enumerate(("lng", "lat"))]
    rows = keywords.where("name <> ''").join(boxes.select("image_id", *axes, "xmin", "ymin", "xmax", "ymax"), "image_id")
    value, name = F.col("value").try_cast("double"), F.col("name")
    of = lambda key, axis: name == F.concat(F.lit(key), (F.col(axis) + 1).cast("string"))
    shifted = lambda lo: F.format_string("%.8E", (value + 1 - F.col(lo)).cast("float"))
    new = (
        F.when(of("NAXIS", "lng"), (F.col("xmax") - F.col("xmin") + 1).cast("string"))
        .when(of("NAXIS", "lat"), (F.col("ymax") - F.col("ymin") + 1).cast("string"))
        .when(of("CRPIX", "lng"), shifted("xmin"))
        .when(of("CRPIX", "lat"), shifted("ymin"))
        .when((name == "EXTNAME") & compressed, F.lit("'COMPRESSED_IMAGE'"))
        .otherwise(F.col("value"))
    )
    return rows.select("image_id", "hdu_num", "pos", "name", new.alias("value"))
