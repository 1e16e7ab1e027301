"""Queries on files: FITS files stored from the tables and read by byte ranges, products, and text tables."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.requests import content_type
from ..operators import cutout as ct
from ..operators import headers as hd
from ..operators import pixels as px
from ..scratch import place, stored
from ..sources import fits, text
from ..sources import fits_store as fs
from . import images as im
from . import views as v

#: Pixels of a tile's side, for the small images.
TILE = 4


def _floats(rows, values: str, out: str):
    """Rows with an array of numbers as big-endian 32-bit floats."""

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([np.asarray(x, dtype=">f4").tobytes() for x in batch.to_pylist()], pa.binary())

    return rows.withColumn(out, F.arrow_udf(run, "binary")(F.col(values)))


def _cards(*cards):
    """Cards of names and values; a third one is a comment."""
    own = lambda x: x if not isinstance(x, str) else F.lit(x)
    return F.array(*[hd.card_format(F.lit(c[0]), own(c[1]), own(c[2]) if len(c) > 2 else F.lit("")) for c in cards])


def single_images(s, d):
    """A file of one image for each vector: parts for write_products."""
    rows = _floats(v.table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", "data")
    k = F.col("vec_id").cast("string")
    head = fs.header_text(_cards(("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", "2"), ("NAXIS1", "8"), ("NAXIS2", "8"), ("IMAGEID", k)))
    return rows.select(F.concat(k, F.lit(".fits")).alias("path"), F.lit(1).alias("hdu_num"), F.posexplode(F.array(head, F.col("data"))).alias("part", "content"))


def stored_images(s, d):
    """The folder of these files."""
    root = place(s, "images")
    fs.write_products(single_images(s, d), root)
    return root


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def fits_hdus(s, d):
    u = fs.hdus(fs.scan_units(fs.list_files(s, stored_images(s, d))))
    return u.select(_name("path").alias("path"), "hdu_num", "ext_type", "bitpix", F.array_join(F.col("naxes").cast("array<string>"), "x").alias("size"), "n_keywords", F.coalesce("error", F.lit("")).alias("error"))


def fits_keywords(s, d):
    k = fs.keywords(fs.scan_units(fs.list_files(s, stored_images(s, d))))
    return k.select(_name("path").alias("path"), "pos", "name", "value", F.length("card").alias("n"))


def fits_tiles(s, d):
    """Pixels of stored files, from their tiles."""
    tiles = fs.scan_fits_tiles(fs.stored_units(s, stored_images(s, d)), TILE)
    p = fits.tile_pixels(tiles)
    return p.select(F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long").alias("image_id"), "x", "y", F.col("raw_float").cast("float").alias("v"))


def fits_cutout(s, d):
    """Cut pixels as images of stored files, then what these hold."""
    rows = px.join_box_tiles(im._cut(s, d), px.tiles(v.pixels(s, d)))
    name = F.concat(F.col("image_id").cast("string"), F.lit(".fits"))
    cut = rows.select(name.alias("path"), F.lit(1).alias("hdu_num"), (F.col("x") - F.col("xmin") + 1).alias("x"), (F.col("y") - F.col("ymin") + 1).alias("y"), "v")
    root = place(s, "cut")
    fs.write_products(fits.sink_fits(cut, cards=_cards(("ORIGIN", "'cut'", "made here"))), root)
    units = fs.stored_units(s, root).withColumn("image_id", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long"))
    raw = fs.raw_parts(units, ["image_id"]).select("image_id", F.round(F.aggregate(px.from_bytes(F.col("content"), -32), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
    return units.join(raw, "image_id").select("image_id", F.get("naxes", 0).alias("nx"), F.get("naxes", 1).alias("ny"), F.size("cards").alias("n_cards"), "total")


def agg_subimage(s, d):
    """Cut images in row-major order: tiles stay bytes until their rows are put together, and no row holds a whole image."""
    tiles = fs.scan_fits_tiles(fs.stored_units(s, stored_images(s, d)), TILE)
    named = tiles.select("path").distinct().select("path", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long").alias("image_id"))
    boxes = im._cut(s, d).join(named, "image_id").withColumn("hdu_num", F.lit(1))
    rows = px.cut_rows(boxes, tiles, ["image_id"], TILE).withColumn("v", px.from_bytes(F.col("content"), -32))
    at = (F.col("y") - 1) * F.size("v") + F.array_position("v", F.array_max("v"))
    top = F.max(F.struct(F.array_max("v").alias("v"), (-at).alias("at")))
    out = rows.groupBy("image_id").agg(F.sum(F.size("v")).cast("int").alias("n"), F.min_by(F.get("v", 0), "y").cast("float").alias("first"), F.max_by(F.element_at("v", -1), "y").cast("float").alias("last"), top.alias("top"))
    return out.select("image_id", "n", "first", "last", (-F.col("top.at")).cast("long").alias("top_at"))


def sink_gzip(s, d):
    """Products packed by gzip, read again from the store."""
    root = place(s, "packed")
    fs.write_products(single_images(s, d).withColumn("path", F.concat("path", F.lit(".gz"))), root, compress=True)
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(root)
    return files.select(_name("path").alias("path"), content_type(F.col("path")).alias("type"), F.hex(F.substring("content", 1, 3)).alias("magic"))


def fetch_file(s, d):
    """Wanted files from the store, whole."""
    root = stored_images(s, d)
    wanted = v.table(s, d, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".fits")).alias("path"))
    files = s.read.format("binaryFile").load(root)
    return fits.fetch_file(wanted, files.select(fs.relative(F.col("path"), root).alias("path"), "content")).select("path", "length", "type")


def _archive_parts(s, d):
    """Files of several units: the image, and in some a table, an image without axes, or one of three axes."""
    rows = _floats(v.small_targets(s, d).join(v.table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding"), "image_id"), "embedding", "data")
    k = F.col("image_id")
    num = lambda c: F.col(c).cast("string")
    ids = k.cast("string")
    image = _cards(("SIMPLE", "T", "a standard file"), ("BITPIX", "-32"), ("NAXIS", "2"), ("NAXIS1", "8"), ("NAXIS2", "8"), ("EXTEND", "T"), ("CTYPE1", "'RA---TAN'"), ("CTYPE2", "'DEC--TAN'"), ("CRPIX1", "4.5", "place of the centre"), ("CRPIX2", "4.5"), ("CRVAL1", num("crval1")), ("CRVAL2", num("crval2")), ("LTV1", "0"), ("CHECKSUM", "'a/b'"), ("OBJECT", F.concat(F.lit("'part "), ids, F.lit(" / x'")), "a note"), ("HISTORY", "", " made = here"))
    table = _cards(("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", "16"), ("NAXIS2", "4"), ("PCOUNT", "0"), ("GCOUNT", "1"), ("TFIELDS", "1"), ("TFORM1", "'16A'"), ("CHECKSUM", "'kept'"))
    none = _cards(("XTENSION", "'IMAGE'"), ("BITPIX", "16"), ("NAXIS", "0"), ("PCOUNT", "0"), ("GCOUNT", "1"))
    cube = _cards(("XTENSION", "'IMAGE'"), ("BITPIX", "-64"), ("NAXIS", "3"), ("NAXIS1", "8"), ("NAXIS2", "8"), ("NAXIS3", "2"), ("PCOUNT", "0"), ("GCOUNT", "1"))
    unit = lambda n, head, data: F.struct(F.lit(n).alias("hdu_num"), fs.header_text(head).alias("head"), data.alias("data"))
    bare = F.encode(F.rpad(F.concat(F.lit("row of "), ids), 64, "."), "US-ASCII")
    units = F.array(unit(1, image, F.col("data")), F.when(k % 3 == 0, unit(2, table, bare)), F.when(k % 5 == 0, unit(3, none, F.lit(b""))), F.when(k % 50 == 16, unit(4, cube, F.lit(bytes(1024)))))
    rows = rows.select(F.concat(F.lit("a/"), ids, F.lit(".fits")).alias("path"), F.inline(F.filter(units, lambda u: u.isNotNull())))
    return rows.select("path", "hdu_num", F.posexplode(F.array("head", "data")).alias("part", "content"))


def cutout_product(s, d):
    """Requests to stored products: units read by ranges from an archive, cut, written with their headers, and read again."""
    root, out = place(s, "archive"), place(s, "products")
    fs.write_products(_archive_parts(s, d), root)
    units = fs.stored_units(s, root).withColumn("image_id", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long"))
    requests = stored(im.cutout_requests(s, d), "requests")
    asked = units.join(requests.select("image_id").distinct(), "image_id", "left_semi")
    status, made = ct.cutout(requests, asked.select("image_id", "hdu_num", "ext_type", "naxes", "bitpix"))
    made = made.join(asked.select("image_id", "path").distinct(), "image_id")
    wanted = asked.join(made.where("kind = 'cut'").select("path", "hdu_num").distinct(), ["path", "hdu_num"], "left_semi")
    tiles = fs.scan_fits_tiles(wanted, TILE)
    fs.write_products(ct.product_parts(made, asked, fs.keywords(asked), tiles, TILE), out)
    again = fs.stored_units(s, out).withColumn("request_id", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long"))
    k = fs.keywords(again)
    of = lambda n, c="value": F.max(F.when(F.col("name") == n, F.col(c)))
    heads = k.groupBy("path", "hdu_num").agg(of("CRPIX1").try_cast("double").alias("crpix1"), of("CRPIX1", "comment").alias("note"), of("CRPIX2").try_cast("double").alias("crpix2"), of("LTV1").try_cast("double").alias("ltv1"), of("CHECKSUM").alias("checksum"), of("OBJECT").alias("object"), of("HISTORY", "comment").alias("history"))
    raw = fs.raw_parts(again.withColumn("file", F.col("path")), ["file", "hdu_num"])
    values = F.when(F.col("bitpix") == -32, px.from_bytes(F.col("content"), -32))
    raw = raw.join(again.select(F.col("path").alias("file"), "hdu_num", "bitpix"), ["file", "hdu_num"])
    sums = raw.select(F.col("file").alias("path"), "hdu_num", F.when(F.col("bitpix") == 8, F.md5("content")).alias("digest"), F.round(F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
    rows = again.join(heads, ["path", "hdu_num"]).join(sums, ["path", "hdu_num"], "left")
    rows = rows.select("request_id", "hdu_num", "ext_type", F.array_join(F.col("naxes").cast("array<string>"), "x").alias("sides"), F.size("cards").alias("n_cards"), "crpix1", "note", "crpix2", "ltv1", "checksum", "object", "history", "digest", "total")
    return status.join(rows, "request_id", "left").fillna(0, ["hdu_num", "n_cards"])


def _sky_files(s, d):
    """A file for each vector with its 64 numbers as an image: a cube, one with its sky axes the other way
    round, one without sky axes, and a cube whose latitude is the third axis. A folder has up to 1,000 files."""
    rows = v.small_targets(s, d).join(v.table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding"), "image_id")
    k = F.col("image_id")
    num = lambda c: F.col(c).cast("string")
    cube = [("NAXIS", "3"), ("NAXIS1", "4"), ("NAXIS2", "4"), ("NAXIS3", "4")]
    flat = [("NAXIS", "2"), ("NAXIS1", "8"), ("NAXIS2", "8")]
    begin, end = [("SIMPLE", "T"), ("BITPIX", "-32")], [("EXTEND", "T"), ("OBJECT", "'x'", "a note"), ("HISTORY", "", " kept"), ("HISTORY", "", " kept too")]

    def axes(lng, lat, middle):
        return [(f"CTYPE{lng}", "'RA---TAN'"), (f"CTYPE{lat}", "'DEC--TAN'"), (f"CRVAL{lng}", num("crval1")), (f"CRVAL{lat}", num("crval2")), (f"CRPIX{lng}", middle, "lng"), (f"CRPIX{lat}", middle, "lat"), (f"CDELT{lng}", "-0.01"), (f"CDELT{lat}", "0.01")]

    heads = [_cards(*begin, *cube, *axes(1, 2, "2.5"), ("CTYPE3", "'FREQ'"), *end), _cards(*begin, *flat, *axes(2, 1, "4.5"), *end), _cards(*begin, *flat, ("CTYPE1", "'X'"), *end), _cards(*begin, *cube, *axes(1, 3, "2.5"), ("CTYPE2", "'FREQ'"), *end)]
    head = F.when(k % 4 == 0, heads[0]).when(k % 4 == 1, heads[1]).when(k % 4 == 2, heads[2]).otherwise(heads[3])
    rows = _floats(rows, "embedding", "data")
    name = F.concat(F.floor(k / 1000).cast("string"), F.lit("/"), k.cast("string"), F.lit(".fits"))
    return rows.select(name.alias("path"), F.lit(1).alias("hdu_num"), F.posexplode(F.array(fs.header_text(head), F.col("data"))).alias("part", "content"))


def radius_product(s, d):
    """Radius cutouts of images with their sky axes in any place: written as products and read again."""
    root, out = place(s, "sky"), place(s, "radius")
    fs.write_products(_sky_files(s, d), root)
    units = fs.stored_units(s, root)
    keywords = fs.keywords(units)
    targets = v.small_targets(s, d).select(F.col("image_id").cast("string").alias("k"), "ra", "dec", "width")
    named = units.select("path", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).alias("k"))
    ranges = stored(ct.radius_ranges(units, ct.world(keywords), named.join(targets.hint("merge"), "k").drop("k")), "ranges")
    parts = ct.radius_parts(ranges, units, keywords, fs.scan_fits_tiles(units, TILE), TILE)
    fs.write_products(parts.withColumn("path", fs.relative(F.col("path"), root)), out)
    again = fs.stored_units(s, out)
    k = fs.keywords(again)
    of = lambda n: F.coalesce(F.max(F.when(F.col("comment") == n, F.concat_ws("=", "name", "value"))), F.lit(""))
    heads = k.groupBy("path").agg(of("lng").alias("lng"), of("lat").alias("lat"), F.count(F.when(F.col("name") == "HISTORY", 1)).alias("n_history"))
    raw = fs.raw_parts(again.withColumn("file", F.col("path")), ["file"])
    sums = raw.select(F.col("file").alias("path"), F.round(F.aggregate(F.transform(px.from_bytes(F.col("content"), -32), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))
    rows = again.join(heads.hint("merge"), "path").join(sums.hint("merge"), "path")
    image = F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long")
    return rows.select(image.alias("image_id"), F.array_join(F.col("naxes").cast("array<string>"), "x").alias("sides"), "lng", "lat", "n_history", F.size("cards").alias("n_cards"), "total")


def _compressed_keywords(s, d):
    """Headers of the images as those of tables that hold them in tiles."""
    values = ["\'BINTABLE\'", "8", "2", "8", "cast(naxis2 AS string)", "'0'", "'1'", "'1'", "\'COMPRESSED_DATA\'", "\'1PB\'", "'T'", "'F'", "'-32'", "'2'", "cast(naxis1 AS string)", "cast(naxis2 AS string)"]
    names = ["XTENSION", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "PCOUNT", "GCOUNT", "TFIELDS", "TTYPE1", "TFORM1", "ZIMAGE", "ZSIMPLE", "ZBITPIX", "ZNAXIS", "ZNAXIS1", "ZNAXIS2"]
    more = {"OBJECT": "concat('part ', image_id)", "ZTILE1": "'8'", "EXTNAME": "'COMPRESSED_IMAGE'", "CRPIX1": "cast(crpix1 AS string)", "ZCMPTYPE": "'RICE_1'", "CRPIX2": "cast(crpix2 AS string)", "LTV1": "'0'", "ZHECKSUM": "'abc'", "ZEXTEND": "'T'"}
    plain = [x if x.startswith("cast") else "'" + x.strip("'") + "'" for x in values]
    pairs = [*zip(names, plain, strict=True), *more.items()]
    stack = ", ".join(f"{i}, '{n}', {x}" for i, (n, x) in enumerate(pairs, 1))
    kinds = v.images(s, d).selectExpr("*", "CASE WHEN image_id % 5 = 0 THEN 'F' ELSE 'T' END AS z")
    rows = kinds.selectExpr("image_id", "z", "2 AS hdu_num", f"stack({len(pairs)}, {stack}) AS (pos, name, value)")
    return rows.select("image_id", "hdu_num", "pos", "name", F.when(F.col("name") == "ZIMAGE", F.col("z")).otherwise(F.col("value")).alias("value"))


def rewrite_header_compressed(s, d):
    """Headers of compressed images, made plain, as extensions, and cut."""
    plain = hd.union_header(hd.plain_header(_compressed_keywords(s, d)))
    return hd.rewrite_header(plain, v.boxes(s, d))


def _packed_parts(s, d):
    """Files with an empty first unit and the vector's image as a table of tiles of 3 by 2 pixels, packed one by one."""
    rows = v.table(s, d, "embeddings").select("vec_id", "embedding")

    def pack(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out = []
            for x in batch.to_pylist():
                image = np.asarray(x, dtype=">f4").reshape(8, 8)
                tiles = [gzip.compress(image[b : b + 2, a : a + 3].tobytes(), 1, mtime=0) for b in range(0, 8, 2) for a in range(0, 8, 3)]
                places = np.cumsum([0, *map(len, tiles)])
                table = np.array([[len(t), at] for t, at in zip(tiles, places, strict=False)], ">i4").tobytes()
                out.append({"n": int(places[-1]), "data": table + b"".join(tiles)})
            yield pa.array(out, pa.struct([("n", pa.int64()), ("data", pa.binary())]))

    rows = rows.select("vec_id", F.arrow_udf(pack, "n bigint, data binary")(F.col("embedding")).alias("p")).select("vec_id", "p.*")
    empty = fs.header_text(_cards(("SIMPLE", "T"), ("BITPIX", "8"), ("NAXIS", "0"), ("EXTEND", "T")))
    how = F.when(F.col("vec_id") % 50 == 6, "'RICE_1'").otherwise("'GZIP_1'")
    head = fs.header_text(_cards(("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", "8"), ("NAXIS2", "12"), ("PCOUNT", F.col("n").cast("string")), ("GCOUNT", "1"), ("TFIELDS", "1"), ("TTYPE1", "'COMPRESSED_DATA'"), ("TFORM1", "'1PB(99)'"), ("ZIMAGE", "T"), ("ZBITPIX", "-32"), ("ZNAXIS", "2"), ("ZNAXIS1", "8"), ("ZNAXIS2", "8"), ("ZTILE1", "3"), ("ZTILE2", "2"), ("ZCMPTYPE", how), ("CRPIX1", "4.5"), ("CRPIX2", "4.5"), ("OBJECT", "'x'")))
    unit = lambda n, h, c: F.struct(F.lit(n).alias("hdu_num"), h.alias("head"), c.alias("data"))
    rows = rows.select(F.concat(F.col("vec_id").cast("string"), F.lit(".fits")).alias("path"), F.inline(F.array(unit(1, empty, F.lit(b"")), unit(2, head, F.col("data")))))
    return rows.select("path", "hdu_num", F.posexplode(F.array("head", "data")).alias("part", "content"))


def cutout_compressed(s, d):
    """Requests to products of compressed images: tiles read from the heap, cut, and written as plain extensions."""
    root, out = place(s, "packed"), place(s, "unpacked")
    fs.write_products(_packed_parts(s, d), root)
    units = fs.stored_units(s, root).withColumn("image_id", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long"))
    requests = stored(im.cutout_requests(s, d), "requests")
    asked = fs.plain_units(units.join(requests.select("image_id").distinct(), "image_id", "left_semi"))
    status, made = ct.cutout(requests, asked.select("image_id", "hdu_num", "ext_type", "naxes", "bitpix"))
    tiles = stored(fs.scan_packed_tiles(asked.where("compressed"), 5), "tiles")
    # an image that can't be decoded fails its request
    bad = tiles.where("status <> 'ok'").select("path").distinct().join(asked.select("path", "image_id").distinct(), "path").select("image_id")
    failed = requests.join(bad, "image_id", "left_semi").select("request_id", F.lit(True).alias("bad"))
    status = status.join(failed, "request_id", "left").select("request_id", F.when(F.col("bad"), 500).otherwise(F.col("status")).alias("status"))
    made = made.join(failed, "request_id", "left_anti").join(asked.select("image_id", "path", "hdu_num", "tile_w", "tile_h", "cards", "data_at", "data_bytes", "compressed"), ["image_id", "hdu_num"])
    copied = made.where("kind = 'copy'").select("request_id", "hdu_num", F.lit(0).cast("long").alias("part"), fs.header_text(F.col("cards")).alias("content"), F.concat(F.col("request_id").cast("string"), F.lit(".fits")).alias("path"))
    fs.write_products(copied.unionByName(ct.packed_parts(made.where("kind = 'cut'"), fs.keywords(asked), tiles)), out)
    again = fs.stored_units(s, out).where("hdu_num = 2").withColumn("request_id", F.regexp_extract("path", "([0-9]+)[.]fits$", 1).cast("long"))
    raw = fs.raw_parts(again, ["request_id"])
    total = F.round(F.aggregate(F.transform(px.from_bytes(F.col("content"), -32), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)
    rows = again.join(raw.select("request_id", total.alias("total")), "request_id")
    names = F.array_join(F.transform("cards", lambda c: F.trim(F.substring(c, 1, 8))), ",")
    rows = rows.select("request_id", "ext_type", F.array_join(F.col("naxes").cast("array<string>"), "x").alias("sides"), names.alias("names"), fs.card_value("CRPIX1").try_cast("double").alias("crpix1"), "total")
    return status.join(rows, "request_id", "left")


def is_compressed_image(s, d):
    return hd.is_compressed_image(_compressed_keywords(s, d))


def scan_bar_dump(s, d):
    path = place(s, "dump")
    text.write_bar_dump(v.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return text.scan_bar_dump(s, path, "o_orderkey long, o_custkey long, o_orderpriority string")


def scan_result_csv(s, d):
    path = place(s, "result")
    text.write_result_csv(v.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "c_custkey")
    return text.scan_result_csv(s, path, "c_custkey").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


def fits_errors(s, d):
    """Stored files of which some lack the end of their data, and some are no such files; each is a row with its status."""
    root, k = place(s, "broken"), F.col("vec_id")
    rows = _floats(v.table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", "data")
    head = fs.header_text(_cards(("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", "2"), ("NAXIS1", F.when(k % 7 == 0, "800").otherwise("8")), ("NAXIS2", "8")))
    content = F.when(k % 7 == 1, F.encode(F.rpad(F.lit("no image"), fs.BLOCK, " "), "US-ASCII")).otherwise(F.concat(head, F.col("data")))
    fs.write_products(rows.select(F.concat(k.cast("string"), F.lit(".fits")).alias("path"), F.lit(1).alias("hdu_num"), F.lit(0).alias("part"), content.alias("content")), root)
    return fs.scan_units(fs.list_files(s, root)).where("status = 'error'").select(_name("path").alias("path"), "error")


def scan_directory(s, d):
    """Directories of stored files, relative to their root, whose name one of them bears too."""
    root = place(s, "tree") + "/n_regionkey=1"
    v.table(s, d, "nation").select("n_regionkey", (F.col("n_nationkey") % 3).alias("third"), "n_name").write.partitionBy("n_regionkey", "third").text(root)
    return fits.scan_directory(s, root).where("length IS NULL").select("path")


QUERIES = {
    "scan_fits_errors": fits_errors,
    "scan_directory": scan_directory,
    "scan_fits_hdus": fits_hdus,
    "scan_fits_keywords": fits_keywords,
    "scan_fits_tiles": fits_tiles,
    "fits_cutout": fits_cutout,
    "agg_subimage": agg_subimage,
    "cutout_product": cutout_product,
    "cutout_compressed": cutout_compressed,
    "radius_product": radius_product,
    "rewrite_header_compressed": rewrite_header_compressed,
    "is_compressed_image": is_compressed_image,
    "sink_gzip": sink_gzip,
    "fetch_file": fetch_file,
    "scan_bar_dump": scan_bar_dump,
    "scan_result_csv": scan_result_csv,
}

_NAMES = "['SIMPLE','BITPIX','NAXIS','NAXIS1','NAXIS2','IMAGEID']"
SQL = {
    "scan_fits_errors": "SELECT vec_id || '.fits' AS path, CASE WHEN vec_id % 7 = 0 THEN 'unit 1: data end early' ELSE 'header without END' END AS error FROM embeddings WHERE vec_id % 7 < 2",
    "scan_directory": "SELECT DISTINCT 'n_regionkey=' || n_regionkey || '/' AS path FROM nation UNION SELECT DISTINCT 'n_regionkey=' || n_regionkey || '/third=' || n_nationkey % 3 || '/' FROM nation UNION SELECT ''",
    "scan_fits_hdus": "SELECT vec_id || '.fits' AS path, 1 AS hdu_num, 'image' AS ext_type, -32 AS bitpix, '8x8' AS size, 6 AS n_keywords, '' AS error FROM embeddings",
    "scan_fits_keywords": f"SELECT vec_id || '.fits' AS path, CAST(i AS INT) AS pos, ({_NAMES})[i] AS name, (['T', '-32', '2', '8', '8', CAST(vec_id AS VARCHAR)])[i] AS value, 80 AS n FROM (SELECT vec_id, unnest(generate_series(1, 6)) AS i FROM embeddings)",
    "scan_fits_tiles": f"WITH {v.PIXELS_SQL} SELECT * FROM pixels",
    "agg_subimage": f"{im._P}, l AS (SELECT p.image_id, list(v ORDER BY y, x) AS data {im._IN} GROUP BY 1) SELECT image_id, CAST(len(data) AS INT) AS n, data[1] AS first, data[len(data)] AS last, CAST(list_position(data, list_max(data)) AS BIGINT) AS top_at FROM l",
    "radius_product": f"""WITH {v.PIXELS_SQL}, base AS (SELECT vec_id AS image_id, CASE WHEN vec_id % 4 IN (0, 3) THEN 4 ELSE 8 END::BIGINT AS n FROM embeddings),
{v.SMALL_TARGETS_SQL.replace("targets AS", "small AS")}, targets AS (SELECT s.* REPLACE (b.n AS naxis1, b.n AS naxis2, (b.n + 1) / 2.0::DOUBLE AS crpix1, (b.n + 1) / 2.0::DOUBLE AS crpix2) FROM small s JOIN base b USING (image_id)){im._PIX},
rb AS (SELECT image_id, naxis1, naxis2, {im._RADIUS} FROM pix), b AS (SELECT image_id, naxis1 AS n, {im._CLAMP} FROM rb WHERE {im._OVER} OR image_id % 4 = 2),
c AS (SELECT vec_id AS image_id, i, CAST(embedding[i] AS FLOAT)::DOUBLE AS v, CASE vec_id % 4 WHEN 1 THEN (i - 1) // 8 ELSE (i - 1) % 4 END + 1 AS x, CASE vec_id % 4 WHEN 0 THEN (i - 1) // 4 % 4 WHEN 1 THEN (i - 1) % 8 ELSE (i - 1) // 16 END + 1 AS y FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)),
t AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY i) AS j FROM c JOIN b USING (image_id) WHERE image_id % 4 = 2 OR (x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)),
s AS (SELECT image_id, round(sum(v * j), 3) AS total FROM t GROUP BY 1), w AS (SELECT *, xmax - xmin + 1 AS nx, ymax - ymin + 1 AS ny, (n + 1) / 2.0::DOUBLE AS m FROM b)
SELECT image_id, CASE image_id % 4 WHEN 0 THEN nx || 'x' || ny || 'x4' WHEN 1 THEN ny || 'x' || nx WHEN 2 THEN '8x8' ELSE nx || 'x4x' || ny END AS sides,
CASE image_id % 4 WHEN 1 THEN 'CRPIX2=' WHEN 2 THEN '' ELSE 'CRPIX1=' END || CASE WHEN image_id % 4 = 2 THEN '' ELSE format('{{:.8E}}', m + 1 - xmin) END AS lng, CASE image_id % 4 WHEN 0 THEN 'CRPIX2=' WHEN 1 THEN 'CRPIX1=' WHEN 2 THEN '' ELSE 'CRPIX3=' END || CASE WHEN image_id % 4 = 2 THEN '' ELSE format('{{:.8E}}', m + 1 - ymin) END AS lat,
2::BIGINT AS n_history, CAST(CASE image_id % 4 WHEN 1 THEN 17 WHEN 2 THEN 10 ELSE 19 END AS INT) AS n_cards, total FROM w JOIN s USING (image_id)""",
    "rewrite_header_compressed": f"""WITH {v.IMAGES_SQL}, {v.BOXES_SQL}, k AS (SELECT i.*, b.xmin, b.ymin, b.xmax, b.ymax, unnest(generate_series(1, 11)) AS p FROM images i JOIN boxes b USING (image_id) WHERE image_id % 5 <> 0)
SELECT image_id, CAST(2 AS INT) AS hdu_num, CAST(p AS INT) AS pos, (['XTENSION', 'BITPIX', 'NAXIS', 'NAXIS1', 'NAXIS2', 'PCOUNT', 'GCOUNT', 'OBJECT', 'CRPIX1', 'CRPIX2', 'LTV1'])[p] AS name,
(['IMAGE', '-32', '2', CAST(xmax - xmin + 1 AS VARCHAR), CAST(ymax - ymin + 1 AS VARCHAR), '0', '1', 'part ' || image_id, format('{{:.15E}}', crpix1 + 1 - xmin), format('{{:.15E}}', crpix2 + 1 - ymin), format('{{:.15E}}', xmin - 1.0::DOUBLE)])[p] AS value FROM k""",
    "cutout_compressed": f"""{im._CUTS}, ok AS (SELECT * FROM cuts WHERE request_id % 50 <> 6),
n AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY y, x) AS i, v FROM ok JOIN pixels ON request_id = image_id AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax),
t AS (SELECT request_id, round(sum(CAST(v AS DOUBLE) * i), 3) AS total FROM n GROUP BY 1)
SELECT c.request_id, CASE WHEN total IS NULL THEN 500 ELSE 200 END AS status, CASE WHEN total IS NOT NULL THEN 'image' END AS ext_type, CASE WHEN total IS NOT NULL THEN (xmax - xmin + 1) || 'x' || (ymax - ymin + 1) END AS sides,
CASE WHEN total IS NOT NULL THEN 'XTENSION,BITPIX,NAXIS,NAXIS1,NAXIS2,PCOUNT,GCOUNT,CRPIX1,CRPIX2,OBJECT' END AS names, CASE WHEN total IS NOT NULL THEN 5.5 - xmin END::DOUBLE AS crpix1, total FROM cuts c LEFT JOIN t USING (request_id)""",
    "is_compressed_image": "SELECT p_partkey AS image_id, CAST(2 AS INT) AS hdu_num, p_partkey % 5 <> 0 AS compressed FROM part",
    "cutout_product": f"""{im._CUTS}, ok AS (SELECT * FROM cuts WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.image_id = request_id AND axes = 3)),
n AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY y, x) AS i, v FROM ok JOIN pixels ON request_id = image_id AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax),
t AS (SELECT request_id, round(sum(CAST(v AS DOUBLE) * i), 3) AS total FROM n GROUP BY 1)
SELECT c.request_id, CASE WHEN ok.request_id IS NULL THEN 500 ELSE 200 END AS status, coalesce(hdu_num, 0) AS hdu_num, ext_type, CASE hdu_num WHEN 1 THEN (c.xmax - c.xmin + 1) || 'x' || (c.ymax - c.ymin + 1) WHEN 2 THEN '16x4' WHEN 3 THEN '' END AS sides,
CAST(CASE hdu_num WHEN 1 THEN 15 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END AS INT) AS n_cards, CASE WHEN hdu_num = 1 THEN 5.5 - c.xmin END::DOUBLE AS crpix1, CASE WHEN hdu_num = 1 THEN 'place of the centre' END AS note, CASE WHEN hdu_num = 1 THEN 5.5 - c.ymin END::DOUBLE AS crpix2, CASE WHEN hdu_num = 1 THEN c.xmin - 1 END::DOUBLE AS ltv1,
CASE WHEN hdu_num = 2 THEN '''kept    ''' END AS checksum, CASE WHEN hdu_num = 1 THEN '''part ' || c.request_id || ' / x''' END AS object, CASE WHEN hdu_num = 1 THEN ' made = here' END AS history, CASE WHEN hdu_num = 2 THEN md5(rpad('row of ' || c.request_id, 64, '.')) END AS digest, CASE WHEN hdu_num = 1 THEN total END AS total
FROM cuts c LEFT JOIN ok USING (request_id) LEFT JOIN units ON ok.request_id = units.image_id LEFT JOIN t ON t.request_id = c.request_id""",
    "fits_cutout": f"{im._P} SELECT p.image_id, max(xmax - xmin + 1)::BIGINT AS nx, max(ymax - ymin + 1)::BIGINT AS ny, CAST(6 AS INT) AS n_cards, round(sum(CAST(v AS DOUBLE)), 4) AS total {im._IN} GROUP BY 1",
    "sink_gzip": "SELECT vec_id || '.fits.gz' AS path, 'application/gzip' AS type, '1F8B08' AS magic FROM embeddings",
    "fetch_file": "SELECT DISTINCT event_id || '.fits' AS path, 5760 AS length, 'application/fits' AS type FROM events WHERE event_id IN (SELECT vec_id FROM embeddings)",
    "scan_bar_dump": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
    "scan_result_csv": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
}
