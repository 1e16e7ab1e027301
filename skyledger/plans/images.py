"""Queries on geometry, pixels, headers and positional search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import requests as rq
from ..functions.once import once
from ..operators import access as ac
from ..operators import cutout as ct
from ..operators import headers as hd
from ..operators import pixels as px
from ..operators import search as se
from ..scratch import stored
from . import access as qa
from . import views as v

C = F.col
R = lambda c, n=9: F.round(c, n)


def unit_conversion(s, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("arcsec", "arcmin", "deg", "rad")]), (C("image_id") % 4 + 1).cast("int"))
    return v.targets(s, d).select("image_id", R(rq.unit_to_deg(C("width"), unit)).alias("deg"), R(rq.unit_to_rad(C("width"), unit), 12).alias("rad"))


def sky_vectors(s, d):
    t = v.targets(s, d).withColumns({"a": g.sky_to_vec(C("ra"), C("dec")), "b": g.sky_to_vec(C("crval1"), C("crval2"))})
    return t.select("image_id", R(C("a.x")).alias("x"), R(C("a.y")).alias("y"), R(C("a.z")).alias("z"), R(g.ang_sep(C("a"), C("b"))).alias("sep"), g.norm_ra(C("ra") - 300).alias("ra_norm"), g.check_dec(C("dec") * 1.5).alias("dec_ok"))


def pixel_to_sky(s, d):
    p = g.pixel_to_sky(F.lit(1.25), F.lit(3.5))
    return v.images(s, d).withColumn("p", p).select("image_id", R(C("p.ra")).alias("ra"), R(C("p.dec")).alias("dec"))


def sky_to_pixel(s, d):
    return v.targets(s, d).withColumn("p", g.sky_to_pixel(C("ra"), C("dec"))).select("image_id", R(C("p.x"), 6).alias("x"), R(C("p.y"), 6).alias("y"), g.pixcen(C("p.x")).alias("px"), g.pixcen(C("p.y")).alias("py"))


def footprint_corners(s, d):
    n1, n2, h = C("naxis1") + 0.5, C("naxis2") + 0.5, F.lit(0.5)
    t = v.images(s, d)
    for k, (x, y) in enumerate(((h, h), (n1, h), (n1, n2), (h, n2)), 1):
        p = g.pixel_to_sky(x, y)
        t = t.withColumns({f"ra{k}": R(p["ra"]), f"dec{k}": R(p["dec"])})
    return t.select("image_id", *[f"{a}{k}" for k in range(1, 5) for a in ("ra", "dec")])


def pixel_box_pixels(s, d):
    k, n = C("image_id"), C("naxis1")
    x, y = n * 0.5 + (k % 17 - 8) * 2.25 + 0.1, n * 0.5 + (k % 23 - 11) * 1.75 + 0.2
    w = F.lit(6.5)
    box = g.clamp_box(g.pixcen(x - w / 2), g.pixcen(y - w / 2), g.pixcen(x + w / 2), g.pixcen(y + w / 2), n, n)
    return v.images(s, d).withColumn("b", box).where("b IS NOT NULL").select("image_id", "b.*")


def _centred(s, d):
    t = v.targets(s, d).withColumn("p", g.sky_to_pixel(C("ra"), C("dec")))
    return once(t, x0=C("p.x"), y0=C("p.y")).drop("p")


def _searched(s, d):
    t = _centred(s, d)
    return once(t, **{f"{a}{n}": g.pixel_search(C("x0"), C("y0"), a, k, F.radians(C("width" if a == "x" else "height")) / 2) for a in "xy" for k, n in ((-1, "min"), (1, "max"))})


def pixel_search(s, d):
    return _searched(s, d).select("image_id", "xmin", "xmax", "ymin", "ymax")


def pixel_box_sky(s, d):
    b = g.clamp_box(C("xmin"), C("ymin"), C("xmax"), C("ymax"), C("naxis1"), C("naxis2"))
    return _searched(s, d).withColumn("b", b).where("b IS NOT NULL").select("image_id", "b.*")


def radius_bounds(s, d):
    return _centred(s, d).select("image_id", *[g.radius_bounds(C("x0"), C("y0"), a, k, F.radians(C("width"))).alias(f"{a}{n}") for a in "xy" for k, n in ((-1, "min"), (1, "max"))])


def _cut(s, d):
    """Boxes of the small images, which are 8 by 8."""
    k = C("image_id")
    return v.pixels(s, d).select("image_id").distinct().select("image_id", (k % 3 + 1).alias("xmin"), (k % 4 + 2).alias("ymin"), F.least(k % 3 + 1 + k % 6, F.lit(8)).alias("xmax"), F.least(k % 4 + 2 + k % 5, F.lit(8)).alias("ymax"))


_CUT_SQL = "cut AS (SELECT DISTINCT vec_id AS image_id, vec_id % 3 + 1 AS xmin, vec_id % 4 + 2 AS ymin, least(vec_id % 3 + 1 + vec_id % 6, 8) AS xmax, least(vec_id % 4 + 2 + vec_id % 5, 8) AS ymax FROM embeddings)"


def join_box_tiles(s, d):
    return px.join_box_tiles(_cut(s, d), px.tiles(v.pixels(s, d))).select("image_id", "x", "y", "v")


def cutout_requests(s, d):
    """Requests for a cutout of the image with their number, with parsed centre and size."""
    p = C("params")
    r = ac.understood(v.requests(s, d)).where(rq.param_has(p, "center") & rq.param_has(p, "size"))
    r = r.select("request_id", C("request_id").alias("image_id"), rq.parse_coords(rq.param_get(p, "center"), "deg", True).alias("centre"), rq.parse_coords(rq.param_get(p, "size")).alias("size"))
    # every image looks at the place that the sky requests ask for, a little beside its centre
    images = v.small_targets(s, d).withColumns({"crval1": F.lit(1.5017), "crval2": F.lit(-1.9987)})
    return r.join(images.drop("ra", "dec", "width", "naxis1", "naxis2"), "image_id")


def cutout(s, d):
    """Units of every product with their pixels, and the status of every request."""
    status, units = ct.cutout(stored(cutout_requests(s, d), "requests"), v.hdus(s, d))
    sums = ct.cut_pixels(units, px.tiles(v.pixels(s, d))).groupBy("request_id", "hdu_num").agg(F.count("*").alias("n"), R(F.sum(C("v").cast("double") * (C("x") + 10 * C("y"))), 4).alias("total"))
    rows = status.join(units, "request_id", "left").join(sums, ["request_id", "hdu_num"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("request_id", "status", zero("hdu_num"), "kind", F.array_join(C("naxes").cast("array<string>"), "x").alias("sides"), zero("n"), zero("total"))


def hdu_kinds(s, d):
    """What a cutout does with each unit, and the type and bytes of its pixels."""
    kind = hd.pixel_data_type(C("bitpix"))
    return v.hdus(s, d).select("image_id", "hdu_num", hd.hdu_kind(C("ext_type"), C("naxes")).alias("kind"), kind.alias("type"), hd.data_type_size(kind).alias("n_bytes"), hd.pixel_size(C("bitpix")).alias("pixel_bytes"))


def radius_cutout(s, d):
    """Rectangles round a sky position, their pixels, and the shifted reference places as 32-bit numbers."""
    boxes = ct.radius_boxes(v.small_targets(s, d))
    rows = px.join_box_tiles(boxes, px.tiles(v.pixels(s, d)))
    sums = rows.groupBy("image_id").agg(F.count("*").alias("n"), R(F.sum(C("v").cast("double") * (C("x") - C("xmin") + 1 + 10 * (C("y") - C("ymin") + 1))), 4).alias("total"))
    shifted = lambda p, lo: F.format_string("%.8E", (C(p) + 1 - C(lo)).cast("float"))
    return boxes.join(sums, "image_id").select("image_id", "xmin", "ymin", "xmax", "ymax", "n", "total", shifted("crpix1", "xmin").alias("crpix1"), shifted("crpix2", "ymin").alias("crpix2"))


def agg_any_null(s, d):
    return px.agg_any_null(v.pixels(s, d).withColumn("v", F.when(C("v") >= -0.2, C("v"))), -9.0)


def join_overlay(s, d):
    new = v.pixels(s, d).where("x <= 2").select("image_id", "x", "y", (C("v") * 0 + C("x")).cast("float").alias("v"))
    return px.join_overlay(v.pixels(s, d), new)


def _hdus(s, d):
    """Units of files from line items: the keyword names depend on two flags."""
    names = F.concat(F.array(F.lit("NAXIS"), F.lit("BITPIX")), F.when(C("l_returnflag") == "R", F.array(F.lit("RETURNED"))).otherwise(F.array().cast("array<string>")))
    units = v.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    return units.select(C("l_orderkey").alias("image_id"), (C("l_linenumber") * 2880).cast("long").alias("offset"), names.alias("names"))


_HDUS_SQL = "hdus AS (SELECT l_orderkey AS image_id, CAST(l_linenumber * 2880 AS BIGINT) AS \"offset\", CASE WHEN max(l_returnflag) = 'R' THEN 'r' ELSE '' END AS names FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def cards(s, d):
    k = v.keywords(s, d).where("name <> 'COMMENT'").withColumn("card", hd.card_format(C("name"), C("value"), F.lit("a note")))
    return k.withColumn("p", hd.card_parse(C("card"))).select("image_id", "pos", F.length("card").alias("n"), C("p.name").alias("name"), C("p.value").alias("value"), C("p.comment").alias("note"))


def keyword_equal(s, d):
    k = v.keywords(s, d).select("image_id", F.struct("name", "value").alias("kv"), "name")
    one, two = k.where("name = 'CRPIX1'"), k.where("name = 'CRPIX2A'").select("image_id", F.struct(F.lit("CRPIX1").alias("name"), C("kv.value").alias("value")).alias("other"))
    return one.join(two, "image_id").select("image_id", C("kv").eqNullSafe(C("other")).alias("same"))


def header_keys_new(s, d):
    k = v.keywords(s, d)
    return hd.join_keywords_new(k, k.where(C("pos") % 2 == C("image_id") % 2)).select("image_id", "pos", "name")


def _points(s, d):
    return v.targets(s, d).select(C("image_id").alias("point_id"), "ra", "dec")


#: A condition that users may give, and the columns that it may name.
CONDITION, ALLOWED = "naxis1 < 40 AND crpix1 > -10 OR naxis1 = 58", ["naxis1", "naxis2", "crpix1"]


def search_catalog(s, d):
    """Positional and relational search of all sessions under each kind of table."""
    images = v.images(s, d).withColumns({"row_gid": (C("image_id") % 25).cast("int"), "pub_date": F.timestamp_add("DAY", (C("image_id") % 4000).cast("int"), F.lit("1990-01-01").cast("timestamp"))})
    return se.search_catalog(_points(s, d), images, v.roles(s, d), v.AS_OF, 2, CONDITION, ALLOWED)


def filter_where(s, d):
    return se.filter_where(v.images(s, d), CONDITION, ALLOWED).select("image_id", "naxis1")


def _collections(s, d):
    return v.table(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/")).alias("prefix"), F.concat(F.lit("/data/R"), "n_regionkey").alias("physical_root"), (C("n_nationkey") % 7 == 0).alias("internal"), C("n_nationkey").alias("k"))


_COLL_SQL = "coll AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/' AS prefix, '/data/R' || n_regionkey AS physical_root, n_nationkey % 7 = 0 AS internal, n_nationkey AS k FROM nation)"


def join_collection(s, d):
    """Physical places of all files, for users outside."""
    files = v.paths(s, d).where("NOT is_dir").select("path_id", "path_name", F.concat(F.lower(F.regexp_extract("path_name", "^(R[0-9]+/N[0-9]+/)", 1))).alias("prefix"))
    return files.join(_collections(s, d).where("NOT internal"), "prefix").select("path_id", F.concat_ws("/", "physical_root", rq.file_name(C("path_name"))).alias("place"))


def join_status(s, d):
    counts = qa.QUERIES["route_request"](s, d).groupBy("code").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(se.status_codes(s)), "code").select("code", "summary", "description", "n")


def check_set_equal(s, d):
    """Entries expected but not listed, and the other way."""
    a, b = v.paths(s, d).where("NOT is_dir").select("path_name"), v.disk(s, d).where("NOT is_dir").select("path_name")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionAll(b.exceptAll(a).withColumn("side", F.lit("extra")))


QUERIES = {
    "unit_conversion": unit_conversion,
    "sky_vectors": sky_vectors,
    "pixel_to_sky": pixel_to_sky,
    "sky_to_pixel": sky_to_pixel,
    "footprint_corners": footprint_corners,
    "pixel_box_pixels": pixel_box_pixels,
    "pixel_search": pixel_search,
    "pixel_box_sky": pixel_box_sky,
    "radius_bounds": radius_bounds,
    "filter_box": lambda s, d: px.filter_box(v.pixels(s, d), F.lit(2), F.lit(3), F.lit(6), F.lit(7)),
    "filter_strided": lambda s, d: px.filter_strided(v.pixels(s, d), {"x": 1, "y": 2}, {"x": 8, "y": 8}, {"x": 3, "y": 2}),
    "agg_any_null": agg_any_null,
    "agg_subset_bytes": lambda s, d: px.agg_subset_bytes(v.boxes(s, d), 4),
    "join_box_tiles": join_box_tiles,
    "cutout": cutout,
    "radius_cutout": radius_cutout,
    "hdu_is_cuttable": hdu_kinds,
    "copy_hdus": lambda s, d: hd.copy_hdus(v.hdus(s, d)).select("image_id", "hdu_num", "ext_type", F.size("naxes").alias("axes")),
    "join_request_hdus": lambda s, d: ct.join_request_hdus(cutout_requests(s, d), v.hdus(s, d)).select("request_id", "hdu_num", "ext_type", "kind"),
    "rewrite_header_radius": lambda s, d: hd.rewrite_header_radius(v.keywords(s, d), v.boxes(s, d), C("image_id") % 2 == 0),
    "join_overlay": join_overlay,
    "filter_keywords_drop": lambda s, d: hd.filter_keywords_drop(v.keywords(s, d), True),
    "rewrite_header": lambda s, d: hd.rewrite_header(v.keywords(s, d), v.boxes(s, d)),
    "union_header": lambda s, d: hd.union_header(v.keywords(s, d)),
    "card_round_trip": cards,
    "keyword_equal": keyword_equal,
    "join_keywords_new": header_keys_new,
    "agg_keyword_count": lambda s, d: v.keywords(s, d).groupBy("image_id", "hdu_num").agg(F.count("*").alias("n")),
    "agg_hdu_count": lambda s, d: _hdus(s, d).groupBy("image_id").agg(F.count("*").alias("n")),
    "agg_output_bytes": lambda s, d: hd.agg_output_bytes(v.keywords(s, d), v.boxes(s, d), 4),
    "win_hdu_number": lambda s, d: hd.win_hdu_number(_hdus(s, d)).fillna(0, ["next_offset"]),
    "win_keyword_schema_drift": lambda s, d: hd.win_keyword_schema_drift(_hdus(s, d)),
    "join_positional": lambda s, d: se.join_positional(_points(s, d), v.images(s, d)),
    "search_catalog": search_catalog,
    "filter_where": filter_where,
    "scan_collections": lambda s, d: _collections(s, d),
    "filter_internal": lambda s, d: _collections(s, d).where("NOT internal").select("prefix", "physical_root"),
    "join_collection": join_collection,
    "join_status": join_status,
    "check_set_equal": check_set_equal,
}

_T = f"WITH {v.TARGETS_SQL}"
_PIX = """,
cc AS (SELECT *, radians(ra) - radians(crval1) AS da, radians(dec) AS de, radians(crval2) AS d0 FROM targets),
cp AS (SELECT *, sin(de) * sin(d0) + cos(de) * cos(d0) * cos(da) AS c FROM cc),
ct AS (SELECT *, degrees(cos(de) * sin(da) / c) AS xi, degrees((sin(de) * cos(d0) - cos(de) * sin(d0) * cos(da)) / c) AS eta, cd11 * cd22 - cd12 * cd21 AS det FROM cp),
pix AS (SELECT *, crpix1 + (cd22 * xi - cd12 * eta) / det AS x0, crpix2 + (cd11 * eta - cd21 * xi) / det AS y0 FROM ct)"""


def _sky(x: str, y: str) -> tuple[str, str]:
    xi, eta = f"radians(cd11 * ({x} - crpix1) + cd12 * ({y} - crpix2))", f"radians(cd21 * ({x} - crpix1) + cd22 * ({y} - crpix2))"
    den = f"(cos(radians(crval2)) - {eta} * sin(radians(crval2)))"
    ra = f"(degrees(radians(crval1) + atan2({xi}, {den})))"
    return f"round(CASE WHEN fmod({ra}, 360) < 0 THEN fmod({ra}, 360) + 360 ELSE fmod({ra}, 360) END, 9)", f"round(degrees(atan2(sin(radians(crval2)) + {eta} * cos(radians(crval2)), sqrt({xi} * {xi} + {den} * {den}))), 9)"


def _sep(x0: str, y0: str, x1: str, y1: str) -> str:
    """Angle between two places of the plane."""
    at = lambda x, y: (f"radians(cd11 * ({x} - crpix1) + cd12 * ({y} - crpix2))", f"radians(cd21 * ({x} - crpix1) + cd22 * ({y} - crpix2))")
    (a, b), (c, e) = at(x0, y0), at(x1, y1)
    return f"atan2(sqrt(({b} - {e}) ^ 2 + ({c} - {a}) ^ 2 + ({a} * {e} - {b} * {c}) ^ 2), {a} * {c} + {b} * {e} + 1)"


def _edge(axis: str, k: int, start: str, size: str) -> str:
    """The first step behind which the angle exceeds the size."""
    at = f"({start} + {k} * j)"
    sep = _sep("x0", "y0", at, "y0") if axis == "x" else _sep("x0", "y0", "x0", at)
    return f"(SELECT min(j) FROM generate_series(0, 400) t(j) WHERE {sep} > {size})"


def _found(axis: str, k: int) -> str:
    c, size = f"{axis}0", "radians(width) / 2" if axis == "x" else "radians(height) / 2"
    return f"CAST(floor({c} + 0.5) + {k} * {_edge(axis, k, f'(floor({c} + 0.5) + {0.5 * k})', size)} AS BIGINT)"


_SEARCH = ", ".join(f"{_found(a, k)} AS {a}{n}" for a in "xy" for k, n in ((-1, "min"), (1, "max")))
_RADIUS = ", ".join(f"CAST(floor(abs({a}0 + {k} * ({_edge(a, k, f'{a}0', 'radians(width)')} - 0.5)) + 0.5) AS BIGINT) AS {a}{n}" for a in "xy" for k, n in ((-1, "min"), (1, "max")))
_CORNERS = ", ".join(f"{s} AS {n}{k}" for k, (x, y) in enumerate((("0.5", "0.5"), ("(naxis1 + 0.5)", "0.5"), ("(naxis1 + 0.5)", "(naxis2 + 0.5)"), ("0.5", "(naxis2 + 0.5)")), 1) for n, s in zip(("ra", "dec"), _sky(x, y), strict=True))
_CLAMP = "greatest(xmin, 1) AS xmin, greatest(ymin, 1) AS ymin, least(xmax, naxis1) AS xmax, least(ymax, naxis2) AS ymax"
_OVER = "xmin <= naxis1 AND xmax >= 1 AND ymin <= naxis2 AND ymax >= 1"
_P = f"WITH {v.PIXELS_SQL}, {_CUT_SQL}"
_K = f"WITH {v.KEYWORDS_SQL}, {v.BOXES_SQL}"
# Sky requests look at pixel (4.67, 4.37) and are 0.08 pixels wide; the others ask for 4 by 6 pixels round (7.25, 8.5).
_CUTS = f"""WITH {v.REQUESTS_SQL}, {v.PIXELS_SQL}, {v.UNITS_SQL}, cuts AS (SELECT request_id, 5 AS xmin, CASE WHEN request_id % 10 = 3 THEN 4 ELSE 6 END AS ymin, CASE WHEN request_id % 10 = 3 THEN 5 ELSE 8 END AS xmax, CASE WHEN request_id % 10 = 3 THEN 4 ELSE 8 END AS ymax
FROM requests WHERE request_id % 10 IN (3, 6) AND request_id IN (SELECT vec_id FROM embeddings))"""
_IN = "FROM pixels p JOIN cut c ON p.image_id = c.image_id AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax"
_POS = f"""{_T}, n AS (SELECT t.image_id AS point_id, i.*, radians(t.ra) - radians(i.crval1) AS da, radians(t.dec) AS de, radians(i.crval2) AS d0 FROM targets t JOIN images i ON abs(t.dec - i.crval2) < 2),
m AS (SELECT *, sin(de) * sin(d0) + cos(de) * cos(d0) * cos(da) AS c FROM n),
t2 AS (SELECT *, degrees(cos(de) * sin(da) / c) AS xi, degrees((sin(de) * cos(d0) - cos(de) * sin(d0) * cos(da)) / c) AS eta, cd11 * cd22 - cd12 * cd21 AS det FROM m WHERE c > 0),
q AS (SELECT *, crpix1 + (cd22 * xi - cd12 * eta) / det AS x0, crpix2 + (cd11 * eta - cd21 * xi) / det AS y0 FROM t2),
hits AS (SELECT point_id, image_id, naxis1 FROM q WHERE x0 BETWEEN 0.5 AND naxis1 + 0.5 AND y0 BETWEEN 0.5 AND naxis2 + 0.5)"""

SQL = {
    "unit_conversion": f"{_T}, u AS (SELECT image_id, CASE image_id % 4 WHEN 0 THEN width / 3600 WHEN 1 THEN width / 60 WHEN 2 THEN width ELSE degrees(width) END AS deg FROM targets) SELECT image_id, round(deg, 9) AS deg, round(radians(deg), 12) AS rad FROM u",
    "sky_vectors": f"{_T}, w AS (SELECT *, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z, cos(radians(crval2)) * cos(radians(crval1)) AS a, cos(radians(crval2)) * sin(radians(crval1)) AS b, sin(radians(crval2)) AS c FROM targets) SELECT image_id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(atan2(sqrt((y * c - z * b) ^ 2 + (z * a - x * c) ^ 2 + (x * b - y * a) ^ 2), x * a + y * b + z * c), 9) AS sep, CASE WHEN fmod(ra - 300, 360) < 0 THEN fmod(ra - 300, 360) + 360 ELSE fmod(ra - 300, 360) END AS ra_norm, dec * 1.5::DOUBLE BETWEEN -90 AND 90 AS dec_ok FROM w",
    "pixel_to_sky": f"{_T} SELECT image_id, {_sky('1.25', '3.5')[0]} AS ra, {_sky('1.25', '3.5')[1]} AS dec FROM images",
    "sky_to_pixel": f"{_T}{_PIX} SELECT image_id, round(x0, 6) AS x, round(y0, 6) AS y, CAST(floor(x0 + 0.5) AS BIGINT) AS px, CAST(floor(y0 + 0.5) AS BIGINT) AS py FROM pix",
    "footprint_corners": f"{_T} SELECT image_id, {_CORNERS} FROM images",
    "pixel_box_pixels": f"{_T}, c AS (SELECT *, naxis1 * 0.5::DOUBLE + (image_id % 17 - 8) * 2.25::DOUBLE + 0.1 AS x, naxis1 * 0.5::DOUBLE + (image_id % 23 - 11) * 1.75::DOUBLE + 0.2 AS y FROM images), b AS (SELECT *, CAST(floor(x - 3.25 + 0.5) AS BIGINT) AS xmin, CAST(floor(y - 3.25 + 0.5) AS BIGINT) AS ymin, CAST(floor(x + 3.25 + 0.5) AS BIGINT) AS xmax, CAST(floor(y + 3.25 + 0.5) AS BIGINT) AS ymax FROM c) SELECT image_id, {_CLAMP} FROM b WHERE {_OVER}",
    "pixel_search": f"{_T}{_PIX} SELECT image_id, {_SEARCH} FROM pix",
    "pixel_box_sky": f"{_T}{_PIX}, f AS (SELECT image_id, naxis1, naxis2, {_SEARCH} FROM pix) SELECT image_id, {_CLAMP} FROM f WHERE {_OVER}",
    "radius_bounds": f"{_T}{_PIX} SELECT image_id, {_RADIUS} FROM pix",
    "filter_box": f"{_P} SELECT * FROM pixels WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 7",
    "filter_strided": f"{_P} SELECT * FROM pixels WHERE x IN (1, 4, 7) AND y IN (2, 4, 6, 8)",
    "agg_any_null": f"{_P}, q AS (SELECT image_id, CASE WHEN v >= -0.2 THEN v END AS v FROM pixels) SELECT image_id, bool_or(v IS NULL) AS any_null, CAST(min(coalesce(v, -9.0)) AS DOUBLE) AS low, CAST(max(coalesce(v, -9.0)) AS DOUBLE) AS high, count(*) AS n FROM q GROUP BY 1",
    "agg_subset_bytes": f"{_K} SELECT image_id, (xmax - xmin + 1) * (ymax - ymin + 1) * 4 AS n_bytes FROM boxes",
    "join_box_tiles": f"{_P} SELECT p.image_id, x, y, v {_IN}",
    "cutout": f"""{_CUTS}, ok AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM units u WHERE u.image_id = c.request_id AND axes = 3) AS fine FROM cuts c),
px AS (SELECT request_id, count(*) AS n, round(sum(CAST(v AS DOUBLE) * (x - xmin + 1 + 10 * (y - ymin + 1))), 4) AS total FROM ok JOIN pixels ON request_id = image_id AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax WHERE fine GROUP BY 1)
SELECT ok.request_id, CASE WHEN fine THEN 200 ELSE 500 END AS status, coalesce(hdu_num, 0) AS hdu_num, CASE WHEN hdu_num IS NULL THEN NULL WHEN hdu_num = 1 THEN 'cut' ELSE 'copy' END AS kind, CASE hdu_num WHEN 1 THEN (xmax - xmin + 1) || 'x' || (ymax - ymin + 1) WHEN 2 THEN '16x4' WHEN 3 THEN '' END AS sides,
CASE WHEN hdu_num = 1 THEN n ELSE 0 END AS n, CASE WHEN hdu_num = 1 THEN total ELSE 0 END AS total FROM ok LEFT JOIN units ON fine AND request_id = units.image_id LEFT JOIN px ON px.request_id = ok.request_id""",
    "hdu_is_cuttable": f"WITH {v.UNITS_SQL} SELECT image_id, hdu_num, CASE hdu_num WHEN 1 THEN 'cut' WHEN 4 THEN 'error' ELSE 'copy' END AS kind, CASE hdu_num WHEN 1 THEN 'float' WHEN 2 THEN 'byte' WHEN 3 THEN 'short' ELSE 'double' END AS type, CASE hdu_num WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 8 END AS n_bytes, CASE hdu_num WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 8 END AS pixel_bytes FROM units",
    "copy_hdus": f"WITH {v.UNITS_SQL} SELECT image_id, hdu_num, ext_type, axes FROM units WHERE ext_type <> 'image' OR axes = 0",
    "join_request_hdus": f"{_CUTS} SELECT request_id, hdu_num, ext_type, CASE WHEN ext_type <> 'image' OR axes = 0 THEN 'copy' WHEN axes = 2 THEN 'cut' ELSE 'error' END AS kind FROM cuts JOIN units ON request_id = image_id",
    "rewrite_header_radius": f"{_K} SELECT k.image_id, hdu_num, pos, name, CASE name WHEN 'NAXIS1' THEN CAST(xmax - xmin + 1 AS VARCHAR) WHEN 'NAXIS2' THEN CAST(ymax - ymin + 1 AS VARCHAR) WHEN 'CRPIX1' THEN format('{{:.8E}}', CAST(CAST(value AS DOUBLE) + 1 - xmin AS FLOAT)) ELSE value END AS value FROM keywords k JOIN boxes USING (image_id)",
    "radius_cutout": f"""WITH {v.PIXELS_SQL}, {v.SMALL_TARGETS_SQL}{_PIX}, rb AS (SELECT image_id, naxis1, naxis2, {_RADIUS} FROM pix), b AS (SELECT image_id, {_CLAMP} FROM rb WHERE {_OVER})
SELECT b.*, count(*) AS n, round(sum(CAST(v AS DOUBLE) * (x - xmin + 1 + 10 * (y - ymin + 1))), 4) AS total, format('{{:.8E}}', 5.5::DOUBLE - xmin) AS crpix1, format('{{:.8E}}', 5.5::DOUBLE - ymin) AS crpix2
FROM b JOIN pixels p ON p.image_id = b.image_id AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY ALL""",
    "join_overlay": f"{_P} SELECT image_id, x, y, CASE WHEN x <= 2 THEN CAST(x AS FLOAT) ELSE v END AS v FROM pixels",
    "filter_keywords_drop": f"{_K} SELECT * FROM keywords WHERE name NOT IN ('CHECKSUM', 'DATASUM', 'EXTEND', 'PCOUNT', 'GCOUNT') AND (name <> 'COMMENT' OR value = 'a remark')",
    "rewrite_header": f"{_K} SELECT k.image_id, hdu_num, pos, name, CASE name WHEN 'NAXIS1' THEN CAST(xmax - xmin + 1 AS VARCHAR) WHEN 'NAXIS2' THEN CAST(ymax - ymin + 1 AS VARCHAR) WHEN 'LTV1' THEN format('{{:.15E}}', CAST(value AS DOUBLE) + xmin - 1) WHEN 'LTV2' THEN format('{{:.15E}}', CAST(value AS DOUBLE) + ymin - 1) WHEN 'CRPIX1' THEN format('{{:.15E}}', CAST(value AS DOUBLE) + 1 - xmin) WHEN 'CRPIX2A' THEN format('{{:.15E}}', CAST(value AS DOUBLE) + 1 - ymin) ELSE value END AS value FROM keywords k JOIN boxes USING (image_id) WHERE name NOT IN ('CHECKSUM', 'DATASUM')",
    "union_header": f"{_K}, u AS (SELECT image_id, hdu_num, name, value, CAST(pos AS DOUBLE) AS key FROM keywords WHERE name NOT IN ('CHECKSUM', 'DATASUM', 'EXTEND', 'PCOUNT', 'GCOUNT', 'SIMPLE') AND (name <> 'COMMENT' OR value = 'a remark') UNION ALL SELECT image_id, hdu_num, 'XTENSION', 'IMAGE', 0 FROM keywords WHERE name = 'NAXIS2' UNION ALL SELECT image_id, hdu_num, 'PCOUNT', '0', pos + 0.1 FROM keywords WHERE name = 'NAXIS2' UNION ALL SELECT image_id, hdu_num, 'GCOUNT', '1', pos + 0.2 FROM keywords WHERE name = 'NAXIS2') SELECT image_id, hdu_num, CAST(row_number() OVER (PARTITION BY image_id, hdu_num ORDER BY key) AS INT) AS pos, name, value FROM u",
    "card_round_trip": f"{_K} SELECT image_id, pos, 80 AS n, name, value, 'a note' AS note FROM keywords WHERE name <> 'COMMENT'",
    "keyword_equal": f"{_K} SELECT a.image_id, a.value = b.value AS same FROM keywords a JOIN keywords b ON a.image_id = b.image_id AND a.name = 'CRPIX1' AND b.name = 'CRPIX2A'",
    "join_keywords_new": f"{_K} SELECT image_id, pos, name FROM keywords WHERE pos % 2 <> image_id % 2 OR name = 'COMMENT'",
    "agg_keyword_count": f"{_K} SELECT image_id, hdu_num, count(*) AS n FROM keywords GROUP BY 1, 2",
    "agg_hdu_count": "SELECT l_orderkey AS image_id, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1",
    "agg_output_bytes": f"{_K}, n AS (SELECT image_id, count(*) AS n FROM keywords GROUP BY 1) SELECT image_id, CAST(ceil((n + 1) * 80 / 2880) * 2880 + ceil((xmax - xmin + 1) * (ymax - ymin + 1) * 4 / 2880) * 2880 AS BIGINT) AS n_bytes FROM n JOIN boxes USING (image_id)",
    "win_hdu_number": f'WITH {_HDUS_SQL} SELECT image_id, "offset", CAST(row_number() OVER w AS INT) AS hdu_num, coalesce(lead("offset") OVER w, 0) AS next_offset FROM hdus WINDOW w AS (PARTITION BY image_id ORDER BY "offset")',
    "win_keyword_schema_drift": f'WITH {_HDUS_SQL}, n AS (SELECT *, CAST(row_number() OVER w AS INT) AS hdu_num, lag(names) OVER w AS before FROM hdus WINDOW w AS (PARTITION BY image_id ORDER BY "offset")) SELECT image_id, hdu_num, names IS DISTINCT FROM before AS drift FROM n WHERE hdu_num >= 3',
    "join_positional": f"{_POS} SELECT point_id, image_id FROM hits",
    "search_catalog": f"""{_POS}, {v.ROLES_SQL}, su AS (SELECT DISTINCT session_id AS su_id FROM roles WHERE mission_id = -99 AND group_id = -99),
gs AS (SELECT session_id, mission_id, list(DISTINCT group_id) AS groups, any_value(su_id) IS NOT NULL AS super FROM roles LEFT JOIN su ON session_id = su_id WHERE mission_id > 0 GROUP BY 1, 2),
h AS (SELECT image_id % 25 AS gid, TIMESTAMP '1990-01-01' + to_days(CAST(image_id % 4000 AS INT)) < TIMESTAMP '{v.AS_OF}' AS early, point_id * 31 + image_id AS code FROM hits WHERE (naxis1 < 40 AND naxis1 > -21) OR naxis1 = 58),
z AS (SELECT gid, early, count(*) AS n, sum(code) AS code FROM h GROUP BY 1, 2),
k AS (SELECT *, unnest(['granted', 'denied', 'by_table', 'row_only', 'date_only', 'row_date']) AS kind FROM gs)
SELECT session_id, CAST(mission_id AS INT) AS mission_id, kind, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(code), 0) AS BIGINT) AS code FROM k LEFT JOIN z ON CASE kind WHEN 'granted' THEN true WHEN 'denied' THEN false WHEN 'by_table' THEN super OR list_contains(groups, 2)
WHEN 'row_only' THEN super OR list_contains(groups, gid) WHEN 'date_only' THEN early ELSE super OR early OR list_contains(groups, gid) END GROUP BY 1, 2, 3""",
    "filter_where": f"{_T} SELECT image_id, naxis1 FROM images WHERE naxis1 < 40 AND crpix1 > -10 OR naxis1 = 58",
    "scan_collections": f"WITH {_COLL_SQL} SELECT * FROM coll",
    "filter_internal": f"WITH {_COLL_SQL} SELECT prefix, physical_root FROM coll WHERE NOT internal",
    "join_collection": f"WITH {v.PATHS_SQL}, {_COLL_SQL} SELECT path_id, physical_root || '/' || regexp_extract(path_name, '([^/]*)$', 1) AS place FROM paths JOIN coll ON lower(regexp_extract(path_name, '^(R[0-9]+/N[0-9]+/)', 1)) = prefix WHERE NOT is_dir AND NOT internal",
    "join_status": f"SELECT code, CASE code WHEN 200 THEN 'OK' WHEN 400 THEN 'Bad Request' WHEN 404 THEN 'Not Found' ELSE 'Internal Server Error' END AS summary, CASE code WHEN 200 THEN 'The request has succeeded.' WHEN 400 THEN 'The request could not be understood by the server due to malformed syntax.' WHEN 404 THEN 'The server has not found anything matching the Request-URI.' ELSE 'The server encountered an unexpected condition which prevented it from fulfilling the request.' END AS description, count(*) AS n FROM ({qa.SQL['route_request']}) GROUP BY 1, 2, 3",
    "check_set_equal": f"WITH {v.PATHS_SQL}, {v.DISK_SQL} SELECT path_name, 'missing' AS side FROM paths WHERE NOT is_dir AND path_name NOT IN (SELECT path_name FROM disk) UNION ALL SELECT path_name, 'extra' FROM disk WHERE NOT is_dir AND path_name NOT IN (SELECT path_name FROM paths)",
}
