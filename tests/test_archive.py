"""Access matrix, odd requests, golden boxes, FITS files and streams."""

import gzip
import pickle

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import Row
from pyspark.sql import functions as F

from skyledger.functions import geometry as g
from skyledger.functions import requests as rq
from skyledger.operators import access as ac
from skyledger.operators import cutout as ct
from skyledger.operators import headers as hd
from skyledger.operators import pixels as px
from skyledger.operators import search as se
from skyledger.plans import registry
from skyledger.sources import fits
from skyledger.sources import fits_store as fs
from skyledger.streaming import requests as st

USERS = {"1": [1, 3, 5, 7], "2": [2, 4, 6, 8], "3": list(range(1, 10)), "4": [10, 11], "5": [-99], "anon": []}
VISIBLE = {
    "GRANTED": [18] * 6,
    "DENIED": [0] * 6,
    "TABLE": [0, 18, 18, 0, 18, 0],
    "ROW_ONLY": [8, 8, 18, 0, 18, 0],
    "DATE_ONLY": [9] * 6,
    "ROW_DATE": [13, 13, 18, 9, 18, 9],
}


def test_access_matrix(spark):
    files = [(i, 0, f"{'123' if k <= 3 else '45' if k <= 5 else '6789'}/{k}/f{i}.fits", False, k, d) for k in range(1, 10) for i, d in ((2 * k - 1, "1800-01-01"), (2 * k, "2200-01-01"))]
    paths = spark.createDataFrame(files, "path_id long, parent_path_id long, path_name string, is_dir boolean, row_gid int, d string").withColumn("pub_date", F.col("d").cast("timestamp"))
    roles = spark.createDataFrame([(u, -99 if x == -99 else 200, x) for u, gs in USERS.items() for x in gs], "session_id string, mission_id int, group_id int")
    asked, n, mission = [], 0, 200
    for policy in VISIBLE:
        group = {"TABLE": "&group=2", "ROW_ONLY": "&group=0", "DATE_ONLY": "&group=0", "ROW_DATE": "&group=0"}.get(policy, "")
        for u in USERS:
            for f in files:
                asked.append((n, "HTTP/1.1", f"path={f[2]}&policy=ACCESS_{policy}&mission={mission}{group}&pgconn=db&pgtable=files", f"JOSSO_SESSIONID={u}", policy, u))
                n += 1
    req = spark.createDataFrame(asked, "request_id long, protocol string, query_string string, cookie string, policy_name string, user string")
    got = ac.check_access(req, paths, roles, "2020-01-01").join(req, "request_id").groupBy("policy_name", "user").agg(F.sum((F.col("status") == 200).cast("int")).alias("n")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(p, u): v for p, row in VISIBLE.items() for u, v in zip(USERS, row, strict=True)}


def test_policy_reads(spark):
    """Roles count for their own mission only; a policy that does not read the table needs no row there."""
    paths = spark.createDataFrame([(1, 0, "a.fits", False, 3, None), (2, 77, "lost.fits", False, 3, None)], "path_id long, parent_path_id long, path_name string, is_dir boolean, row_gid int, pub_date timestamp")
    roles = spark.createDataFrame([("u", 200, 3), ("s", -99, -99)], "session_id string, mission_id int, group_id int")
    both = "&pgconn=db&pgtable=t"
    cases = [
        ("u", f"path=a.fits&policy=ACCESS_ROW_ONLY&mission=200&group=0{both}", 200),
        ("u", f"path=a.fits&policy=ACCESS_ROW_ONLY&mission=300&group=0{both}", 404),
        ("s", f"path=a.fits&policy=ACCESS_ROW_ONLY&mission=300&group=0{both}", 200),
        ("s", f"path=none&policy=ACCESS_ROW_ONLY&mission=300&group=0{both}", 404),
        ("u", "path=a.fits&policy=ACCESS_ROW_ONLY&mission=200&group=0&pgconn=db", 400),
        ("u", "path=a.fits&policy=ACCESS_ROW_ONLY&mission=200&group=3&pgconn=db", 500),
        ("u", "path=none&policy=ACCESS_GRANTED", 200),
        ("u", "path=none&policy=ACCESS_GRANTED&pgconn=db&pgtable=t", 404),
        ("u", "path=none&policy=ACCESS_TABLE&mission=200&group=3", 200),
        ("u", "path=none&policy=ACCESS_DENIED", 404),
        ("u", "path=a.fits&policy=ACCESS_GRANTED&policy=ACCESS_GRANTED", 400),
        ("u", "path=a.fits&mission=x", 400),
    ]
    req = spark.createDataFrame([(i, "HTTP/1.1", q, f"JOSSO_SESSIONID={u}") for i, (u, q, _) in enumerate(cases)], "request_id long, protocol string, query_string string, cookie string")
    got = {r.request_id: r.status for r in ac.check_access(req, paths, roles, "2020-01-01").collect()}
    assert [got[i] for i in range(len(cases))] == [c for *_, c in cases]
    assert [r.entry for r in ac.join_listing(paths).collect()] == ["a.fits"]


def test_units(spark):
    spellings = {"pixel": "p px pix pixel pixels", "arcsec": "\" asec a-sec arcsec arc-sec asecond arc-seconds", "arcmin": "' amin a-min arcmin arc-min aminute arc-minutes", "deg": "d deg degree degrees", "rad": "rad radian radians"}
    rows = [(u, x) for u, xs in spellings.items() for x in xs.split()] + [(None, "arcs"), (None, "pixe"), (None, "-"), (None, "Deg")]
    got = spark.createDataFrame(rows, "u string, x string").select("u", rq.parse_coords(F.concat(F.lit("1.5,2"), "x"))["units"].alias("got")).collect()
    assert all(r.u == r.got for r in got)


def test_rotated_positions(spark):
    """A turned image keeps the points near its corners."""
    r = 2**-0.5
    images = spark.createDataFrame([(1, 400, 40, 10.0, 20.0, 200.5, 20.5, 0.0, 0.01, 0.01, 0.0), (2, 400, 40, 50.0, -20.0, 200.5, 20.5, -0.01 * r, 0.01 * r, 0.01 * r, 0.01 * r)], "image_id long, naxis1 long, naxis2 long, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double")
    at = images.select("image_id", F.inline(F.array(*[g.pixel_to_sky(F.lit(float(x)), F.lit(float(y))) for x in (2, 200, 399) for y in (2, 39)])))
    points = at.withColumn("point_id", F.monotonically_increasing_id())
    got = {(x.point_id, x.image_id) for x in se.join_positional(points.select("point_id", "ra", "dec"), images).collect()}
    assert got == {(x.point_id, x.image_id) for x in points.collect()}


@pytest.mark.parametrize(
    "query, want",
    [
        ("center=1.5%2C2&size=3%22&gzip=on", [("center", "1.5,2"), ("size", '3"'), ("gzip", "on")]),
        ("x=%zz+1", [("x", "%zz 1")]),
        ("a&b=7", [("a&b", "7")]),
        ("path=a+b%20c", [("path", "a+b%20c")]),
        ("k=", [("k", "")]),
        ("novalue", []),
        ("=v&k=1", [("", "v"), ("k", "1")]),
    ],
)
def test_parse_query(spark, query, want):
    got = spark.createDataFrame([(query,)], "q string").select(rq.parse_query(F.col("q"))).first()[0]
    assert [(r.key, r.value) for r in got] == want


def test_parse_values(spark):
    coords = {"1,2": (1, 2, "deg"), "1.5 , -2deg": (1.5, -2, "deg"), '3"': (3, 3, "arcsec"), "3arcsec": (3, 3, "arcsec"), "2'": (2, 2, "arcmin"), "1,": None, "x,1": None, "1 2": None, "1,2,3": None}
    got = spark.createDataFrame([(k,) for k in coords], "q string").select("q", rq.parse_coords(F.col("q")).alias("c")).collect()
    assert {r.q: tuple(r.c) if r.c else None for r in got} == coords
    flags = dict.fromkeys("1 o on y yes t TRUE".split(), True) | dict.fromkeys("0 n no of off f False".split(), False) | {"2": None, "": None}
    got = spark.createDataFrame([(k,) for k in flags], "q string").select("q", rq.parse_bool(F.col("q")).alias("b")).collect()
    assert {r.q: r.b for r in got} == flags
    ints = {"12x": 12, "-7": -7, "x": None, "99999999999": None, " +3": 3}
    got = spark.createDataFrame([(k,) for k in ints], "q string").select("q", rq.parse_int(F.col("q")).alias("n")).collect()
    assert {r.q: r.n for r in got} == ints


@pytest.mark.parametrize(
    "centre, size, want",
    [
        ((0.0037, -0.0021), (0.043, 0.043), (2, 2, 6, 6)),
        ((0.0037, -0.0021), (0.061, 0.023), (1, 3, 7, 5)),
        ((359.9813, 0.0188), (0.033, 0.027), (5, 5, 8, 8)),
        ((0.0312, 0.0308), (0.031, 0.031), (1, 6, 3, 8)),
        ((0.0037, -0.0021), (0.21, 0.21), (1, 1, 8, 8)),
        ((0.0037, -0.0021), (0.0, 0.0), (4, 4, 4, 4)),
        ((1.5, 0.0021), (0.031, 0.031), None),
        ((0.0037, -0.0021), (190.0, 190.0), (1, 1, 8, 8)),
    ],
)
def test_golden_boxes(spark, centre, size, want):
    wcs = dict(crval1=0.0, crval2=0.0, crpix1=4.5, crpix2=4.5, cd11=-0.01, cd12=0.0, cd21=0.0, cd22=0.01)
    t = spark.range(1).select(*[F.lit(v).alias(k) for k, v in wcs.items()]).withColumn("p", g.sky_to_pixel(F.lit(centre[0]), F.lit(centre[1]))).withColumns({"x0": F.col("p.x"), "y0": F.col("p.y")})
    edge = lambda a, k: g.pixel_search(F.col("x0"), F.col("y0"), a, k, F.radians(F.lit(size[0 if a == "x" else 1])) / 2)
    eight = F.lit(8).cast("long")
    b = t.select(g.clamp_box(edge("x", -1), edge("y", -1), edge("x", 1), edge("y", 1), eight, eight).alias("b")).first()["b"]
    assert (tuple(b) if b else None) == want


def test_header_values(spark):
    rows = spark.createDataFrame([("NAXIS1", "8"), ("NAXIS2", "8"), ("CRPIX1", "4.5"), ("CRPIX2A", "4.5"), ("LTV1", "0"), ("LTV2", "1"), ("OBJECT", "x")], "name string, value string")
    box = {k: F.lit(v) for k, v in dict(xmin=2, ymin=3, xmax=6, ymax=8).items()}
    got = {r.name: r.v for r in rows.select("name", hd.rewrite_value(box).alias("v")).collect()}
    assert got["NAXIS1"] == "5" and got["NAXIS2"] == "6" and got["OBJECT"] == "x"
    assert [float(got[k]) for k in ("CRPIX1", "CRPIX2A", "LTV1", "LTV2")] == [3.5, 2.5, 1.0, 3.0]
    card = "OBJECT  = 'a / b''s'           / note".ljust(80)
    assert tuple(spark.createDataFrame([(card,)], "c string").select(hd.card_parse(F.col("c"))).first()[0]) == ("OBJECT", "'a / b''s'", "note")


def test_positional_wrap_and_poles(spark):
    images = spark.createDataFrame([(k, 40, 40, ra, dec, 20.5, 20.5, -0.01, 0.0, 0.0, 0.01) for k, (ra, dec) in enumerate([(0.05, 10.0), (359.95, 10.0), (120.0, 89.9), (10.0, -60.0)])], "image_id long, naxis1 long, naxis2 long, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double")
    points = spark.createDataFrame([(1, 0.01, 10.02), (2, 300.0, 89.95), (3, 10.1, -60.05), (4, 180.0, 10.0)], "point_id long, ra double, dec double")
    got = {tuple(r) for r in se.join_positional(points, images).collect()}
    assert got == {(1, 0), (1, 1), (2, 2), (3, 3)}
    with pytest.raises(ValueError):
        se.filter_where(images, "image_id < 3; drop", ["image_id"])


def test_fits_files(spark, tmp_path):
    """Whole numbers of 64 bits stay whole, places without a pixel are blank, and files that are none are rows."""
    root = str(tmp_path / "f")
    pixels = [("a/x.fits", u, x, y, 2**60 + x + 3 * y) for u in (1, 2) for y in (1, 3) for x in (1, 2, 3) if (x, y) != (2, 3)]
    parts = fits.sink_fits(spark.createDataFrame(pixels, "path string, hdu_num int, x long, y long, v long"), 64, -1, F.array(hd.card_format(F.lit("OBJECT"), F.lit("'a/b'"), F.lit("c"))))
    whole = b"".join(bytes(r.content) for r in parts.where("hdu_num = 1").orderBy("part").collect())
    fs.write_products(parts.unionByName(spark.createDataFrame([("y.fits", 1, 0, bytearray(whole[:2900])), ("z.fits", 1, 0, bytearray(b"no"))], "path string, hdu_num int, part long, content binary")), root)
    with open(tmp_path / "f/y.fits", "r+b") as f:
        f.truncate(2900)
    units = fs.stored_units(spark, root)
    assert sorted(r.error for r in units.where("status = 'error'").collect()) == ["header without END", "unit 1: data end early"]
    got = units.where("status = 'ok'").orderBy("hdu_num").collect()
    assert [(r.hdu_num, r.ext_type, r.bitpix, list(r.naxes)) for r in got] == [(1, "image", 64, [3, 3]), (2, "image", 64, [3, 3])]
    assert {r.value for r in fs.keywords(units).where("name = 'OBJECT'").collect()} == {"'a/b     '"}
    p = fits.tile_pixels(fs.scan_fits_tiles(units, 2)).where("hdu_num = 2").orderBy("y", "x").collect()
    assert [r.raw_int for r in p] == [2**60 + 4, 2**60 + 5, 2**60 + 6, -1, -1, -1, 2**60 + 10, -1, 2**60 + 12] and {r.raw_float for r in p} == {None}
    assert {r.path for r in fits.scan_directory(spark, root).collect()} == {"", "a/", "a/x.fits", "y.fits", "z.fits"}
    fs.write_products(parts.withColumn("path", F.concat("path", F.lit(".gz"))), root, compress=True)
    data = gzip.decompress((tmp_path / "f/a/x.fits.gz").read_bytes())
    assert data == (tmp_path / "f/a/x.fits").read_bytes() and len(data) == 4 * fs.BLOCK
    wanted = spark.createDataFrame([("a/x.fits",), ("none",)], "path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(fs.relative(F.col("path"), root).alias("path"), "content")
    (r,) = fits.fetch_file(wanted, files).collect()
    assert (r.length, r.type, bytes(r.content)) == (len(data), "application/fits", data)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "HTTP/1.1", "path=R0&gzip=on", "JOSSO_SESSIONID=u1")], st.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = st.write_understood(st.read_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"))
    q.awaitTermination(60)
    assert [(r.path, r.session_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("R0", "u1")]


def test_store_reads_headers_and_ranges(spark, tmp_path, monkeypatch):
    """Headers are read without the pixels, a large image is many tasks, and cut rows equal the image's own."""
    rng = np.random.default_rng(1)
    image = rng.integers(-(2**15), 2**15, (3, 700, 900)).astype(">i2")  # three planes
    cards = [("SIMPLE", "T"), ("BITPIX", "16"), ("NAXIS", "3"), ("NAXIS1", "900"), ("NAXIS2", "700"), ("NAXIS3", "3"), ("OBJECT", "'it''s / x'")]
    head = spark.createDataFrame(cards, "n string, v string").select(hd.card_format(F.col("n"), F.col("v"), F.lit("c")).alias("card"))
    cards = [r.card for r in head.collect()]
    text = spark.range(1).select(fs.header_text(F.array(*map(F.lit, cards)))).first()[0]
    assert len(text) == fs.BLOCK and all(len(c) == 80 for c in cards)
    parts = [("b/x.fits", 1, 0, text), *[("b/x.fits", 1, k + 1, bytearray(image[k].tobytes())) for k in range(3)], ("b/x.fits", 2, 0, text), ("y.fits", 1, 0, text)]
    fs.write_products(spark.createDataFrame(parts[::-1], "path string, hdu_num int, part long, content binary"), str(tmp_path / "s"))
    found = {r.path: r.length for r in fs.list_files(spark, str(tmp_path / "s")).select(fs.relative(F.col("path"), str(tmp_path / "s")).alias("path"), "length").collect()}
    whole = fs.BLOCK + -(-image.nbytes // fs.BLOCK) * fs.BLOCK
    assert found == {"b/x.fits": whole + fs.BLOCK, "y.fits": fs.BLOCK}
    assert [p.name for p in (tmp_path / "s").iterdir()] == ["b", "y.fits"] or not list((tmp_path / "s").glob("_pending*"))

    read = []
    with open(tmp_path / "s/b/x.fits", "rb") as f:

        def counted(n, at):
            read.append(n)
            f.seek(at)
            return f.read(n)

        with pytest.raises(ValueError, match="unit 2"):
            list(fs.units_of(counted, whole + fs.BLOCK))
    assert sum(read) <= 2 * fs.AHEAD * fs.BLOCK < image.nbytes / 100

    units = fs.stored_units(spark, str(tmp_path / "s"))
    assert sorted((r.hdu_num, r.status) for r in units.collect()) == [(1, "error"), (1, "ok"), (2, "error")]
    assert {r.name: r.value for r in fs.keywords(units).collect()}["OBJECT"] == "'it''s / x'"
    ranges = fs.bands(units, 64, 200_000)
    assert ranges.count() > 10 and ranges.agg(F.sum("bytes")).first()[0] == image.nbytes
    tiles = fs.scan_fits_tiles(units, 64, 200_000, 300_000)
    assert tiles.rdd.getNumPartitions() > 10 and tiles.where("status <> 'ok'").count() == 0
    box = units.where("status = 'ok'").select("path", "hdu_num", *[F.lit(x).cast("long").alias(n) for n, x in dict(xmin=60, ymin=3, xmax=700, ymax=333).items()])
    rows = px.cut_rows(box, tiles, ["hdu_num"], 64).orderBy("plane", "y").collect()
    assert b"".join(bytes(r.content) for r in rows) == image[:, 2:333, 59:700].tobytes()
    raw = fs.raw_parts(units.where("status = 'ok'"), ["hdu_num"], 1_000_000).orderBy("part").collect()
    assert len(raw) > 3 and b"".join(bytes(r.content) for r in raw) == image.tobytes()

    # a file that goes away is a row, and a failing write leaves nothing behind
    (tmp_path / "s/b/x.fits").unlink()
    assert {r.status for r in fs.scan_fits_tiles(units, 64).collect()} == {"error"}
    twice = spark.createDataFrame([("a.fits", 1, 0, bytearray(b"x")), (None, 1, 0, None)], "path string, hdu_num int, part long, content binary")
    with pytest.raises(Exception):  # noqa: B017
        fs.write_products(twice, str(tmp_path / "t"))
    assert not [p for p in (tmp_path / "t").rglob("*") if p.is_file()]


def tree(spark):
    """The files of the access matrix with their directories, and its users' roles."""
    files = [(i, 0, f"{'123' if k <= 3 else '45' if k <= 5 else '6789'}/{k}/f{i}.fits", False, k, d) for k in range(1, 10) for i, d in ((2 * k - 1, "1800-01-01"), (2 * k, "2200-01-01"))]
    paths = spark.createDataFrame(files, "path_id long, parent_path_id long, path_name string, is_dir boolean, row_gid int, d string").withColumn("pub_date", F.col("d").cast("timestamp")).drop("d")
    roles = spark.createDataFrame([(u, -99 if x == -99 else 200, x) for u, gs in USERS.items() for x in gs] + [("5", 200, 77)], "session_id string, mission_id int, group_id int")
    return paths, roles


def test_ancestors_have_ids(spark):
    paths, _ = tree(spark)
    rows = ac.agg_ancestors(paths).orderBy("path_id").collect()
    names = sorted({"", "123", "45", "6789", *(f"{'123' if k <= 3 else '45' if k <= 5 else '6789'}/{k}" for k in range(1, 10))})
    assert [r.directory for r in rows] == names and [r.path_id for r in rows] == list(range(13))
    assert all(r.parent_path_id == (-1 if not r.directory else names.index(r.directory.rpartition("/")[0])) for r in rows)


def test_expected_access(spark):
    """For every kind of table and every directory as counted file by file."""
    paths, roles = tree(spark)
    got = {(r.session_id, r.directory): r for r in ac.expected_access(paths, roles, "2020-01-01", 2).collect()}
    files = paths.collect()
    for user, groups in {**USERS, "": []}.items():
        if user == "anon":
            continue
        for d in {r.directory for r in got.values()}:
            below = [f for f in files if f.path_name.startswith(d + "/" * bool(d))]
            early = [f for f in below if f.pub_date.year < 2020]
            own = [f for f in below if -99 in groups or f.row_gid in groups]
            r = got.get((user, d))
            if r is None:
                assert user and not own
                continue
            assert (r.granted, r.denied, r.row_only, r.date_only) == (len(below), 0, len(own), len(early))
            assert r.row_date == len({f.path_id for f in own + early}) and r.by_table == (len(below) if {2, -99} & set(groups) else 0)
    for kind, column in (("GRANTED", "granted"), ("ROW_ONLY", "row_only"), ("DATE_ONLY", "date_only"), ("ROW_DATE", "row_date"), ("TABLE", "by_table")):
        for i, user in enumerate(USERS):
            if (user, "") in got:
                assert got[user, ""][column] == VISIBLE[kind][i]


def test_listing_sources(spark):
    """The disk alone without a connection, the table otherwise; what is denied or empty is an empty listing."""
    paths = spark.createDataFrame([(1, 0, "a", True, -1, None), (2, 1, "a/x.fits", False, 3, None), (3, 1, "a/gone.fits", False, 3, None), (4, 0, "b", True, -1, None)], "path_id long, parent_path_id long, path_name string, is_dir boolean, row_gid int, pub_date timestamp")
    disk = spark.createDataFrame([("a", True), ("b", True), ("a/x.fits", False), ("a/new.txt", False), ("a/sub", True)], "path_name string, is_dir boolean")
    roles = spark.createDataFrame([("u", 200, 3), ("w", 200, 4)], "session_id string, mission_id int, group_id int")
    both = "&pgconn=db&pgtable=t"
    cases = [("u", "path=a", {"new.txt", "sub/", "x.fits"}), ("u", f"path=a{both}", {"x.fits"}), ("u", "path=a&policy=ACCESS_DENIED", set()), ("w", f"path=a&policy=ACCESS_ROW_ONLY&mission=200&group=0{both}", set()), ("u", f"path=a/&policy=ACCESS_ROW_ONLY&mission=200&group=0{both}", {"x.fits"}), ("u", "path=", {"a/", "b/"}), ("u", "path=b", set())]
    for user, query, want in cases:
        req = spark.createDataFrame([(1, "HTTP/1.1", query, f"JOSSO_SESSIONID={user}")], "request_id long, protocol string, query_string string, cookie string")
        asked = ac.asked_directories(req, roles, disk)
        assert {r.entry for r in ac.list_directory(asked, paths, disk, "2020-01-01").collect()} == want, query
        (row,) = ac.agg_listing(asked, paths, disk, "2020-01-01").collect()
        assert (row.n, row.first) == (len(want), min(want, default=None))
    req = spark.createDataFrame([(i, "HTTP/1.1", q, "JOSSO_SESSIONID=u") for i, q in enumerate(["path=a", "path=", "path=a/x.fits", "path=a/gone.fits", f"path=a/new.txt{both}", "path=a/new.txt", "path=a&center=1,2", "path=a/x.fits&center=1,2&size=3", "path=a/new.txt&prefix=x"])], "request_id long, protocol string, query_string string, cookie string")
    got = {r.request_id: (r.code, r.product) for r in ac.route_request(req, paths, roles, disk, "2020-01-01").collect()}
    assert [got[i] for i in range(9)] == [(200, "listing"), (200, "listing"), (200, "file"), (404, None), (404, None), (200, "file"), (400, None), (200, "cutout"), (400, None)]


def test_links_and_conditions(spark):
    link = lambda root, prefix, path: tuple(spark.range(1).select(rq.listing_links(F.lit(root), F.lit(prefix), F.lit(path), F.lit("e")).alias("x")).first().x)
    assert link("/data/", "pub/", "R0/N1") == ("/data/pub/R0/N1/", "/data/pub/R0/", "N1/e")
    assert link("/data/", "pub/", "") == ("/data/pub/", "/data/", "e")
    assert link("/", "", "") == ("/", None, "e") and link("/", "", "a") == ("/a/", "/", "a/e")
    rows = spark.createDataFrame([(x, -x) for x in range(-20, 20)], "x int, y int")
    count = lambda text: se.filter_where(rows, text, ["x", "y"]).count()
    assert count("x<10 AND x>-10") == 19 and count("x < -1.5e1 or y<-18 and x<>19") == 5 and count("x != 3") == 39 and count("x=+3.0") == 1
    for bad in ("x<1; drop", "x<y", "z<1", "x<1 and", "(x<1)", "", "x<1 and or x>2", "1=1"):
        with pytest.raises(ValueError):
            se.filter_where(rows, bad, ["x", "y"])


def test_compressed_headers(spark):
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", "8"), ("NAXIS2", "40"), ("PCOUNT", "99"), ("GCOUNT", "1"), ("TFIELDS", "1"), ("TTYPE1", "'COMPRESSED_DATA'"), ("TFORM1", "'1PB(3)'"), ("OBJECT", "'x'"), ("ZIMAGE", "T"), ("ZTENSION", "'IMAGE'"), ("ZBITPIX", "16"), ("ZNAXIS", "2"), ("ZNAXIS1", "50"), ("ZNAXIS2", "40"), ("ZTILE1", "50"), ("ZCMPTYPE", "'GZIP_1'"), ("EXTNAME", "'COMPRESSED_IMAGE'"), ("CRPIX1", "2"), ("HISTORY", "")]
    k = spark.createDataFrame([(1, u, i, n, v if n != "ZIMAGE" or u == 2 else "F") for u in (2, 3) for i, (n, v) in enumerate(cards, 1)], "image_id long, hdu_num int, pos int, name string, value string")
    assert {(r.hdu_num, r.compressed) for r in hd.is_compressed_image(k).collect()} == {(2, True), (3, False)}
    got = [(r.name, r.value) for r in hd.plain_header(k).orderBy("pos").collect()]
    assert got == [("XTENSION", "'IMAGE'"), ("BITPIX", "16"), ("NAXIS", "2"), ("NAXIS1", "50"), ("NAXIS2", "40"), ("OBJECT", "'x'"), ("CRPIX1", "2"), ("HISTORY", "")]
    note = [r.card for r in k.limit(1).select(F.explode(F.array(hd.card_format(F.lit("A"), F.lit("'x'"), F.lit("n")), hd.card_format(F.lit("B"), F.lit("1.5E+00"), F.lit("")), hd.card_format(F.lit("HISTORY"), F.lit(""), F.lit(" free")))).alias("card")).collect()]
    assert [c.rstrip() for c in note] == ["A       = 'x       '           / n", "B       =              1.5E+00", "HISTORY  free"]


def test_headers_grow_without_broadcasts(spark):
    """Keywords and boxes of many images meet by shuffles: nothing that grows with them goes through the driver."""
    for name in ("join_keywords_new", "rewrite_header_compressed", "rewrite_header"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, name


def test_many_files_stay_out_of_the_driver(spark, tmp_path):
    """Files are listed by tasks, in few parts; a task's message has some bytes a file; radius ranges meet by shuffles."""
    root, n = str(tmp_path / "m"), 300
    rows = [Row(path=f"{i % 3}/{i}.fits", hdu_num=1, part=0, content=b"x") for i in sorted(range(n), key=lambda i: i % 3)]
    writer = fs._Writer(root, False)
    sent = writer.write(iter(rows))
    assert len(pickle.dumps(sent)) < 16 * n
    writer.commit([sent, None])
    (tmp_path / "m/0/_hidden.fits").write_bytes(b"")
    (tmp_path / "m/0/a.txt").write_bytes(b"")
    files = fs.list_files(spark, root)
    assert files.rdd.getNumPartitions() == 1 and "binaryFile" not in files._jdf.queryExecution().toString()
    assert {(r.path, r.length) for r in files.collect()} == {(f"file:{root}/{i % 3}/{i}.fits", fs.BLOCK) for i in range(n)}
    with pytest.raises(FileNotFoundError):
        fs.list_files(spark, root + "/none")
    writer = fs._Writer(root, False)
    with pytest.raises(ValueError, match="two tasks wrote .*/1.fits"):
        writer.commit([writer.write(iter(rows[k : k + 1])) for k in (0, 100, 100, 200)])
    units = spark.createDataFrame([], fs.UNITS)
    keywords = fs.keywords(units)
    targets = spark.createDataFrame([], "path string, ra double, dec double, width double")
    ranges = ct.radius_ranges(units, ct.world(keywords), targets)
    for made in (ranges, ct.radius_headers(ranges, keywords)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_packed_tiles(spark, tmp_path):
    """Tiles from the heap by gzip or as they are, by ranges; other ways are rows with an error."""
    image = np.arange(7 * 5, dtype=">i4").reshape(5, 7) * 99999
    parts, first = [], [("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2")]
    for k, (how, w, h, wide) in enumerate([("GZIP_1", 7, 1, False), ("NOCOMPRESS", 3, 2, True), ("RICE_1", 7, 1, False), ("GZIP_1", 4, 5, False)]):
        tiles = [image[b : b + h, a : a + w].tobytes() for b in range(0, 5, h) for a in range(0, 7, w)]
        tiles = [gzip.compress(t) if how == "GZIP_1" else t for t in tiles]
        at = np.cumsum([0, *map(len, tiles)])
        table = np.array([[len(t), a] for t, a in zip(tiles, at, strict=False)], ">i8" if wide else ">i4")
        row = 16 if wide else 8
        cards = [*first, ("NAXIS1", str(row)), ("NAXIS2", str(len(tiles))), ("PCOUNT", str(at[-1])), ("GCOUNT", "1"), ("TFIELDS", "1"), ("TFORM1", "'1QB(9)'" if wide else "'1PB(9)'"), *[("TTYPE2", "'ZSCALE'")] * (k == 3), ("ZIMAGE", "T"), ("ZBITPIX", "32"), ("ZNAXIS", "2"), ("ZNAXIS1", "7"), ("ZNAXIS2", "5"), *([("ZTILE1", str(w)), ("ZTILE2", str(h))] if k else []), ("ZCMPTYPE", f"'{how}'")]
        text = spark.range(1).select(fs.header_text(F.array(*[hd.card_format(F.lit(n), F.lit(v), F.lit("")) for n, v in cards]))).first()[0]
        parts += [(f"{k}.fits", 1, 0, text), (f"{k}.fits", 1, 1, bytearray(table.tobytes() + b"".join(tiles)))]
    fs.write_products(spark.createDataFrame(parts, "path string, hdu_num int, part long, content binary"), str(tmp_path))
    units = fs.plain_units(fs.stored_units(spark, str(tmp_path)))
    assert {(r.ext_type, r.bitpix, tuple(r.naxes)) for r in units.collect()} == {("image", 32, (7, 5))}
    tiles = fs.scan_packed_tiles(units, 2)
    assert {r.path[-6:-5]: r.error for r in tiles.where("status = 'error'").collect()}.keys() == {"2", "3"}
    box = units.select("path", "hdu_num", "tile_w", "tile_h", *[F.lit(x).cast("long").alias(n) for n, x in dict(xmin=2, ymin=1, xmax=6, ymax=4).items()])
    rows = px.cut_rows(box.withColumn("file", F.col("path")), tiles.where("status = 'ok'"), ["file"], None).orderBy("file", "y").collect()
    for k in (0, 1):
        assert b"".join(bytes(r.content) for r in rows if r.file.endswith(f"{k}.fits")) == image[:4, 1:6].tobytes()
