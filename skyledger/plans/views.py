"""Archive tables derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file tree: regions and nations are directories, orders are files."""
    nation = table(spark, sf_dir, "nation")
    none = [F.lit(-1).alias("row_gid"), F.lit(None).cast("timestamp").alias("pub_date")]
    top = table(spark, sf_dir, "region").select((1 + F.col("r_regionkey")).cast("long").alias("path_id"), F.lit(0).cast("long").alias("parent_path_id"), F.concat(F.lit("R"), "r_regionkey").alias("path_name"), F.lit(True).alias("is_dir"), *none)
    name = F.concat(F.lit("R"), F.col("n_regionkey"), F.lit("/N"), F.col("n_nationkey"))
    middle = nation.select((100 + F.col("n_nationkey")).cast("long"), (1 + F.col("n_regionkey")).cast("long"), name, F.lit(True), *none)
    files = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    files = files.select((1000 + F.col("o_orderkey")).cast("long"), (100 + F.col("n_nationkey")).cast("long"), F.concat(name, F.lit("/"), F.col("o_orderkey"), F.lit(".fits")), F.lit(False), F.col("n_nationkey").cast("int"), F.col("o_orderdate").cast("timestamp"))
    return top.unionAll(middle).unionAll(files)


PATHS_SQL = """paths AS (
SELECT CAST(1 + r_regionkey AS BIGINT) AS path_id, CAST(0 AS BIGINT) AS parent_path_id, 'R' || r_regionkey AS path_name, true AS is_dir, CAST(-1 AS INT) AS row_gid, CAST(NULL AS TIMESTAMP) AS pub_date FROM region
UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 'R' || n_regionkey || '/N' || n_nationkey, true, -1, NULL FROM nation
UNION ALL SELECT 1000 + o_orderkey, 100 + n_nationkey, 'R' || n_regionkey || '/N' || n_nationkey || '/' || o_orderkey || '.fits', false, n_nationkey, CAST(o_orderdate AS TIMESTAMP)
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sessions; user 0 may see everything, every fourth user has no group."""
    events = table(spark, sf_dir, "events")
    own = events.where("user_id % 4 <> 3 AND user_id <> 0").select(F.concat(F.lit("u"), "user_id").alias("session_id"), F.when(F.col("event_id") % 5 == 1, 300).otherwise(200).alias("mission_id"), (F.col("event_id") % 25).cast("int").alias("group_id"))
    return own.unionAll(events.where("user_id = 0").select(F.lit("u0"), F.lit(-99), F.lit(-99))).distinct()


ROLES_SQL = """roles AS (
SELECT DISTINCT 'u' || user_id AS session_id, CASE WHEN event_id % 5 = 1 THEN 300 ELSE 200 END AS mission_id, CAST(event_id % 25 AS INT) AS group_id FROM events WHERE user_id % 4 <> 3 AND user_id <> 0
UNION SELECT DISTINCT 'u0', -99, -99 FROM events WHERE user_id = 0)"""


#: Ways to write seconds of arc and pixels.
SECONDS = ["%22", "arcsec", "asec", "arc-sec", "a-seconds", "arcsecond", "a-sec"]
PIXELS = ["p", "px", "pix", "pixel", "pixels"]


def requests(spark: SparkSession, sf_dir: str, tree: DataFrame | None = None) -> DataFrame:
    """One request for each event, with a query string and a cookie; `tree` are the paths where they are at hand."""
    events, nation = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    files = (paths(spark, sf_dir) if tree is None else tree).where("NOT is_dir").select(F.col("path_id"), F.col("path_name").alias("file"))
    e = F.col("event_id")
    place = F.concat(F.lit("R"), F.col("n_regionkey"), F.lit("/N"), F.col("n_nationkey"))
    path = F.when(e % 4 == 0, F.concat(F.lit("R"), F.col("n_regionkey"))).when(e % 4 == 1, place).otherwise(F.coalesce(F.col("file"), F.concat(place, F.lit("/none.fits"))))
    policy = F.element_at(F.array(*[F.lit(x) for x in ("GRANTED", "DENIED", "TABLE", "DATE_ONLY", "ROW_ONLY", "ROW_DATE")]), ((e % 6) + 1).cast("int"))
    group = F.when(e % 6 == 2, 2).when(e % 6 > 2, 0).otherwise(-1)
    cut = F.when(e % 10 == 3, F.concat(F.concat(F.lit("&center=1.5%2C-2&size=3"), F.element_at(F.array(*[F.lit(x) for x in SECONDS]), (e % 7 + 1).cast("int")), F.lit("&gzip=")), F.when(e % 3 == 0, "on").otherwise("maybe"))).when(e % 10 == 6, F.concat(F.lit("&center=7.25%2C8.5pix&size=4%2C6"), F.element_at(F.array(*[F.lit(x) for x in PIXELS]), (e % 5 + 1).cast("int")))).when(e % 10 == 7, F.lit("&center=1%2C2")).otherwise(F.lit(""))
    table_ = F.when(e % 11 == 4, "").when(e % 13 == 5, "&pgconn=db").otherwise("&pgconn=db&pgtable=files")
    odd = F.when(e % 50 == 9, F.lit("&colour=blue+green")).when(e % 50 == 29, "&prefix=up%2F..%2F").when(e % 50 == 39, "&prefix=pub").when(e % 50 == 49, "&url_root=pub%2F").when(e % 50 == 19, "&prefix=pub%2F&url_root=%2Fdata%2F").otherwise(F.lit(""))
    joined = events.join(nation, e % 25 == F.col("n_nationkey")).join(files, e + 1000 == F.col("path_id"), "left")
    return joined.select(
        e.alias("request_id"),
        F.when(e % 97 == 5, "HTTP/2").otherwise("HTTP/1.1").alias("protocol"),
        F.concat(F.lit("path="), path, F.lit("&policy=ACCESS_"), policy, F.when(group >= 0, F.concat(F.lit("&mission="), F.when(e % 7 == 3, "300").otherwise("200"), F.lit("&group="), group.cast("string"))).otherwise(F.lit("")), table_, cut, odd).alias("query_string"),
        F.concat(F.when(e % 3 == 0, " theme=dark; ").when(e % 3 == 1, "theme=blue=1;").otherwise("  "), F.lit("JOSSO_SESSIONID=u"), F.col("user_id"), F.when(e % 5 == 0, "; lang=").when(e % 5 == 1, ";lang=de").otherwise(""), F.lit("; theme=light;=x; flag")).alias("cookie"),
    )


REQUESTS_SQL = (
    PATHS_SQL
    + """,
placed AS (SELECT e.*, 'R' || n_regionkey AS region_dir, 'R' || n_regionkey || '/N' || n_nationkey AS nation_dir, p.path_name AS file
  FROM events e JOIN nation ON e.event_id % 25 = n_nationkey LEFT JOIN (SELECT * FROM paths WHERE NOT is_dir) p ON p.path_id = e.event_id + 1000),
requests AS (SELECT event_id AS request_id, CASE WHEN event_id % 97 = 5 THEN 'HTTP/2' ELSE 'HTTP/1.1' END AS protocol,
  'path=' || CASE event_id % 4 WHEN 0 THEN region_dir WHEN 1 THEN nation_dir ELSE coalesce(file, nation_dir || '/none.fits') END
  || '&policy=ACCESS_' || CASE event_id % 6 WHEN 0 THEN 'GRANTED' WHEN 1 THEN 'DENIED' WHEN 2 THEN 'TABLE' WHEN 3 THEN 'DATE_ONLY' WHEN 4 THEN 'ROW_ONLY' ELSE 'ROW_DATE' END
  || CASE WHEN event_id % 6 >= 2 THEN '&mission=' || CASE WHEN event_id % 7 = 3 THEN 300 ELSE 200 END || CASE WHEN event_id % 6 = 2 THEN '&group=2' ELSE '&group=0' END ELSE '' END
  || CASE WHEN event_id % 11 = 4 THEN '' WHEN event_id % 13 = 5 THEN '&pgconn=db' ELSE '&pgconn=db&pgtable=files' END
  || CASE event_id % 10 WHEN 3 THEN '&center=1.5%2C-2&size=3' || (['%22', 'arcsec', 'asec', 'arc-sec', 'a-seconds', 'arcsecond', 'a-sec'])[event_id % 7 + 1] || '&gzip=' || CASE WHEN event_id % 3 = 0 THEN 'on' ELSE 'maybe' END WHEN 6 THEN '&center=7.25%2C8.5pix&size=4%2C6' || (['p', 'px', 'pix', 'pixel', 'pixels'])[event_id % 5 + 1] WHEN 7 THEN '&center=1%2C2' ELSE '' END
  || CASE event_id % 50 WHEN 9 THEN '&colour=blue+green' WHEN 29 THEN '&prefix=up%2F..%2F' WHEN 39 THEN '&prefix=pub' WHEN 49 THEN '&url_root=pub%2F' WHEN 19 THEN '&prefix=pub%2F&url_root=%2Fdata%2F' ELSE '' END AS query_string,
  CASE event_id % 3 WHEN 0 THEN ' theme=dark; ' WHEN 1 THEN 'theme=blue=1;' ELSE '  ' END || 'JOSSO_SESSIONID=u' || user_id || CASE event_id % 5 WHEN 0 THEN '; lang=' WHEN 1 THEN ';lang=de' ELSE '' END || '; theme=light;=x; flag' AS cookie FROM placed)"""
)


def disk(spark: SparkSession, sf_dir: str, tree: DataFrame | None = None) -> DataFrame:
    """What is really there: not every file of the table, and in some directories notes that it lacks."""
    own = paths(spark, sf_dir) if tree is None else tree
    known = own.where("is_dir OR (path_id - 1000) % 7 <> 0").select("path_name", "is_dir")
    notes = own.where("is_dir AND path_id % 3 = 1").select(F.explode(F.array(F.struct(F.concat("path_name", F.lit("/notes.txt")).alias("path_name"), F.lit(False).alias("is_dir")), F.struct(F.concat("path_name", F.lit("/old")).alias("path_name"), F.lit(True).alias("is_dir")))).alias("x"))
    return known.unionAll(notes.select("x.*"))


DISK_SQL = """disk AS (SELECT path_name, is_dir FROM paths WHERE is_dir OR (path_id - 1000) % 7 <> 0
UNION ALL SELECT path_name || '/notes.txt', false FROM paths WHERE is_dir AND path_id % 3 = 1 UNION ALL SELECT path_name || '/old', true FROM paths WHERE is_dir AND path_id % 3 = 1)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image with a tangent-plane coordinate system for each part."""
    k, n = F.col("p_partkey"), F.col("p_size") + 8
    return table(spark, sf_dir, "part").select(
        k.alias("image_id"),
        n.cast("long").alias("naxis1"),
        n.cast("long").alias("naxis2"),
        (k * 37 % 3600 / 10.0).alias("crval1"),
        (k * 13 % 1200 / 10.0 - 60).alias("crval2"),
        ((n + 1) / 2.0).alias("crpix1"),
        ((n + 1) / 2.0).alias("crpix2"),
        (-0.01 * F.cos(F.radians(k % 8 * 45.0))).alias("cd11"),
        (0.01 * F.sin(F.radians(k % 8 * 45.0))).alias("cd12"),
        (0.01 * F.sin(F.radians(k % 8 * 45.0))).alias("cd21"),
        (0.01 * F.cos(F.radians(k % 8 * 45.0))).alias("cd22"),
    )


IMAGES_SQL = """images AS (SELECT p_partkey AS image_id, CAST(p_size + 8 AS BIGINT) AS naxis1, CAST(p_size + 8 AS BIGINT) AS naxis2,
CAST(p_partkey * 37 % 3600 / 10.0 AS DOUBLE) AS crval1, CAST(p_partkey * 13 % 1200 / 10.0 - 60 AS DOUBLE) AS crval2, (p_size + 9) / 2.0::DOUBLE AS crpix1, (p_size + 9) / 2.0::DOUBLE AS crpix2,
-0.01::DOUBLE * cos(radians(p_partkey % 8 * 45)) AS cd11, 0.01::DOUBLE * sin(radians(p_partkey % 8 * 45)) AS cd12, 0.01::DOUBLE * sin(radians(p_partkey % 8 * 45)) AS cd21, 0.01::DOUBLE * cos(radians(p_partkey % 8 * 45)) AS cd22 FROM part)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a sky position near the centre and a size in degrees, one for each."""
    k = F.col("image_id")
    return images(spark, sf_dir).withColumns({
        "ra": F.col("crval1") + (k * 7 % 11 - 5) * 0.00731 + 0.0019,
        "dec": F.col("crval2") + (k * 5 % 13 - 6) * 0.00613 - 0.0023,
        "width": (k % 9) * 0.0173 + 0.0111,
        "height": (k % 7) * 0.0193 + 0.0127,
    })


TARGETS_SQL = IMAGES_SQL + """,
targets AS (SELECT *, crval1 + (image_id * 7 % 11 - 5) * 0.00731::DOUBLE + 0.0019::DOUBLE AS ra, crval2 + (image_id * 5 % 13 - 6) * 0.00613::DOUBLE - 0.0023::DOUBLE AS dec,
(image_id % 9) * 0.0173::DOUBLE + 0.0111::DOUBLE AS width, (image_id % 7) * 0.0193::DOUBLE + 0.0127::DOUBLE AS height FROM images)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image of 8 by 8 pixels, one row a pixel."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    return e.select("image_id", (F.col("pos") % 8 + 1).cast("long").alias("x"), (F.floor(F.col("pos") / 8) + 1).cast("long").alias("y"), F.col("v").cast("float").alias("v"))


PIXELS_SQL = """pixels AS (SELECT vec_id AS image_id, CAST((i - 1) % 8 + 1 AS BIGINT) AS x, CAST((i - 1) // 8 + 1 AS BIGINT) AS y, CAST(embedding[i] AS FLOAT) AS v
FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""

def small_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small images with a coordinate system, a sky position and a radius in degrees."""
    k = F.col("vec_id")
    num = lambda x: F.lit(x).cast("double")
    rows = table(spark, sf_dir, "embeddings").select(k.alias("image_id"), F.lit(8).cast("long").alias("naxis1"), F.lit(8).cast("long").alias("naxis2"), (k * 37 % 3600 / 10.0).alias("crval1"), (k * 13 % 1200 / 10.0 - 60).alias("crval2"), num(4.5).alias("crpix1"), num(4.5).alias("crpix2"), num(-0.01).alias("cd11"), num(0).alias("cd12"), num(0).alias("cd21"), num(0.01).alias("cd22"))
    return rows.withColumns({"ra": F.col("crval1") + 0.0037, "dec": F.col("crval2") - 0.0021, "width": F.col("image_id") % 3 * 0.01 + 0.0112})


SMALL_TARGETS_SQL = """targets AS (SELECT *, crval1 + 0.0037::DOUBLE AS ra, crval2 - 0.0021::DOUBLE AS dec, image_id % 3 * 0.01::DOUBLE + 0.0112::DOUBLE AS width FROM (
SELECT vec_id AS image_id, CAST(8 AS BIGINT) AS naxis1, CAST(8 AS BIGINT) AS naxis2, CAST(vec_id * 37 % 3600 / 10.0 AS DOUBLE) AS crval1, CAST(vec_id * 13 % 1200 / 10.0 - 60 AS DOUBLE) AS crval2, 4.5::DOUBLE AS crpix1, 4.5::DOUBLE AS crpix2, -0.01::DOUBLE AS cd11, 0.0::DOUBLE AS cd12, 0.0::DOUBLE AS cd21, 0.01::DOUBLE AS cd22 FROM embeddings))"""


def hdus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the small images' files: the image, and in some a table, an image without axes, or one of three axes."""
    k = F.col("vec_id")
    unit = lambda n, kind, axes, bits: F.struct(F.lit(n).alias("hdu_num"), F.lit(kind).alias("ext_type"), F.array(*map(F.lit, axes)).cast("array<bigint>").alias("naxes"), F.lit(bits).alias("bitpix"))
    units = F.array(unit(1, "image", [8, 8], -32), F.when(k % 3 == 0, unit(2, "bintable", [16, 4], 8)), F.when(k % 5 == 0, unit(3, "image", [], 16)), F.when(k % 50 == 16, unit(4, "image", [8, 8, 2], -64)))
    return table(spark, sf_dir, "embeddings").select(k.alias("image_id"), F.inline(F.filter(units, lambda u: u.isNotNull())))


UNITS_SQL = """units AS (SELECT vec_id AS image_id, 1 AS hdu_num, 'image' AS ext_type, 2 AS axes, -32 AS bitpix FROM embeddings UNION ALL SELECT vec_id, 2, 'bintable', 2, 8 FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id, 3, 'image', 0, 16 FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, 4, 'image', 3, -64 FROM embeddings WHERE vec_id % 50 = 16)"""

#: Keywords of every image header, in order.
KEYWORDS = ["SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "EXTEND", "CRPIX1", "CRPIX2A", "CRVAL1", "CRVAL2", "LTV1", "LTV2", "CHECKSUM", "DATASUM", "OBJECT", "COMMENT", "COMMENT", "COMMENT"]


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header keywords of the images, one row each."""
    values = ["'T'", "'-32'", "'2'", "cast(naxis1 AS string)", "cast(naxis2 AS string)", "'T'", "cast(crpix1 AS string)", "cast(crpix2 AS string)", "cast(crval1 AS string)", "cast(crval2 AS string)", "'0'", "cast(image_id % 5 AS string)", "concat('C', image_id)", "concat('D', image_id)", "concat('part ', image_id)", "'FITS (Flexible Image Transport System) format is defined in'", '"and Astrophysics\', volume 376, page 359"', "'a remark'"]
    stack = ", ".join(f"{i}, '{k}', {v}" for i, (k, v) in enumerate(zip(KEYWORDS, values, strict=True), 1))
    return images(spark, sf_dir).selectExpr("image_id", "1 AS hdu_num", f"stack({len(KEYWORDS)}, {stack}) AS (pos, name, value)")


KEYWORDS_SQL = IMAGES_SQL + """,
keywords AS (SELECT image_id, 1 AS hdu_num, i AS pos, (['SIMPLE','BITPIX','NAXIS','NAXIS1','NAXIS2','EXTEND','CRPIX1','CRPIX2A','CRVAL1','CRVAL2','LTV1','LTV2','CHECKSUM','DATASUM','OBJECT','COMMENT','COMMENT','COMMENT'])[i] AS name,
([ 'T', '-32', '2', CAST(naxis1 AS VARCHAR), CAST(naxis2 AS VARCHAR), 'T', CAST(crpix1 AS VARCHAR), CAST(crpix2 AS VARCHAR), CAST(crval1 AS VARCHAR), CAST(crval2 AS VARCHAR), '0', CAST(image_id % 5 AS VARCHAR), 'C' || image_id, 'D' || image_id, 'part ' || image_id, 'FITS (Flexible Image Transport System) format is defined in', 'and Astrophysics'', volume 376, page 359', 'a remark'])[i] AS value
FROM (SELECT *, CAST(unnest(generate_series(1, 18)) AS INT) AS i FROM images))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel box within each image."""
    k, n = F.col("image_id"), F.col("naxis1")
    return images(spark, sf_dir).select("image_id", "naxis1", "naxis2", (k % 3 + 1).alias("xmin"), (k % 4 + 2).alias("ymin"), F.least(k % 3 + 1 + k % 6, n).alias("xmax"), F.least(k % 4 + 2 + k % 5, n).alias("ymax"))


BOXES_SQL = "boxes AS (SELECT image_id, naxis1, naxis2, image_id % 3 + 1 AS xmin, image_id % 4 + 2 AS ymin, least(image_id % 3 + 1 + image_id % 6, naxis1) AS xmax, least(image_id % 4 + 2 + image_id % 5, naxis1) AS ymax FROM images)"
