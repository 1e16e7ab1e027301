"""Positional search by zones, and small dimensions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.once import once
from .access import ALL_GROUPS, agg_user_groups

#: Degrees of a zone and of a bin within it.
ZONE = 1.0
# Response codes with summary and description.
STATUS = [
    (200, "OK", "The request has succeeded."),
    (400, "Bad Request", "The request could not be understood by the server due to malformed syntax."),
    (401, "Unauthorized", "The request requires user authentication."),
    (403, "Forbidden", "The server understood the request, but is refusing to fulfill it."),
    (404, "Not Found", "The server has not found anything matching the Request-URI."),
    (406, "Not Acceptable", "The resource identified by the request is only capable of generating response entities which have content characteristics not acceptable according to the accept headers sent in the request."),
    (409, "Conflict", "The request could not be completed due to a conflict with the current state of the resource."),
    (410, "Gone", "The requested resource is no longer available at the server and no forwarding address is known. "),
    (411, "Length Required", "The server refuses to accept the request without a defined Content- Length."),
    (412, "Precondition Failed", "The precondition given in one or more of the request-header fields evaluated to false when it was tested on the server."),
    (413, "Request Entity Too Large", "The server is refusing to process a request because the request entity is larger than the server is willing or able to process."),
    (414, "Request-URI Too Long", "The server is refusing to service the request because the Request-URI is longer than the server is willing to interpret."),
    (415, "Unsupported Media Type", "The server is refusing to service the request because the entity of the request is in a format not supported by the requested resource for the requested method."),
    (500, "Internal Server Error", "The server encountered an unexpected condition which prevented it from fulfilling the request."),
    (501, "Not Implemented", "The server does not support the functionality required to fulfill the request."),
    (502, "Bad Gateway", "The server, while acting as a gateway or proxy, received an invalid response from the upstream server it accessed in attempting to fulfill the request."),
    (503, "Service Unavailable", "The server is currently unable to handle the request due to a temporary overloading or maintenance of the server."),
    (504, "Gateway Timeout", "The server, while acting as a gateway or proxy, did not receive a timely response from the upstream server specified by the URI (e.g. HTTP, FTP, LDAP) or some other auxiliary server (e.g. DNS) it needed to access in attempting to complete the request."),
    (505, "HTTP Version Not Supported", "The server does not support, or refuses to support, the HTTP protocol version that was used in the request message."),
]


def zoned(images: DataFrame, zone: float = ZONE) -> DataFrame:
    """Images once for each zone (declination band and bin of right ascension) that their cap touches."""
    ends = [g.pixel_to_sky(x, y) for x in (F.lit(0.5), F.col("naxis1") + 0.5) for y in (F.lit(0.5), F.col("naxis2") + 0.5)]
    # one place a field, behind generators: what follows repeats none of them
    rows = once(images, _c=g.pixel_to_sky((F.col("naxis1") + 1) / 2, (F.col("naxis2") + 1) / 2), _ends=F.array(*ends))
    rows = once(rows, _v=g.sky_to_vec(F.col("_c.ra"), F.col("_c.dec")), _far=F.transform("_ends", lambda p: g.sky_to_vec(p["ra"], p["dec"])))
    # the farthest corner, however the image is turned
    rows = once(rows, _r=F.degrees(F.array_max(F.transform("_far", lambda v: g.ang_sep(v, F.col("_v"))))) * 1.01)
    dec, ra, r = F.col("_c.dec"), F.col("_c.ra"), F.col("_r")
    polar = F.abs(dec) + r >= 89.9
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(r)) / F.cos(F.radians(dec)), F.lit(1.0)))))
    rows = once(rows, _wide=wide)
    rows = rows.withColumn("zone", F.explode(F.sequence(F.floor((dec - r) / zone).cast("int"), F.floor((dec + r) / zone).cast("int"))))
    bins = int(360 / zone)
    first, last = F.floor((ra - F.col("_wide")) / zone).cast("int"), F.floor((ra + F.col("_wide")) / zone).cast("int")
    rows = rows.withColumn("bin", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + bins - 1)), lambda b: F.pmod(b, F.lit(bins))))))
    return rows.drop("_c", "_ends", "_v", "_far", "_r", "_wide")


def join_positional(points: DataFrame, images: DataFrame, zone: float = ZONE) -> DataFrame:
    """(point_id, image_id) where the image's footprint has the point."""
    ra = g.norm_ra(F.col("ra"))
    p = points.select("point_id", ra.alias("ra"), "dec", F.floor(F.col("dec") / zone).cast("int").alias("zone"), F.floor(ra / zone).cast("int").alias("bin"))
    rows = once(p.join(zoned(images, zone), ["zone", "bin"]), at=g.sky_to_pixel(F.col("ra"), F.col("dec")))
    inside = F.col("at.x").between(0.5, F.col("naxis1") + 0.5) & F.col("at.y").between(0.5, F.col("naxis2") + 0.5)
    return rows.where(inside).select("point_id", "image_id")


TERM = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(<=|>=|<>|!=|<|>|=)\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*")


def where(condition: str, allowed: list[str]) -> Column:
    """Comparisons of allowed columns with numbers, joined by AND, and groups of these joined by OR; nothing else gets through."""

    def term(text: str) -> Column:
        m = TERM.fullmatch(text)
        if not m or m[1] not in allowed:
            raise ValueError(f"not allowed: {text}")
        left, right = F.col(m[1]), F.lit(float(m[3]))
        return {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "=": left == right, "<>": left != right, "!=": left != right}[m[2]]

    either = [reduce(Column.__and__, map(term, re.split(r"(?i)\band\b", group))) for group in re.split(r"(?i)\bor\b", condition)]
    return reduce(Column.__or__, either)


def filter_where(rows: DataFrame, condition: str, allowed: list[str]) -> DataFrame:
    """Rows that meet a user's condition on allowed columns."""
    return rows.where(where(condition, allowed))


def search_catalog(points: DataFrame, images: DataFrame, roles: DataFrame, as_of: str, table_group: int, condition: str, allowed: list[str]) -> DataFrame:
    """For each session and mission with groups and each kind of table, how many hits (a point in an
    image that meets the condition) it may see, and the sum of the hits' codes.

    `images` have row_gid and pub_date. Hits are summed by group and date before sessions meet them.
    """
    hits = join_positional(points, filter_where(images, condition, allowed)).join(images.select("image_id", "row_gid", (F.col("pub_date") < F.lit(as_of).cast("timestamp")).alias("early")), "image_id")
    code = F.col("point_id") * 31 + F.col("image_id")
    sums = hits.groupBy("row_gid", "early").agg(F.count("*").alias("n"), F.sum(code).alias("code"))
    kinds = F.array(*[F.lit(x) for x in ("granted", "denied", "by_table", "row_only", "date_only", "row_date")])
    users = agg_user_groups(roles).withColumn("kind", F.explode(kinds))
    every, groups = F.array_contains("groups", ALL_GROUPS), F.col("groups")
    sees_all = (F.col("kind") == "granted") | ((F.col("kind") == "by_table") & (every | F.array_contains(groups, table_group))) | (F.col("kind").isin("row_only", "row_date") & every)
    by_group = F.col("kind").isin("row_only", "row_date") & ~every
    # what a session needs: everything, all early ones, its groups', or the late ones of its groups
    wants = F.when(sees_all, F.array(F.struct(F.lit("all").alias("part"), F.lit(0).alias("row_gid"))))
    wants = wants.when(F.col("kind") == "date_only", F.array(F.struct(F.lit("early").alias("part"), F.lit(0).alias("row_gid"))))
    own = F.transform(groups, lambda g: F.struct(F.when(F.col("kind") == "row_only", "own").otherwise("late").alias("part"), g.alias("row_gid")))
    wants = wants.when(by_group & (F.col("kind") == "row_date"), F.concat(F.array(F.struct(F.lit("early").alias("part"), F.lit(0).alias("row_gid"))), own)).when(by_group, own)
    wanted = users.select("session_id", "mission_id", "kind", F.inline_outer(F.coalesce(wants, F.array().cast("array<struct<part:string,row_gid:int>>"))))
    parts = F.array(F.struct(F.lit("all").alias("part"), F.lit(0).alias("row_gid")), F.when(F.col("early"), F.struct(F.lit("early").alias("part"), F.lit(0).alias("row_gid"))), F.struct(F.lit("own").alias("part"), F.col("row_gid")), F.when(~F.col("early"), F.struct(F.lit("late").alias("part"), F.col("row_gid"))))
    given = sums.select(F.inline(F.filter(parts, lambda p: p.isNotNull())), "n", "code").groupBy("part", "row_gid").agg(F.sum("n").alias("n"), F.sum("code").alias("code"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return wanted.join(given, ["part", "row_gid"], "left").groupBy("session_id", "mission_id", "kind").agg(zero("n"), zero("code"))


def status_codes(spark) -> DataFrame:
    return spark.createDataFrame(STATUS, "code int, summary string, description string")
