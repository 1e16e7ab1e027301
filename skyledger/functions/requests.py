"""Column functions that read requests: query strings, cookies, parameters, numbers and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters that a request may have.
ALLOWED = ["path", "prefix", "url_root", "policy", "mission", "group", "pgconn", "pgtable", "center", "size", "gzip"]
# Spellings of yes and no.
YES = r"(?i)^\s*(1|on?|y(es)?|t(rue)?)\s*$"
NO = r"(?i)^\s*(0|no?|off?|f(alse)?)\s*$"
# Spellings of units.
UNITS = {
    "pixel": "px?|pix(?:els?)?",
    "arcsec": "\"|a(?:rc)?-?sec(?:onds?)?",
    "arcmin": "'|a(?:rc)?-?min(?:utes?)?",
    "deg": "d(?:eg(?:rees?)?)?",
    "rad": "rad(?:ians?)?",
}
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DEFAULT_COOKIE = "JOSSO_SESSIONID"


def url_decode(s: Column) -> Column:
    """`+` to a space and %XX to a byte; a bad % stays."""
    return F.url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25"))


def parse_query(s: Column) -> Column:
    """array<struct<key, value>>: a key runs to the next `=`; the value of `path` is not decoded."""
    pattern = r"([^=]*)=([^&]*)(?:&|$)"
    pairs = F.arrays_zip(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(s, F.lit(pattern), F.lit(2)).alias("v"))
    return F.transform(pairs, lambda p: F.struct(url_decode(p["k"]).alias("key"), F.when(url_decode(p["k"]) == "path", p["v"]).otherwise(url_decode(p["v"])).alias("value")))


def parse_cookies(s: Column) -> Column:
    """map<name, value>: the first of a name wins, nameless ones go."""
    parts = F.filter(F.transform(F.split(s, ";"), lambda x: F.ltrim(x)), lambda x: F.instr(x, "=") > 1)
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.regexp_extract(x, r"^[^=]*=(.*)$", 1).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), 1)["value"]))


def param_values(params: Column, key: str) -> Column:
    return F.transform(F.filter(params, lambda p: p["key"] == key), lambda p: p["value"])


def param_count(params: Column, key: str) -> Column:
    return F.size(F.filter(params, lambda p: p["key"] == key))


def param_has(params: Column, key: str) -> Column:
    return F.exists(params, lambda p: p["key"] == key)


def param_get(params: Column, key: str) -> Column:
    """The only value; null where there is none or more than one."""
    return F.when(param_count(params, key) == 1, F.element_at(param_values(params, key), 1))


def param_or_default(params: Column, key: str, default: str) -> Column:
    """The only value, the default where there is none, null where there are more."""
    n = param_count(params, key)
    return F.when(n == 0, F.lit(default)).when(n == 1, F.element_at(param_values(params, key), 1))


def param_keys(params: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(params, lambda p: p["key"])))


def sort_params(params: Column) -> Column:
    """Parameters in the order of their keys, those of a key as they came."""
    numbered = F.transform(params, lambda p, i: F.struct(p["key"].alias("key"), i.alias("pos"), p["value"].alias("value")))
    return F.transform(F.array_sort(numbered), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))


def cookie_names(cookies: Column) -> Column:
    return F.array_sort(F.map_keys(cookies))


def cookie_get(cookies: Column, name: str, default: str | None = None) -> Column:
    """A cookie's value, or the default where there is none."""
    return F.coalesce(F.try_element_at(cookies, F.lit(name)), F.lit(default))


def session_id(cookies: Column, name: str = DEFAULT_COOKIE) -> Column:
    return F.coalesce(F.try_element_at(cookies, F.lit(name)), F.lit(""))


def parse_bool(s: Column) -> Column:
    """True, false, or null where it is neither."""
    return F.when(s.rlike(YES), True).when(s.rlike(NO), False)


def parse_int(s: Column) -> Column:
    """The leading whole number if it fits 32 bits, else null."""
    n = F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    return F.when(n.between(-(2**31), 2**31 - 1), n.cast("int"))


def parse_unit(s: Column, default: str = "deg") -> Column:
    out = F.when(s == "", F.lit(default))
    for unit, pattern in UNITS.items():
        out = out.when(s.rlike(f"^(?:{pattern})$"), F.lit(unit))
    return out


def parse_coords(s: Column, default: str = "deg", require_pair: bool = False) -> Column:
    """struct<c0, c1, units>, or null: one or two numbers and a unit."""
    pattern = rf"^\s*({NUMBER})\s*(?:,\s*({NUMBER})\s*)?((?:[A-Za-z\"'][A-Za-z-]*)?)\s*$"
    c0, c1 = (F.regexp_extract(s, pattern, k).try_cast("double") for k in (1, 2))
    unit = parse_unit(F.regexp_extract(s, pattern, 3), default)
    second = c1 if require_pair else F.coalesce(c1, c0)
    return F.when(s.rlike(pattern) & c0.isNotNull() & second.isNotNull() & unit.isNotNull(), F.struct(c0.alias("c0"), second.alias("c1"), unit.alias("units")))


def unit_to_deg(value: Column, unit: Column) -> Column:
    return F.when(unit == "arcsec", value / 3600).when(unit == "arcmin", value / 60).when(unit == "deg", value).when(unit == "rad", F.degrees(value))


def unit_to_rad(value: Column, unit: Column) -> Column:
    return F.when(unit == "rad", value).otherwise(F.radians(unit_to_deg(value, unit)))


def path_valid(p: Column) -> Column:
    return ~p.contains("..") & ~p.startswith("/")


def prefix_valid(p: Column) -> Column:
    return (p == "") | (~p.contains("..") & ~p.startswith("/") & p.endswith("/"))


def url_root_valid(p: Column) -> Column:
    return ~p.contains("..") & p.startswith("/")


def file_name(p: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(p, "/$", ""), "/"), -1)


def parent(p: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(p, "/$", ""), "^(.*)/[^/]*$", 1)


def plain_path(p: Column) -> Column:
    """Without a last .gz or .fz."""
    return F.regexp_replace(p, r"(?i)\.(gz|fz)$", "")


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(p), r"(\.[^.]*)$", 1))


def stem(p: Column) -> Column:
    return F.regexp_replace(file_name(p), r"\.[^.]*$", "")


# Content types by extension.
TYPES = {
    ".zip": "application/zip",
    ".gz": "application/gzip",
    ".tgz": "application/gzip",
    ".fits": "application/fits",
    ".gif": "image/gif",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".htm": "text/html; charset=utf-8",
    ".html": "text/html; charset=utf-8",
    ".csv": "text/csv; charset=utf-8",
    ".txt": "text/plain; charset=utf-8",
    ".text": "text/plain; charset=utf-8",
    ".tbl": "text/plain; charset=utf-8",
    ".md5": "text/plain; charset=utf-8",
    ".anc": "text/plain; charset=utf-8",
}


def content_type(p: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(p)), F.lit("application/octet-stream"))


def product_name(p: Column, gzip: Column) -> Column:
    return F.concat(file_name(plain_path(p)), F.when(gzip, ".gz").otherwise(""))


def listing_links(root: Column, prefix: Column, path: Column, entry: Column) -> Column:
    """struct<page, parent, href> of an entry of a listed directory.

    References are relative to the level above the page: the last part of its path and the entry.
    The page of the root has no such part, and its parent is one level higher; there is none above /.
    """
    page = F.concat(root, prefix, path, F.when(path == "", "").otherwise("/"))
    above = F.regexp_extract(page, "^(.*/)[^/]+/$", 1)
    return F.struct(page.alias("page"), F.nullif(above, F.lit("")).alias("parent"), F.concat(F.when(path == "", "").otherwise(F.concat(file_name(path), F.lit("/"))), entry).alias("href"))
