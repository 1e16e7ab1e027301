"""Queries on listings, access rules and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import requests as rq
from ..operators import access as ac
from ..scratch import stored
from . import views as v

_DEC = """,
p AS (SELECT request_id, protocol, query_string, cookie, regexp_extract(query_string, '(^|&)path=([^&]*)', 2) AS path,
  coalesce(nullif(regexp_extract(query_string, '(^|&)policy=([^&]*)', 2), ''), 'ACCESS_GRANTED') AS policy,
  CAST(coalesce(nullif(regexp_extract(query_string, '(^|&)mission=([^&]*)', 2), ''), '-1') AS INT) AS mission,
  CAST(coalesce(nullif(regexp_extract(query_string, '(^|&)group=([^&]*)', 2), ''), '-1') AS INT) AS grp,
  regexp_extract(cookie, 'JOSSO_SESSIONID=([^;]*)', 1) AS session_id FROM requests),
su AS (SELECT DISTINCT session_id AS su_id FROM roles WHERE mission_id = -99 AND group_id = -99),
ug AS (SELECT session_id, mission_id, list(DISTINCT group_id) AS own FROM roles WHERE mission_id > 0 GROUP BY 1, 2),
gs AS (SELECT session_id, mission_id, list_sort(list_distinct(list_concat(list_concat(own, [-1]), CASE WHEN su_id IS NULL THEN [] ELSE [-99] END))) AS groups FROM ug LEFT JOIN su ON session_id = su_id),
j AS (SELECT p.*, CASE WHEN mission <= 0 THEN [] WHEN gs.groups IS NOT NULL THEN gs.groups WHEN su_id IS NOT NULL THEN [-99] ELSE [] END AS groups, regexp_matches(query_string, '(^|&)pgconn=') AS has_conn, regexp_matches(query_string, '(^|&)pgtable=') AS has_table
  FROM p LEFT JOIN gs ON p.session_id = gs.session_id AND p.mission = gs.mission_id LEFT JOIN su ON p.session_id = su_id),
d0 AS (SELECT *, CASE WHEN (mission = -1 AND grp <> -1) OR NOT (mission > 0 OR mission = -1) THEN 'ERROR' WHEN policy = 'ACCESS_DENIED' THEN 'DENIED' WHEN policy = 'ACCESS_GRANTED' THEN 'GRANTED'
  WHEN policy = 'ACCESS_TABLE' THEN CASE WHEN grp = 0 THEN 'ERROR' WHEN mission = -1 OR list_contains(groups, -99) OR list_contains(groups, grp) THEN 'GRANTED' ELSE 'DENIED' END
  WHEN policy = 'ACCESS_DATE_ONLY' THEN CASE WHEN grp = 0 THEN 'DATE_ONLY' ELSE 'ERROR' END
  WHEN policy = 'ACCESS_ROW_ONLY' THEN CASE WHEN mission = -1 OR grp <> 0 THEN 'ERROR' WHEN list_contains(groups, -99) THEN 'GRANTED' WHEN len(groups) = 0 THEN 'DENIED' ELSE 'ROW_ONLY' END
  WHEN policy = 'ACCESS_ROW_DATE' THEN CASE WHEN mission = -1 OR grp <> 0 THEN 'ERROR' WHEN list_contains(groups, -99) THEN 'GRANTED' WHEN len(groups) = 0 THEN 'DATE_ONLY' ELSE 'ROW_DATE' END
  ELSE 'ERROR' END AS decision FROM j),
d AS (SELECT *, CASE WHEN decision = 'ERROR' THEN 500 WHEN policy IN ('ACCESS_DATE_ONLY', 'ACCESS_ROW_ONLY', 'ACCESS_ROW_DATE') AND NOT (has_conn AND has_table) THEN 400 ELSE 200 END AS rule_status,
  decision NOT IN ('ERROR', 'DENIED') AND CASE WHEN policy = 'ACCESS_GRANTED' THEN has_conn WHEN policy = 'ACCESS_TABLE' THEN false ELSE has_conn AND has_table END AS reads FROM d0)"""
_OK = f"""(decision = 'GRANTED' OR (decision IN ('DATE_ONLY', 'ROW_DATE') AND (pub_date < TIMESTAMP '{v.AS_OF}' OR is_dir)) OR (decision IN ('ROW_ONLY', 'ROW_DATE') AND (list_contains(groups, row_gid) OR is_dir)))"""
_BASE = f"WITH {v.REQUESTS_SQL}, {v.ROLES_SQL}{_DEC}"
_ENTRIES = f"""{v.DISK_SQL}, e AS (SELECT c.*, coalesce(p.path_name, '') AS directory, regexp_extract(c.path_name, '([^/]*)$', 1) || CASE WHEN c.is_dir THEN '/' ELSE '' END AS entry FROM paths c LEFT JOIN (SELECT * FROM paths WHERE is_dir) p ON c.parent_path_id = p.path_id WHERE p.path_id IS NOT NULL OR c.parent_path_id = 0)"""


def _all(s, d):
    """Requests, paths and roles; the paths, which the requests name, are worked out once."""
    tree = stored(v.paths(s, d), "paths")
    return v.requests(s, d, tree), tree, v.roles(s, d)


def list_directory(s, d):
    r, p, o = _all(s, d)
    disk = v.disk(s, d, p)
    asked = stored(ac.asked_directories(r, o, disk), "asked")
    return ac.agg_listing(asked, p, disk, v.AS_OF).select("session_id", "policy", "mission", "directory", "reads", "decision", "n", "first", "last", "entries_code")


def _groups(s, d):
    return ac.agg_user_groups(v.roles(s, d)).select("session_id", "mission_id", ac.agg_group_string(F.col("groups")).alias("groups"))


def _visible(s, d, kind):
    """Files that each session may see under one rule: those of its groups, and the early ones of others."""
    g = ac.agg_user_groups(v.roles(s, d)).select("session_id", "mission_id", F.explode("groups").alias("row_gid"))
    files = v.paths(s, d).where("NOT is_dir").withColumn("early", ac.filter_date_only(v.AS_OF))
    # files are counted by group before they meet the sessions
    gids = files.groupBy("row_gid").agg(F.count("*").alias("m"), F.count(F.when(F.col("early"), 1)).alias("e"))
    own = g.join(gids, "row_gid", "left").groupBy("session_id", "mission_id").agg(F.sum(F.coalesce("m", F.lit(0))).alias("m"), F.sum(F.coalesce("e", F.lit(0))).alias("e"))
    if kind == "row_only":
        return own.where("m > 0").select("session_id", "mission_id", F.col("m").alias("n"))
    whole = F.broadcast(files.agg(F.count(F.when(F.col("early"), 1)).alias("all_early")))  # one row
    return own.crossJoin(whole).select("session_id", "mission_id", (F.col("m") + F.col("all_early") - F.col("e")).alias("n")).where("n > 0")


def policy_of(s, d):
    return ac.decided(v.requests(s, d), v.roles(s, d)).select("request_id", "policy", "mission", F.col("group").alias("grp"), ac.agg_group_string(F.col("groups")).alias("groups"), "decision", "status", "reads")


def join_request_path(s, d):
    r, p, _ = _all(s, d)
    rows = ac.understood(r).select("request_id", "path")
    key = F.col("path") == F.col("path_name")
    return rows.join(p, key, "left_semi").withColumn("found", F.lit(True)).unionAll(rows.join(p, key, "left_anti").withColumn("found", F.lit(False)))


def agg_path_count(s, d):
    r, p, _ = _all(s, d)
    return ac.understood(r).select("request_id", "path").join(p.select("path_name"), F.col("path") == F.col("path_name"), "left").groupBy("request_id").agg(F.count("path_name").alias("n"))


def route_request(s, d):
    """Status and product of each request."""
    r, p, o = _all(s, d)
    return ac.route_request(r, p, o, v.disk(s, d, p), v.AS_OF)


def url_decode(s, d):
    return v.requests(s, d).select("request_id", rq.url_decode(F.col("query_string")).alias("plain"))


def parse_query(s, d):
    r = v.requests(s, d).select("request_id", F.posexplode(rq.parse_query(F.col("query_string"))).alias("pos", "p"))
    return r.select("request_id", "pos", F.col("p.key").alias("name"), F.col("p.value").alias("value"))


def parse_cookies(s, d):
    return v.requests(s, d).select("request_id", F.explode(rq.parse_cookies(F.col("cookie"))).alias("name", "value"))


def param_access(s, d):
    r = ac.understood(v.requests(s, d))
    p = F.col("params")
    return r.select("request_id", rq.param_get(p, "path").alias("path_value"), rq.param_or_default(p, "gzip", "none").alias("gzip"), rq.param_count(p, "center").alias("n_center"), rq.param_has(p, "size").alias("has_size"), F.array_join(rq.param_keys(p), ",").alias("names"), "session_id")


def agg_param_counts(s, d):
    r = ac.understood(v.requests(s, d)).select(F.explode("params").alias("p"))
    return r.groupBy(F.col("p.key").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("p.value").alias("n_values"))


def validate_request(s, d):
    r = ac.understood(v.requests(s, d))
    return r.select("request_id", F.array_join(ac.unknown_params(F.col("params")), ",").alias("unknown"), F.when(ac.request_valid(), 200).otherwise(400).alias("code"))


def validate_cutout(s, d):
    p = F.col("params")
    n = lambda k: rq.param_count(p, k)
    any_ = n("center") + n("size") + n("gzip") > 0
    return ac.understood(v.requests(s, d)).select("request_id", F.when(~any_, "none").when((n("center") == 1) & (n("size") == 1) & (n("gzip") <= 1), "cutout").otherwise("bad").alias("kind"))


def parse_coords(s, d):
    p = F.col("params")
    r = ac.understood(v.requests(s, d)).where(rq.param_has(p, "center"))
    c, z = rq.parse_coords(rq.param_get(p, "center"), "deg", True), rq.parse_coords(rq.param_get(p, "size"))
    return r.select("request_id", c["c0"].alias("c0"), c["c1"].alias("c1"), c["units"].alias("c_units"), z["c0"].alias("s0"), z["c1"].alias("s1"), z["units"].alias("s_units"))


def path_parts(s, d):
    p = F.col("path_name")
    return v.paths(s, d).select("path_id", rq.file_name(p).alias("file"), rq.parent(p).alias("parent"), rq.extension(p).alias("ext"), rq.stem(p).alias("stem"), rq.content_type(p).alias("type"), rq.product_name(p, F.lit(True)).alias("product"))


def content_types(s, d):
    """The type of a file with each ending that there is."""
    name = F.concat(F.col("path_name"), F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("path_id") % len(ENDINGS) + 1).cast("int")))
    return v.paths(s, d).where("NOT is_dir").select("path_id", rq.content_type(name).alias("type"))


def listing_links(s, d):
    """Page, parent page and reference of every entry."""
    e = ac.join_listing(v.paths(s, d))
    x = rq.listing_links(F.lit("/data/"), F.lit("pub/"), F.col("directory"), F.col("entry"))
    return e.select("path_id", x["page"].alias("page"), x["parent"].alias("parent"), x["href"].alias("href"))


def expected_access(s, d):
    """Files that each session may see below each directory, for every kind of table."""
    return ac.expected_access(v.paths(s, d).where("NOT is_dir"), v.roles(s, d), v.AS_OF, 2)


ENDINGS = ["", ".zip", ".gz", ".tgz", ".gif", ".jpg", ".jpeg", ".png", ".htm", ".html", ".csv", ".txt", ".text", ".tbl", ".md5", ".anc", ".xml", ".pdf", ".TXT"]

QUERIES = {
    "scan_paths": lambda s, d: v.paths(s, d),
    "scan_roles": lambda s, d: v.roles(s, d),
    "scan_requests": lambda s, d: v.requests(s, d),
    "list_directory": list_directory,
    "agg_user_groups": _groups,
    "filter_date_only": lambda s, d: v.paths(s, d).where(ac.filter_date_only(v.AS_OF)).groupBy("parent_path_id").agg(F.count("*").alias("n"), F.max("pub_date").alias("newest")),
    "filter_row_only": lambda s, d: _visible(s, d, "row_only"),
    "filter_row_date": lambda s, d: _visible(s, d, "row_date"),
    "filter_path_eq": lambda s, d: v.paths(s, d).where(F.col("path_name") == "R0").select("path_id", "path_name"),
    "table_policy": policy_of,
    "join_listing": lambda s, d: ac.join_listing(v.paths(s, d)).select("path_id", "directory", "entry"),
    "join_on_disk": lambda s, d: ac.join_on_disk(ac.join_listing(v.paths(s, d)), v.disk(s, d)).groupBy("directory").agg(F.count("*").alias("n"), F.max("entry").alias("last")),
    "join_request_path": join_request_path,
    "agg_path_count": agg_path_count,
    "check_access": lambda s, d: ac.check_access(*_all(s, d), v.AS_OF),
    "route_request": route_request,
    "agg_ancestors": lambda s, d: ac.agg_ancestors(v.paths(s, d).where("NOT is_dir")),
    "agg_next_segment": lambda s, d: ac.agg_next_segment(v.paths(s, d), "R1/"),
    "sort_listing": lambda s, d: ac.join_listing(v.paths(s, d)).select("directory", "entry", "path_id").orderBy("directory", "entry"),
    "sort_params": lambda s, d: ac.understood(v.requests(s, d)).select("request_id", F.posexplode(rq.sort_params(F.col("params"))).alias("pos", "p")).select("request_id", "pos", F.col("p.key").alias("name"), F.col("p.value").alias("value")),
    "cookie_access": lambda s, d: ac.understood(v.requests(s, d)).select("request_id", F.array_join(rq.cookie_names(F.col("cookies")), ",").alias("names"), rq.cookie_get(F.col("cookies"), "theme").alias("theme"), rq.cookie_get(F.col("cookies"), "lang", "en").alias("lang")),
    "content_type": content_types,
    "listing_links": listing_links,
    "expected_access": expected_access,
    "url_decode": url_decode,
    "parse_query": parse_query,
    "parse_cookies": parse_cookies,
    "param_access": param_access,
    "agg_param_counts": agg_param_counts,
    "validate_request": validate_request,
    "validate_cutout_params": validate_cutout,
    "parse_coords": parse_coords,
    "path_parts": path_parts,
}

#: An unknown parameter, a prefix that climbs or does not end in /, a root that does not begin with one.
_BAD = "query_string LIKE '%&colour=%' OR query_string LIKE '%&prefix=up%' OR query_string LIKE '%&prefix=pub' OR query_string LIKE '%&url_root=pub%'"
#: Cookies one by one, the first of a name.
_CK = """, ck AS (SELECT request_id, name, min_by(value, i) AS value FROM (SELECT request_id, i, substr(c, 1, strpos(c, '=') - 1) AS name, substr(c, strpos(c, '=') + 1) AS value FROM (SELECT request_id, i, ltrim(string_split(cookie, ';')[i]) AS c FROM (SELECT request_id, cookie, unnest(generate_series(1, len(string_split(cookie, ';')))) AS i FROM requests)) WHERE strpos(c, '=') > 1) GROUP BY 1, 2)"""
_SPLIT = """, kv AS (SELECT request_id, CAST(i - 1 AS INT) AS pos, ks[i] AS name, CASE WHEN ks[i] = 'path' THEN vs[i] ELSE url_decode(replace(vs[i], '+', ' ')) END AS value FROM
(SELECT request_id, ks, vs, unnest(generate_series(1, len(ks))) AS i FROM (SELECT request_id, regexp_extract_all(query_string, '([^=]*)=([^&]*)(&|$)', 1) AS ks, regexp_extract_all(query_string, '([^=]*)=([^&]*)(&|$)', 2) AS vs FROM requests)))"""
_KV = f"WITH {v.REQUESTS_SQL}{_SPLIT}"
_N = "count(*) FILTER (name = '{}')"

SQL = {
    "scan_paths": f"WITH {v.PATHS_SQL} SELECT * FROM paths",
    "scan_roles": f"WITH {v.ROLES_SQL} SELECT * FROM roles",
    "scan_requests": f"WITH {v.REQUESTS_SQL} SELECT * FROM requests",
    "list_directory": f"""{_BASE}, {_ENTRIES}, a AS (SELECT DISTINCT session_id, path AS directory, policy, mission, reads, decision, groups FROM d WHERE rule_status = 200 AND (path = '' OR path IN (SELECT path_name FROM disk WHERE is_dir))),
t AS (SELECT a.*, entry FROM a JOIN e USING (directory) WHERE reads AND {_OK} AND e.path_name IN (SELECT path_name FROM disk)
  UNION ALL SELECT a.*, regexp_extract(path_name, '([^/]*)$', 1) || CASE WHEN is_dir THEN '/' ELSE '' END FROM a JOIN disk ON regexp_replace(path_name, '/?[^/]*$', '') = directory WHERE NOT reads AND decision = 'GRANTED'),
q AS (SELECT session_id, directory, policy, mission, reads, count(*) AS n, min(entry) AS first, max(entry) AS last, CAST(sum(CAST('0x' || substr(md5(entry), 1, 8) AS BIGINT)) AS BIGINT) AS entries_code FROM t GROUP BY ALL)
SELECT session_id, policy, mission, directory, reads, decision, coalesce(n, 0) AS n, first, last, coalesce(entries_code, 0) AS entries_code FROM a LEFT JOIN q USING (session_id, directory, policy, mission, reads)""",
    "agg_user_groups": f"{_BASE} SELECT session_id, mission_id, array_to_string(groups, ',') AS groups FROM gs",
    "filter_date_only": f"WITH {v.PATHS_SQL} SELECT parent_path_id, count(*) AS n, max(pub_date) AS newest FROM paths WHERE pub_date < TIMESTAMP '{v.AS_OF}' OR is_dir GROUP BY 1",
    "filter_row_only": f"{_BASE} SELECT session_id, mission_id, count(*) AS n FROM gs JOIN paths ON NOT is_dir AND list_contains(groups, row_gid) GROUP BY 1, 2",
    "filter_row_date": f"{_BASE} SELECT session_id, mission_id, count(*) AS n FROM gs JOIN paths ON NOT is_dir AND (list_contains(groups, row_gid) OR pub_date < TIMESTAMP '{v.AS_OF}') GROUP BY 1, 2",
    "filter_path_eq": f"WITH {v.PATHS_SQL} SELECT path_id, path_name FROM paths WHERE path_name = 'R0'",
    "table_policy": f"{_BASE} SELECT request_id, policy, mission, grp, array_to_string(groups, ',') AS groups, decision, rule_status AS status, reads FROM d",
    "join_listing": f"WITH {v.PATHS_SQL}, {_ENTRIES} SELECT path_id, directory, entry FROM e",
    "join_on_disk": f"WITH {v.PATHS_SQL}, {_ENTRIES} SELECT directory, count(*) AS n, max(entry) AS last FROM e WHERE path_name IN (SELECT path_name FROM disk) GROUP BY 1",
    "join_request_path": f"{_BASE} SELECT request_id, path, path IN (SELECT path_name FROM paths) AS found FROM p",
    "agg_path_count": f"{_BASE} SELECT request_id, count(path_name) AS n FROM p LEFT JOIN paths ON path = path_name GROUP BY 1",
    "check_access": f"{_BASE} SELECT request_id, decision, count(path_name) AS n, CASE WHEN any_value(rule_status) <> 200 THEN any_value(rule_status) WHEN decision = 'DENIED' THEN 404 WHEN NOT any_value(reads) OR count(path_name) > 0 THEN 200 ELSE 404 END AS status FROM d LEFT JOIN paths ON path = path_name AND rule_status = 200 AND reads AND {_OK} GROUP BY 1, 2",
    "route_request": f"""{_BASE}, {v.DISK_SQL}, n AS (SELECT request_id, count(path_name) AS n FROM d JOIN paths ON path = path_name WHERE {_OK} GROUP BY 1),
r AS (SELECT d.*, is_dir, n, query_string LIKE '%&center=%' AS c, query_string LIKE '%&size=%' AS z, query_string LIKE '%gzip=maybe%' AS bad FROM d LEFT JOIN disk ON path = path_name LEFT JOIN n USING (request_id)),
x AS (SELECT *, CASE WHEN protocol NOT IN ('HTTP/1.0', 'HTTP/1.1') OR {_BAD} THEN 400 WHEN rule_status <> 200 THEN rule_status WHEN is_dir THEN CASE WHEN c OR z THEN 400 ELSE 200 END WHEN is_dir IS NULL THEN 404 WHEN decision = 'DENIED' OR (reads AND n IS NULL) THEN 404 WHEN c AND z THEN CASE WHEN bad THEN 400 ELSE 200 END WHEN c OR z THEN 400 ELSE 200 END AS code FROM r)
SELECT request_id, code, CASE WHEN code = 200 THEN CASE WHEN is_dir THEN 'listing' WHEN c AND z THEN 'cutout' ELSE 'file' END END AS product FROM x""",
    "agg_ancestors": f"""WITH {v.PATHS_SQL}, n AS (SELECT DISTINCT array_to_string(p[1 : i], '/') AS directory FROM (SELECT string_split(path_name, '/') AS p, unnest(generate_series(0, len(string_split(path_name, '/')) - 1)) AS i FROM paths WHERE NOT is_dir)),
k AS (SELECT directory, row_number() OVER (ORDER BY directory) - 1 AS path_id FROM n) SELECT k.path_id, k.directory, coalesce(u.path_id, -1) AS parent_path_id FROM k LEFT JOIN k u ON k.directory <> '' AND u.directory = regexp_replace(k.directory, '/?[^/]*$', '')""",
    "agg_next_segment": f"WITH {v.PATHS_SQL} SELECT DISTINCT regexp_extract(substr(path_name, 4), '^([^/]*/?)', 1) AS segment FROM paths WHERE starts_with(path_name, 'R1/')",
    "sort_listing": f"WITH {v.PATHS_SQL}, {_ENTRIES} SELECT directory, entry, path_id FROM e ORDER BY 1, 2",
    "sort_params": f"{_KV} SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY name, pos) - 1 AS INT) AS pos, name, value FROM kv",
    "cookie_access": f"WITH {v.REQUESTS_SQL}{_CK} SELECT request_id, string_agg(name, ',' ORDER BY name) AS names, max(value) FILTER (name = 'theme') AS theme, coalesce(max(value) FILTER (name = 'lang'), 'en') AS lang FROM ck GROUP BY 1",
    "content_type": f"""WITH {v.PATHS_SQL}, f AS (SELECT path_id, lower(regexp_extract(path_name || ({ENDINGS!r})[path_id % {len(ENDINGS)} + 1], '([.][^.]*)$', 1)) AS ext FROM paths WHERE NOT is_dir)
SELECT path_id, CASE WHEN ext = '.zip' THEN 'application/zip' WHEN ext IN ('.gz', '.tgz') THEN 'application/gzip' WHEN ext = '.fits' THEN 'application/fits' WHEN ext = '.gif' THEN 'image/gif' WHEN ext IN ('.jpg', '.jpeg') THEN 'image/jpeg' WHEN ext = '.png' THEN 'image/png'
WHEN ext IN ('.htm', '.html') THEN 'text/html; charset=utf-8' WHEN ext = '.csv' THEN 'text/csv; charset=utf-8' WHEN ext IN ('.txt', '.text', '.tbl', '.md5', '.anc') THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS type FROM f""",
    "listing_links": f"""WITH {v.PATHS_SQL}, {_ENTRIES} SELECT path_id, '/data/pub/' || CASE WHEN directory = '' THEN '' ELSE directory || '/' END AS page,
CASE WHEN directory = '' THEN '/data/' WHEN directory NOT LIKE '%/%' THEN '/data/pub/' ELSE '/data/pub/' || split_part(directory, '/', 1) || '/' END AS parent, CASE WHEN directory = '' THEN '' ELSE split_part(directory, '/', -1) || '/' END || entry AS href FROM e""",
    "expected_access": f"""{_BASE}, f AS (SELECT *, pub_date < TIMESTAMP '{v.AS_OF}' AS early, unnest(['', split_part(path_name, '/', 1), split_part(path_name, '/', 1) || '/' || split_part(path_name, '/', 2)]) AS directory FROM paths WHERE NOT is_dir),
w AS (SELECT directory, count(*) AS n_all, count(*) FILTER (early) AS n_early FROM f GROUP BY 1),
m AS (SELECT session_id, mission_id, groups, directory, count(*) AS m, count(*) FILTER (early) AS e FROM gs JOIN f ON list_contains(groups, -99) OR list_contains(groups, row_gid) GROUP BY ALL UNION ALL SELECT '', -1, [], directory, 0, 0 FROM w)
SELECT session_id, CAST(mission_id AS INT) AS mission_id, directory, n_all AS granted, CAST(0 AS BIGINT) AS denied, CASE WHEN list_contains(groups, -99) OR list_contains(groups, 2) THEN n_all ELSE 0 END AS by_table, m AS row_only, n_early AS date_only, m + n_early - e AS row_date FROM m JOIN w USING (directory)""",
    "url_decode": f"WITH {v.REQUESTS_SQL} SELECT request_id, url_decode(replace(query_string, '+', ' ')) AS plain FROM requests",
    "parse_query": f"{_KV} SELECT * FROM kv",
    "parse_cookies": f"WITH {v.REQUESTS_SQL}{_CK} SELECT request_id, name, value FROM ck",
    "param_access": f"{_KV} SELECT request_id, max(value) FILTER (name = 'path') AS path_value, coalesce(max(value) FILTER (name = 'gzip'), 'none') AS gzip, CAST({_N.format('center')} AS INT) AS n_center, {_N.format('size')} > 0 AS has_size, string_agg(DISTINCT name, ',' ORDER BY name) AS names, any_value(regexp_extract(cookie, 'JOSSO_SESSIONID=([^;]*)', 1)) AS session_id FROM kv JOIN requests USING (request_id) GROUP BY request_id",
    "agg_param_counts": f"{_KV} SELECT name, count(*) AS n, count(DISTINCT value) AS n_values FROM kv GROUP BY name",
    "validate_request": f"WITH {v.REQUESTS_SQL} SELECT request_id, CASE WHEN query_string LIKE '%&colour=%' THEN 'colour' ELSE '' END AS unknown, CASE WHEN protocol IN ('HTTP/1.0', 'HTTP/1.1') AND NOT ({_BAD}) THEN 200 ELSE 400 END AS code FROM requests",
    "validate_cutout_params": f"{_KV} SELECT request_id, CASE WHEN {_N.format('center')} + {_N.format('size')} + {_N.format('gzip')} = 0 THEN 'none' WHEN {_N.format('center')} = 1 AND {_N.format('size')} = 1 AND {_N.format('gzip')} <= 1 THEN 'cutout' ELSE 'bad' END AS kind FROM kv GROUP BY request_id",
    "parse_coords": f"""{_KV}, c AS (SELECT request_id, max(value) FILTER (name = 'center') AS c, max(value) FILTER (name = 'size') AS z FROM kv GROUP BY request_id)
SELECT request_id, CAST(regexp_extract(c, '^([0-9.-]+),([0-9.-]+)', 1) AS DOUBLE) AS c0, CAST(regexp_extract(c, '^([0-9.-]+),([0-9.-]+)', 2) AS DOUBLE) AS c1, CASE WHEN c LIKE '%pix' THEN 'pixel' ELSE 'deg' END AS c_units,
CAST(regexp_extract(z, '^([0-9.-]+)', 1) AS DOUBLE) AS s0, CAST(CASE WHEN z LIKE '%,%' THEN regexp_extract(z, ',([0-9.-]+)', 1) ELSE regexp_extract(z, '^([0-9.-]+)', 1) END AS DOUBLE) AS s1, CASE WHEN z LIKE '%,%' THEN 'pixel' WHEN z IS NOT NULL THEN 'arcsec' END AS s_units FROM c WHERE c IS NOT NULL""",
    "path_parts": f"WITH {v.PATHS_SQL}, f AS (SELECT path_id, path_name, regexp_extract(path_name, '([^/]*)$', 1) AS file FROM paths) SELECT path_id, file, regexp_extract(path_name, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(file, '([.][^.]*)$', 1) AS ext, regexp_extract(file, '^([^.]*)', 1) AS stem, CASE WHEN file LIKE '%.fits' THEN 'application/fits' ELSE 'application/octet-stream' END AS type, file || '.gz' AS product FROM f",
}
