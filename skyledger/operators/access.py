"""Access rules: groups of sessions, table policies, permitted paths and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import requests as rq
from ..functions.once import once
from .numbering import numbered

ALL_GROUPS, PUBLIC_GROUP, ROW_LEVEL, NO_MISSION, ALL_MISSIONS = -99, -1, 0, -1, -99


def _super_users(roles: DataFrame) -> DataFrame:
    return roles.where((F.col("mission_id") == ALL_MISSIONS) & (F.col("group_id") == ALL_GROUPS)).select("session_id", F.lit(True).alias("all")).distinct()


def _groups(own: Column, everything: Column) -> Column:
    """-1 joins any group of the mission, -99 marks super-users."""
    none = F.array().cast("array<int>")
    parts = [F.coalesce(own, none), F.when(F.size(own) > 0, F.array(F.lit(PUBLIC_GROUP))).otherwise(none), F.when(everything, F.array(F.lit(ALL_GROUPS))).otherwise(none)]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _own_groups(roles: DataFrame) -> DataFrame:
    return roles.where("mission_id > 0").groupBy("session_id", "mission_id").agg(F.collect_set("group_id").alias("own"))


def agg_user_groups(roles: DataFrame) -> DataFrame:
    """Groups of each session for each of its missions."""
    rows = _own_groups(roles).join(_super_users(roles), "session_id", "left")
    return rows.select("session_id", "mission_id", _groups(F.col("own"), F.col("all")).alias("groups"))


def agg_group_string(groups: Column) -> Column:
    return F.array_join(F.array_sort(groups).cast("array<string>"), ",")


def table_policy(policy: Column, mission: Column, group: Column, groups: Column, connections: Column, tables: Column) -> Column:
    """struct<decision, status, reads>: the rule in force, status 500 for a bad configuration or 400
    where the connection or the table must be given once and is not, and whether the table of files
    is read. `connections` and `tables` are the given values."""
    bad = ((mission == NO_MISSION) & (group != PUBLIC_GROUP)) | ~((mission > 0) | (mission == NO_MISSION))
    table = F.when(group == ROW_LEVEL, "ERROR").when(mission == NO_MISSION, "GRANTED").when(F.array_contains(groups, ALL_GROUPS) | F.array_contains(groups, group), "GRANTED").otherwise("DENIED")
    rows_bad = (mission == NO_MISSION) | (group != ROW_LEVEL)
    row_only = F.when(rows_bad, "ERROR").when(F.array_contains(groups, ALL_GROUPS), "GRANTED").when(F.size(groups) == 0, "DENIED").otherwise("ROW_ONLY")
    row_date = F.when(rows_bad, "ERROR").when(F.array_contains(groups, ALL_GROUPS), "GRANTED").when(F.size(groups) == 0, "DATE_ONLY").otherwise("ROW_DATE")
    decision = (
        F.when(bad, "ERROR")
        .when(policy == "ACCESS_DENIED", "DENIED")
        .when(policy == "ACCESS_GRANTED", "GRANTED")
        .when(policy == "ACCESS_TABLE", table)
        .when(policy == "ACCESS_DATE_ONLY", F.when(group == ROW_LEVEL, "DATE_ONLY").otherwise("ERROR"))
        .when(policy == "ACCESS_ROW_ONLY", row_only)
        .when(policy == "ACCESS_ROW_DATE", row_date)
        .otherwise("ERROR")
    )
    by_row = policy.isin("ACCESS_DATE_ONLY", "ACCESS_ROW_ONLY", "ACCESS_ROW_DATE")
    lacking = F.when(by_row, (F.size(connections) != 1) | (F.size(tables) != 1)).when(policy == "ACCESS_GRANTED", (F.size(connections) > 1) | (F.size(tables) > 1)).otherwise(False)
    status = F.when(policy.isNull() | mission.isNull() | group.isNull(), 400).when(decision == "ERROR", 500).when(lacking, 400).otherwise(200)
    reads = (status == 200) & (decision != "DENIED") & (by_row | ((policy == "ACCESS_GRANTED") & (F.coalesce(F.get(connections, 0), F.lit("")) != "")))
    return F.struct(decision.alias("decision"), status.alias("status"), reads.alias("reads"))


def filter_date_only(as_of: str) -> Column:
    return F.coalesce(F.col("pub_date") < F.lit(as_of).cast("timestamp"), F.lit(False)) | F.col("is_dir")


def filter_row_only(groups: Column) -> Column:
    return F.coalesce(F.array_contains(groups, F.col("row_gid")), F.lit(False)) | F.col("is_dir")


def filter_row_date(groups: Column, as_of: str) -> Column:
    return filter_row_only(groups) | filter_date_only(as_of)


def permitted(decision: Column, groups: Column, as_of: str) -> Column:
    """Whether a row of paths may be seen under a decision."""
    return F.when(decision == "GRANTED", True).when(decision == "DATE_ONLY", filter_date_only(as_of)).when(decision == "ROW_ONLY", filter_row_only(groups)).when(decision == "ROW_DATE", filter_row_date(groups, as_of)).otherwise(False)


def understood(requests: DataFrame) -> DataFrame:
    """Requests with their parameters, session, path, policy, mission and group."""
    rows = once(requests, params=rq.parse_query(F.col("query_string")), cookies=rq.parse_cookies(F.col("cookie")))
    value = lambda k, d: rq.param_or_default(F.col("params"), k, d)
    return once(
        rows,
        session_id=rq.session_id(F.col("cookies")),
        path=F.regexp_replace(value("path", ""), "/$", ""),
        policy=value("policy", "ACCESS_GRANTED"),
        mission=rq.parse_int(value("mission", "-1")),
        group=rq.parse_int(value("group", "-1")),
    )


def join_request_roles(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests with the groups of their sessions for their missions; none for anonymous ones or without a mission."""
    own = _own_groups(roles).withColumnRenamed("mission_id", "mission")
    rows = rows.join(own, ["session_id", "mission"], "left").join(_super_users(roles), "session_id", "left")
    groups = F.when(F.col("mission") > 0, _groups(F.col("own"), F.col("all"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("groups", groups).drop("own", "all")


def decided(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests with their groups, the rule in force, its status, and whether the table of files is read."""
    rows = join_request_roles(understood(requests), roles)
    given = [rq.param_values(F.col("params"), k) for k in ("pgconn", "pgtable")]
    rows = once(rows, rule=table_policy(F.col("policy"), F.col("mission"), F.col("group"), F.col("groups"), *given))
    return rows.select("*", "rule.*").drop("rule")


def path_rules(paths: DataFrame, as_of: str) -> DataFrame:
    """One row a path: what kinds of rows it has, and how many of each kind."""
    kinds = paths.groupBy("path_name", "is_dir", "row_gid", filter_date_only(as_of).alias("early")).agg(F.count("*").alias("n"))
    return kinds.groupBy(F.col("path_name").alias("path")).agg(F.collect_list(F.struct("is_dir", "row_gid", "early", "n")).alias("kinds"))


def permitted_rows(decision: Column, groups: Column) -> Column:
    """How many rows of `kinds` may be seen under a decision."""

    def seen(k: Column) -> Column:
        by_row = F.coalesce(F.array_contains(groups, k["row_gid"]), F.lit(False)) | k["is_dir"]
        return F.when(decision == "GRANTED", True).when(decision == "DATE_ONLY", k["early"]).when(decision == "ROW_ONLY", by_row).when(decision == "ROW_DATE", by_row | k["early"]).otherwise(False)

    return F.coalesce(F.aggregate("kinds", F.lit(0).cast("long"), lambda a, k: a + F.when(seen(k), k["n"]).otherwise(0)), F.lit(0).cast("long"))


def _checked(rows: DataFrame) -> Column:
    """Status of a decided request that has `n`: its rule's error, or whether its path may be had."""
    return F.when(F.col("status") != 200, F.col("status")).when(F.col("decision") == "DENIED", 404).when(~F.col("reads") | (F.col("n") > 0), 200).otherwise(404)


def with_permitted(rows: DataFrame, paths: DataFrame, as_of: str) -> DataFrame:
    """Decided requests with `n`, the number of permitted rows of their path; 0 where the table is not read."""
    rows = rows.join(path_rules(paths, as_of), "path", "left")
    return rows.withColumn("n", F.when(F.col("reads"), permitted_rows(F.col("decision"), F.col("groups"))).otherwise(0)).drop("kinds")


def check_access(requests: DataFrame, paths: DataFrame, roles: DataFrame, as_of: str) -> DataFrame:
    """Per request the number of permitted rows of its path, and 200, 400, 404 or 500. Where the table is not read there is nothing to find."""
    rows = with_permitted(decided(requests, roles), paths, as_of)
    return rows.select("request_id", "decision", "n", _checked(rows).alias("status"))


def route_request(requests: DataFrame, paths: DataFrame, roles: DataFrame, disk: DataFrame, as_of: str) -> DataFrame:
    """Status and product of each request, the first error wins: a directory or a file on the disk, then access, then what is asked of it."""
    there = disk.select(F.col("path_name").alias("path"), "is_dir").unionAll(disk.sparkSession.sql("SELECT '' AS path, true AS is_dir"))
    there = there.groupBy("path").agg(F.max("is_dir").alias("is_dir"))
    rows = with_permitted(decided(requests, roles), paths, as_of).join(there, "path", "left")
    params = F.col("params")
    n = lambda k: rq.param_count(params, k)
    cut = (n("center") > 0) | (n("size") > 0) | (n("gzip") > 0)
    fits = rq.extension(rq.plain_path(F.col("path"))).isin(".fit", ".fits") & (n("center") == 1) & (n("size") == 1)
    bad_cut = rq.parse_bool(rq.param_or_default(params, "gzip", "0")).isNull() | rq.parse_coords(rq.param_get(params, "center"), "deg", True).isNull() | rq.parse_coords(rq.param_get(params, "size")).isNull()
    status = (
        F.when(~request_valid(), 400)
        .when(F.col("status") != 200, F.col("status"))
        .when(F.col("is_dir"), F.when(cut, 400).otherwise(200))
        .when(F.col("is_dir").isNull(), 404)
        .when(_checked(rows) != 200, _checked(rows))
        .when(fits, F.when(bad_cut, 400).otherwise(200))
        .when(cut, 400)
        .otherwise(200)
    )
    product = F.when(F.col("is_dir"), "listing").when(fits, "cutout").otherwise("file")
    return rows.select("request_id", status.alias("code"), F.when(status == 200, product).alias("product"))


def unknown_params(params: Column) -> Column:
    return F.array_except(rq.param_keys(params), F.array(*[F.lit(x) for x in rq.ALLOWED]))


def request_valid() -> Column:
    """Known protocol and parameters; path, prefix and root are given once at most and well formed."""
    p = F.col("params")
    places = rq.path_valid(rq.param_or_default(p, "path", "")) & rq.prefix_valid(rq.param_or_default(p, "prefix", "")) & rq.url_root_valid(rq.param_or_default(p, "url_root", "/"))
    return F.col("protocol").isin("HTTP/1.0", "HTTP/1.1") & (F.size(unknown_params(p)) == 0) & F.coalesce(places, F.lit(False))


def join_listing(paths: DataFrame) -> DataFrame:
    """Every entry with the name of its directory, '' for the root (parent 0); names end in / for directories. Entries of an unknown parent are in none."""
    up = paths.where("is_dir").select(F.col("path_id").alias("parent_path_id"), F.col("path_name").alias("directory"))
    rows = paths.where("parent_path_id <> 0").join(up, "parent_path_id").unionByName(paths.where("parent_path_id = 0").withColumn("directory", F.lit("")))
    return rows.withColumn("entry", F.concat(rq.file_name(F.col("path_name")), F.when(F.col("is_dir"), "/").otherwise("")))


def join_on_disk(rows: DataFrame, disk: DataFrame) -> DataFrame:
    return rows.join(disk.select("path_name"), "path_name", "left_semi")


def asked_directories(requests: DataFrame, roles: DataFrame, disk: DataFrame) -> DataFrame:
    """Distinct (session, policy, mission, directory, reads) of requests for directories of the disk, with the decision, and the groups where these matter, as text."""
    own = F.when(F.col("decision").startswith("ROW"), agg_group_string(F.col("groups"))).otherwise("")
    rows = decided(requests, roles).where("status = 200").select("session_id", "policy", "mission", F.col("path").alias("directory"), "reads", "decision", own.alias("group_key")).distinct()
    directories = disk.where("is_dir").select(F.col("path_name").alias("directory")).unionAll(disk.sparkSession.sql("SELECT '' AS directory"))
    return rows.join(directories, "directory", "left_semi")


def _on_disk(disk: DataFrame) -> DataFrame:
    """Entries of the disk's directories, whatever the table says."""
    name = F.concat(rq.file_name(F.col("path_name")), F.when(F.col("is_dir"), "/").otherwise(""))
    return disk.select(rq.parent(F.col("path_name")).alias("directory"), name.alias("entry"), "is_dir")


def _kinds(asked: DataFrame) -> DataFrame:
    """What is asked, once for all sessions that see the same: (directory, reads, decision, group_key) with the groups."""
    kinds = asked.where("decision <> 'DENIED'").select("directory", "reads", "decision", "group_key").distinct()
    return kinds.withColumn("groups", F.when(F.col("group_key") == "", F.array().cast("array<int>")).otherwise(F.split("group_key", ",").cast("array<int>")))


def list_directory(asked: DataFrame, paths: DataFrame, disk: DataFrame, as_of: str) -> DataFrame:
    """Entries of the asked directories: of the disk alone where a granted request reads no table, else
    those of the table that are permitted and on the disk. The result has (directory, reads, decision,
    group_key, entry)."""
    kinds = _kinds(asked)
    known = join_on_disk(join_listing(paths), disk)
    rows = kinds.where("reads").join(known, "directory").where(permitted(F.col("decision"), F.col("groups"), as_of))
    bare = kinds.where("NOT reads AND decision = 'GRANTED'").join(_on_disk(disk), "directory")
    columns = ["directory", "reads", "decision", "group_key", "entry"]
    return rows.select(columns).unionByName(bare.select(columns))


def agg_listing(asked: DataFrame, paths: DataFrame, disk: DataFrame, as_of: str) -> DataFrame:
    """For each asked (directory, reads, decision, group_key) the number of entries, the first and the last, and a hash that does not depend on their order.

    What is denied or empty has a row of none. Entries are summed up by what the rules look at
    before the sets of groups meet them, so that a large directory is a few rows there.
    """
    code = F.conv(F.substring(F.md5(F.col("entry")), 1, 8), 16, 10).cast("long")
    sums = [F.count("*").alias("n"), F.min("entry").alias("first"), F.max("entry").alias("last"), F.sum(code).alias("code")]
    known = join_on_disk(join_listing(paths), disk).withColumn("early", filter_date_only(as_of)).groupBy("directory", "row_gid", "is_dir", "early").agg(*sums).withColumn("reads", F.lit(True))
    bare = _on_disk(disk).groupBy("directory").agg(*sums).select("directory", F.lit(-1).alias("row_gid"), F.lit(True).alias("is_dir"), F.lit(True).alias("early"), "n", "first", "last", "code", F.lit(False).alias("reads"))
    by_row = filter_row_only(F.col("groups"))
    seen = F.when(F.col("decision") == "GRANTED", True).when(F.col("decision") == "DATE_ONLY", F.col("early")).when(F.col("decision") == "ROW_ONLY", by_row).when(F.col("decision") == "ROW_DATE", by_row | F.col("early")).otherwise(False)
    key = ["directory", "reads", "decision", "group_key"]
    found = _kinds(asked).join(known.unionByName(bare), ["directory", "reads"]).where(seen).groupBy(key)
    found = found.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("code").alias("entries_code"))
    return asked.join(found, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "entries_code": F.coalesce("entries_code", F.lit(0))})


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root, which is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def agg_ancestors(files: DataFrame) -> DataFrame:
    """All directories above the files with ids in the order of their names, from 0 for the root, and their parents' ids; the root's is -1."""
    names = files.select(F.explode(ancestors(F.col("path_name"))).alias("directory")).distinct()
    numbers = numbered(names, F.col("directory"), name="path_id")
    up = numbers.select(F.col("directory").alias("above"), F.col("path_id").alias("parent_path_id"))
    rows = numbers.withColumn("above", F.when(F.col("directory") != "", rq.parent(F.col("directory"))))
    return rows.join(up, "above", "left").select("path_id", "directory", F.coalesce("parent_path_id", F.lit(-1)).alias("parent_path_id"))


def expected_access(files: DataFrame, roles: DataFrame, as_of: str, table_group: int) -> DataFrame:
    """By definition, for each session and mission with groups, and for anonymous users, and for each
    directory below which its groups show something: how many files each kind of table shows there.

    Files are counted by group for every directory above them before the groups meet them; the
    group of super-users stands for all.
    """
    early = filter_date_only(as_of)
    counts = files.select(F.explode(ancestors(F.col("path_name"))).alias("directory"), "row_gid", early.alias("early"))
    counts = counts.groupBy("directory", "row_gid").agg(F.count("*").alias("m"), F.count(F.when(F.col("early"), 1)).alias("e"))
    whole = counts.groupBy("directory").agg(F.sum("m").alias("n_all"), F.sum("e").alias("n_early"))
    every = whole.select("directory", F.lit(ALL_GROUPS).alias("row_gid"), F.col("n_all").alias("m"), F.col("n_early").alias("e"))
    users = agg_user_groups(roles)
    own = users.select("session_id", "mission_id", "groups", F.explode(F.when(F.array_contains("groups", ALL_GROUPS), F.array(F.lit(ALL_GROUPS))).otherwise(F.col("groups"))).alias("row_gid"))
    own = own.join(counts.unionByName(every), "row_gid").groupBy("session_id", "mission_id", "groups", "directory").agg(F.sum("m").alias("m"), F.sum("e").alias("e"))
    nobody = whole.select(F.lit("").alias("session_id"), F.lit(-1).alias("mission_id"), F.array().cast("array<int>").alias("groups"), "directory", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("e"))
    rows = own.unionByName(nobody).join(whole, "directory")
    by_table = F.array_contains("groups", ALL_GROUPS) | F.array_contains("groups", table_group)
    return rows.select(
        "session_id",
        "mission_id",
        "directory",
        F.col("n_all").alias("granted"),
        F.lit(0).cast("long").alias("denied"),
        F.when(by_table, F.col("n_all")).otherwise(0).alias("by_table"),
        F.col("m").alias("row_only"),
        F.col("n_early").alias("date_only"),
        (F.col("m") + F.col("n_early") - F.col("e")).alias("row_date"),
    )


def agg_next_segment(paths: DataFrame, prefix: str) -> DataFrame:
    """What follows a prefix: the first segment, with / where more comes."""
    rest = F.substring("path_name", len(prefix) + 1, 1 << 20)
    return paths.where(F.col("path_name").startswith(prefix)).select(F.regexp_extract(rest, "^([^/]*/?)", 1).alias("segment")).distinct()
