"""The catalog that the registered queries run on, derived from TPC-H-like tables.

The same SQL text serves Spark and the oracle, so both see the same packages and references; files are made
by another plan for the same rows (``GROUPED_FILES``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKAGES = """
    SELECT p_partkey AS pkg_id,
        replace(p_name, ' ', '-') || '-' || CAST(p_partkey % 97 AS STRING) AS attr,
        CASE WHEN p_partkey % 7 = 0 THEN 'dev' WHEN p_partkey % 11 = 0 THEN 'man' ELSE 'out' END AS output,
        p_partkey % 3 <> 0 AS toplevel,
        CAST(NULL AS STRING) AS system,
        '/store' AS store_dir,
        lpad(CAST(p_partkey AS STRING), 32, '0') AS hash,
        replace(p_name, ' ', '-') || '-' || CAST(p_size AS STRING)
            || CASE WHEN p_size = 13 THEN '-fhs' WHEN p_size = 17 THEN '-usr-target' ELSE '' END AS name
    FROM part
"""
FILES = """
    SELECT pkg_id, path, min(kind) AS kind, CAST(max(CASE WHEN kind = 's' THEN 0 ELSE size END) AS BIGINT) AS size,
        CAST(NULL AS STRING) AS target
    FROM (
        SELECT l_partkey AS pkg_id,
            CASE l_linenumber % 7 WHEN 0 THEN '/bin/' WHEN 1 THEN '/usr/bin/' WHEN 2 THEN '/lib/' WHEN 3 THEN '/share/man/man1/'
                WHEN 4 THEN '/sbin/' WHEN 5 THEN '/share/doc/pkg/' ELSE '/bin/nested/' END
                || split_part(p_name, ' ', 2) || CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey % 5 AS STRING) END AS path,
            CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'x' WHEN 2 THEN 's' ELSE 'd' END AS kind,
            CAST(floor(l_extendedprice) AS BIGINT) AS size
        FROM lineitem JOIN part ON l_partkey = p_partkey
    ) AS raw GROUP BY pkg_id, path
    UNION ALL
    SELECT p_partkey, '', 'd', CAST(1 AS BIGINT), CAST(NULL AS STRING) FROM part
"""
#: The rows of ``FILES`` as Spark makes them. Line items are first grouped by numbers, which the hash aggregate
#: holds (a least string would be sorted for); only groups meet the names of parts, which are never broadcast.
GROUPED_FILES = """
    SELECT pkg_id, path, CASE min(code) WHEN 1 THEN 'd' WHEN 2 THEN 'r' WHEN 3 THEN 's' ELSE 'x' END AS kind, max(size) AS size,
        CAST(NULL AS STRING) AS target
    FROM (
        SELECT /*+ SHUFFLE_HASH(named) */ pkg_id,
            CASE dir WHEN 0 THEN '/bin/' WHEN 1 THEN '/usr/bin/' WHEN 2 THEN '/lib/' WHEN 3 THEN '/share/man/man1/'
                WHEN 4 THEN '/sbin/' WHEN 5 THEN '/share/doc/pkg/' ELSE '/bin/nested/' END
                || word || CASE WHEN nth = 0 THEN '' ELSE CAST(nth AS STRING) END AS path, code, size
        FROM (
            SELECT pkg_id, dir, nth, min(code) AS code, max(CASE WHEN code = 3 THEN 0 ELSE size END) AS size
            FROM (
                SELECT l_partkey AS pkg_id, l_linenumber % 7 AS dir, l_suppkey % 5 AS nth,
                    CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 1 END AS code,
                    CAST(floor(l_extendedprice) AS BIGINT) AS size
                FROM lineitem
            ) AS raw GROUP BY pkg_id, dir, nth
        ) AS grouped JOIN (SELECT p_partkey, split_part(p_name, ' ', 2) AS word FROM part) AS named ON pkg_id = p_partkey
    ) AS placed GROUP BY pkg_id, path
    UNION ALL
    SELECT p_partkey, '', 'd', CAST(1 AS BIGINT), CAST(NULL AS STRING) FROM part
"""
META = """
    SELECT p_partkey AS meta_ord,
        replace(p_name, ' ', '-') || '-' || CAST(p_partkey % 97 AS STRING) AS attr,
        replace(p_name, ' ', '-') || '-' || CAST(p_size AS STRING) AS name,
        lower(p_type) || ' item from ' || p_brand AS description,
        CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 2) END AS main_program,
        CASE WHEN p_partkey % 3 = 0 THEN 'MIT' WHEN p_partkey % 3 = 1 THEN 'GPL-3.0' END AS license,
        'https://' || lower(p_brand) || '.example' AS homepage,
        split(lower(p_brand), '#') AS maintainers,
        split('x86 arm', ' ') AS platforms
    FROM part
"""
REFS = """
    SELECT DISTINCT lpad(CAST(l_partkey AS STRING), 32, '0') AS src_hash,
        lpad(CAST((7 * l_partkey + l_suppkey) % (SELECT count(*) FROM part) + 1 AS STRING), 32, '0') AS dst_hash
    FROM lineitem
"""
TABLES = {"packages": PACKAGES, "files": FILES, "package_meta": META, "refs": REFS}
#: Statements that Spark runs in place of a table's, for the same rows.
PLANNED = {"files": GROUPED_FILES}
BASE = ("part", "lineitem", "events", "pages", "documents", "benchmark", "orders", "supplier")


def derive(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The derived tables by name, without touching the session's views."""
    out = []
    for name in names:
        sql = PLANNED.get(name, TABLES[name])
        used = [t for t in BASE if f" {t}" in sql]
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        # Tables go in by name as parameters of the statement.
        for t in used:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
        out.append(spark.sql(sql, **frames))
    return out


def prelude(*names: str) -> str:
    """The WITH clause of the oracle's SQL."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names)
