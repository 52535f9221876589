"""The registered queries over the derived catalog, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BuildOptions, Catalog
from .derived import derive, prelude
from .functions import text as fn
from .operators import closure, commands, incremental, locate, metasearch, textindex
from .plans.query import Access, Field, FileSort, LocateQuery, MetaQuery, MetaSort, access_of
from .plans.regex import literals
from .sources import archive, evaluation, listings
from .storage import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, run, sql: str | None = None, tables: tuple[str, ...] = ()) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"{prelude(*tables)} {sql}" if tables else sql


HIT = "p.pkg_id, p.attr, p.output, p.attr || '.' || p.output AS label, p.toplevel, p.hash, p.name, '/store/' || p.hash || '-' || p.name AS store_path, f.path, f.kind, f.size, f.target"
FROM = "FROM files f JOIN packages p USING (pkg_id)"
COLUMNS = ("pkg_id", "path", "label", "kind", "size", "store_path")
SHORT = "p.pkg_id, f.path, p.attr || '.' || p.output AS label, f.kind, f.size, '/store/' || p.hash || '-' || p.name AS store_path"


_built: dict[tuple[str, str], Catalog] = {}
_recorded: dict[tuple[str, str], Catalog] = {}


def built(spark: SparkSession, sf_dir: str, *indexes: str) -> Catalog:
    """The catalog derived from the tables below ``sf_dir``, on disk; built once in a session, each index
    when it is first asked for."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        packages, files, meta = derive(spark, sf_dir, "packages", "files", "package_meta")
        path = f"{shared_folder(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
        _built[key] = Catalog.build(spark, path, packages, files, meta, BuildOptions(indexes=()))
    missing = tuple(n for n in indexes if not _built[key].has(n))
    if missing:
        _built[key].build_indexes(missing)
    return _built[key]


def recorded(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog where it is built, or else one of packages and metadata only: each derived package has an
    entry, its root, so both have the same ones. Nothing is computed of files that no query reads."""
    key = spark.sparkContext.applicationId, sf_dir
    if key in _built:
        return _built[key]
    if key not in _recorded:
        packages, meta = derive(spark, sf_dir, "packages", "package_meta")
        path = f"{shared_folder(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
        _recorded[key] = Catalog.build(spark, path, packages, _no_files(spark), meta, BuildOptions(eval_only=True))
    return _recorded[key]


def _no_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pkg_id long, path string, kind string, size long, target string")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables of the built catalog; references are derived."""
    c = built(spark, sf_dir) if "files" in names else recorded(spark, sf_dir)
    return [derive(spark, sf_dir, n)[0] if n == "refs" else c.table(n).drop("basename") if n == "files" else c.table(n) for n in names]


NEEDS = {Access.PATH: ("path_entries",), Access.TRIGRAMS: ("path_trigrams",), Access.PATHS: ("path_dict",)}


def _locate(name: str, q: LocateQuery, where: str, tail: str = "", access: Access | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return built(spark, sf_dir, *NEEDS.get(access or access_of(q), ())).locate(q, access).select(*COLUMNS)

    register(name, run, f"SELECT {SHORT} {FROM} WHERE {where} {tail}", ("packages", "files"))


NO_SLASH = "NOT contains(split_part(f.path, '{0}', -1), '/')"
Q = LocateQuery
_locate("locate_literal", Q("bin/ring"), f"contains(f.path, 'bin/ring') AND p.toplevel AND {NO_SLASH.format('bin/ring')}")
_locate("locate_regex", Q("bin/r(ing|od)[0-9]?", regex=True, group=False), "regexp_matches(f.path, 'bin/r(ing|od)[0-9]?') AND p.toplevel")
_locate("locate_regex_prefix_suffix", Q("/share/.*bolt3$", regex=True, all=True, group=False), "regexp_matches(f.path, '/share/.*bolt3$')")
_locate("locate_at_root_prefix", Q("bin/", at_root=True, all=True, group=False), "starts_with(f.path, '/bin/')")
_locate("locate_exact_path", Q("/usr/bin/gear2", at_root=True, whole_name=True, all=True), "f.path = '/usr/bin/gear2'")
_locate("locate_whole_name", Q("ring", whole_name=True), "ends_with(f.path, 'ring') AND p.toplevel")
_locate("locate_package_filter", Q("lib/", package="widget-1", all=True, group=False), "contains(f.path, 'lib/') AND contains(p.name, 'widget-1')")
_locate("locate_package_regex", Q("s?bin/", regex=True, package="^(red|blue)-.*[0-9]$", all=True, group=False), "regexp_matches(f.path, 's?bin/') AND regexp_matches(p.name, '^(red|blue)-.*[0-9]$')")
_locate("locate_hash", Q("bin", hash="0" * 29 + "042", all=True, group=False), f"contains(f.path, 'bin') AND p.hash = '{'0' * 29}042'")
_locate("locate_types", Q("man1/", types=("x", "s"), all=True), "contains(f.path, 'man1/') AND f.kind IN ('x', 's') AND NOT contains(split_part(f.path, 'man1/', -1), '/')")
_locate("locate_size_range", Q("lib/", min_size=20000, max_size=40000, all=True), "contains(f.path, 'lib/') AND f.size BETWEEN 20000 AND 40000")
_locate("locate_toplevel", Q("/sbin/"), "contains(f.path, '/sbin/') AND p.toplevel")
_locate("locate_exclude_fhs", Q("doc/", exclude_fhs=True, all=True, group=False), "contains(f.path, 'doc/') AND NOT contains(p.name, '-fhs') AND NOT contains(p.name, '-usr-target')")
_locate("locate_grouped", Q("bin/", all=True), f"contains(f.path, 'bin/') AND {NO_SLASH.format('bin/')}")
_locate("locate_grouped_regex", Q("bin/(nested)?", regex=True, all=True), "regexp_matches(f.path, 'bin/(nested)?') AND NOT contains(list_extract(regexp_split_to_array(f.path, 'bin/(nested)?'), -1), '/')")
_locate("locate_sort_size_limit", Q("bin/", all=True, sort=FileSort.SIZE_DESC, limit=100), f"contains(f.path, 'bin/') AND {NO_SLASH.format('bin/')}", "ORDER BY f.size DESC, p.pkg_id, f.path LIMIT 100")
_locate("locate_sort_attr_limit", Q("lib", sort=FileSort.ATTR_ASC, limit=50, group=False), "contains(f.path, 'lib') AND p.toplevel", "ORDER BY p.attr, p.pkg_id, f.path LIMIT 50")


_locate("locate_scan", Q("lib/gear3", all=True, group=False), "contains(f.path, 'lib/gear3')", access=Access.SCAN)
_locate("locate_via_trigram", Q("lib/gear3", all=True, group=False), "contains(f.path, 'lib/gear3')", access=Access.TRIGRAMS)
_locate("locate_via_basename", Q("nested/rod4", whole_name=True, all=True), "ends_with(f.path, 'nested/rod4')", access=Access.BASENAME)
_locate("locate_via_path_prefix", Q("share/man/", at_root=True, all=True, group=False), "starts_with(f.path, '/share/man/')", access=Access.PATH)
_locate("locate_via_paths", Q("g2", all=True, group=False), "contains(f.path, 'g2')", access=Access.PATHS)
_locate("locate_exact_basename", Q("", basename="bolt1", all=True, group=False), "regexp_extract(f.path, '[^/]*$') = 'bolt1'")
_locate("locate_labels", Q("bin/", labels=("blue-ring-41.out", "hot-gear-39.out"), all=True, group=False), "contains(f.path, 'bin/') AND p.attr || '.' || p.output IN ('blue-ring-41.out', 'hot-gear-39.out')")
_locate("regex_posix_class", Q("bin/[[:alpha:]]+$", regex=True, all=True, group=False), "regexp_matches(f.path, 'bin/[A-Za-z]+$')")
_locate("regex_posix_negated", Q("lib/[[:^digit:]]*[[:digit:]]", regex=True, all=True, group=False), "regexp_matches(f.path, 'lib/[^0-9]*[0-9]')")
_locate("regex_class_intersection", Q("sbin/[a-z&&[^b-g]]+[0-9]?$", regex=True, all=True, group=False), "regexp_matches(f.path, 'sbin/[ah-z]+[0-9]?$')")
_locate("regex_named_group", Q("(?P<dir>s?bin)/r(?<name>od|ing)", regex=True, all=True, group=False), "regexp_matches(f.path, 's?bin/r(od|ing)')")
_locate("regex_flags", Q("(?i)BIN/(?-i:rod)", regex=True, all=True, group=False), "regexp_matches(f.path, '[bB][iI][nN]/rod')")


def _files(run_on, name: str, sql: str, *names: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_on(*tables(spark, sf_dir, *names))

    register(name, run, sql, names)


def _catalog(run_on, name: str, sql: str, indexes: tuple[str, ...] = (), names: tuple[str, ...] = ("files", "packages")) -> None:
    whole = bool(indexes) or "files" in names
    register(name, lambda spark, sf_dir: run_on(built(spark, sf_dir, *indexes) if whole else recorded(spark, sf_dir)), sql, names)


FP = ("files", "packages")
_files(lambda f, p: locate.locate(f, p, Q("share/", minimal=True)), "locate_minimal", "SELECT DISTINCT CASE WHEN toplevel THEN attr || '.' || output ELSE '(' || attr || '.' || output || ')' END AS label FROM files f JOIN packages p USING (pkg_id) WHERE contains(f.path, 'share/')", *FP)
_files(lambda f, p: locate.count(f, p, Q("bin/", all=True, group=False)), "locate_count", "SELECT count(*) AS n FROM files f JOIN packages p USING (pkg_id) WHERE contains(f.path, 'bin/')", *FP)
_files(lambda f: textindex.basename_prefix_packages(f, "gear"), "locate_basename_prefix", "SELECT DISTINCT pkg_id FROM files WHERE starts_with(regexp_extract(path, '[^/]*$'), 'gear')", "files")
_files(
    lambda f, p, m: locate.json_lines(locate.enriched(locate.locate(f, p, Q("/usr/bin/", all=True)), m)),
    "locate_json_enriched",
    """SELECT '{"attr":"' || CASE WHEN p.toplevel THEN p.attr || '.' || p.output ELSE '(' || p.attr || '.' || p.output || ')' END || '","size":' || CASE WHEN f.kind = 's' THEN 0 ELSE f.size END
        || ',"type":"' || f.kind || '","path":"' || f.path || '","store_path":"/store/' || p.hash || '-' || p.name || '","description":"' || m.description || '"'
        || CASE WHEN m.license IS NULL THEN '' ELSE ',"license":"' || m.license || '"' END || ',"homepage":"' || m.homepage || '","maintainers":["' || array_to_string(m.maintainers, '","') || '"],"platforms":["x86","arm"]'
        || CASE WHEN m.main_program IS NULL THEN '' ELSE ',"main_program":"' || m.main_program || '"' END || '}' AS line
    FROM files f JOIN packages p USING (pkg_id)
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lower(attr) ORDER BY meta_ord) AS nth FROM package_meta) m ON lower(m.attr) = lower(p.attr) AND nth = 1
    WHERE contains(f.path, '/usr/bin/')""",
    "files", "packages", "package_meta",
)
_files(
    lambda f, p: locate.text_lines(locate.locate(f, p, Q("man1/", all=True))),
    "locate_text_format",
    """SELECT rpad(l, CAST(greatest(40, length(l)) AS INT), ' ') || ' ' || lpad(g, CAST(greatest(14, length(g)) AS INT), ' ') || ' ' || kind || ' ' || path AS line FROM (
        SELECT CASE WHEN p.toplevel THEN p.attr || '.' || p.output ELSE '(' || p.attr || '.' || p.output || ')' END AS l, format('{:,}', f.size) AS g, f.kind, f.path
        FROM files f JOIN packages p USING (pkg_id) WHERE contains(f.path, 'man1/'))""",
    *FP,
)
BATCH = ["bin/ring", "  man1/rod ", "", "lib/gear2", "doc/"]
_files(
    lambda f, p: locate.batch(f, p, Q("", all=True, group=False), BATCH).select("pkg_id", "path", "kind", "size", "pattern_no", "pattern"),
    "locate_batch",
    "SELECT f.pkg_id, f.path, f.kind, f.size, b.pattern_no, b.pattern FROM files f, (VALUES (0, 'bin/ring'), (1, 'man1/rod'), (2, 'lib/gear2'), (3, 'doc/')) b(pattern_no, pattern) WHERE contains(f.path, b.pattern)",
    *FP,
)
_files(lambda f: BuildOptions(include_prefix="/share", exclude_prefixes=("/share/doc",)).kept(f), "build_filter_exclude", "SELECT * FROM files WHERE starts_with(path, '/share') AND NOT starts_with(path, '/share/doc')", "files")
_files(lambda f: textindex.document_frequency(textindex.basename_postings(f), "basename"), "basename_postings", "SELECT basename, count(DISTINCT pkg_id) AS df FROM (SELECT regexp_extract(path, '[^/]*$') AS basename, pkg_id FROM files) WHERE basename <> '' GROUP BY 1", "files")
_files(lambda f: textindex.path_postings(f), "path_postings", "SELECT DISTINCT path, pkg_id FROM files WHERE path <> ''", "files")
_files(lambda f: textindex.prefix_packages(f, "/share/man/"), "prefix_packages", "SELECT DISTINCT pkg_id FROM files WHERE starts_with(path, '/share/man/')", "files")
GRAMS = "SELECT DISTINCT upper(hex(encode(substr(path, CAST(i AS INT), 3)))) AS gram, path FROM (SELECT DISTINCT path FROM files WHERE length(path) >= 3), range(1, 64) r(i) WHERE i <= length(path) - 2"
_paths = lambda f: f.select("path").distinct()
_files(lambda f: textindex.path_trigrams(_paths(f)), "trigram_index", GRAMS, "files")
_files(lambda f: textindex.candidates(textindex.path_trigrams(_paths(f)), "man1/rod"), "trigram_candidates", f"SELECT path FROM ({GRAMS}) WHERE gram IN ({', '.join(repr(g) for g in textindex.grams_of('man1/rod'))}) GROUP BY path HAVING count(*) = {len(textindex.grams_of('man1/rod'))}", "files")
_files(lambda f: textindex.indexed_search(f, textindex.path_trigrams(_paths(f)), "bin/bolt"), "trigram_search_verified", "SELECT path, pkg_id, kind, size, target FROM files WHERE contains(path, 'bin/bolt')", "files")
_files(lambda f: textindex.indexed_search(f, textindex.path_trigrams(_paths(f)), "g2"), "short_literal_paths", "SELECT path, pkg_id, kind, size, target FROM files WHERE contains(path, 'g2')", "files")
_files(lambda f: textindex.path_ids(f), "path_ids", "SELECT row_number() OVER (ORDER BY path) - 1 AS path_id, path FROM (SELECT DISTINCT path FROM files WHERE path <> '')", "files")
PROVIDERS = r"SELECT DISTINCT regexp_extract(f.path, '[^/]*$') AS command, p.attr, p.output, p.toplevel FROM files f JOIN packages p USING (pkg_id) WHERE regexp_matches(f.path, '^/(usr/)?s?bin/[^/]+$')"
STRICT = PROVIDERS.replace("^/(usr/)?s?bin/[^/]+$')", "^/bin/[^/]+$') AND f.kind IN ('x', 's')")
SHOWN = "CASE WHEN toplevel THEN attr || '.' || output ELSE '(' || attr || '.' || output || ')' END AS shown"
_files(lambda f, p: commands.providers(f, p), "command_providers", PROVIDERS, *FP)
_files(lambda f, p: commands.which(commands.providers(f, p), "/usr/bin/ring1"), "which_all", f"SELECT command, attr, output, toplevel, {SHOWN} FROM ({PROVIDERS}) WHERE command = 'ring1'", *FP)
_files(lambda f, p: commands.which(commands.providers(f, p), "bolt", False), "which_first", f"SELECT command, attr, output, toplevel, {SHOWN} FROM ({PROVIDERS}) WHERE command = 'bolt' ORDER BY toplevel DESC, attr, output LIMIT 1", *FP)
_files(lambda f, p: commands.providers(f, p, strict=True), "which_strict", STRICT, *FP)


def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, packages = tables(spark, sf_dir, "files", "packages")
    asked = files.select(fn.basename(F.col("path")).alias("command")).where("command <> ''").distinct()
    return commands.suggest(commands.providers(files, packages), asked.unionByName(asked.select(F.concat(F.lit("no-"), F.col("command")).alias("command"))))


register(
    "suggest_table", _suggest,
    f"""SELECT a.command, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'tell' ELSE 'list' END AS action, 127 AS exit_code,
        a.command || CASE WHEN n IS NULL THEN ': command not found' WHEN n = 1 THEN ' is provided by ' || first ELSE ' is provided by ' || n || ' packages, first ' || first END AS message
    FROM (SELECT DISTINCT c AS command FROM (SELECT regexp_extract(path, '[^/]*$') AS b FROM files), LATERAL (SELECT unnest([b, 'no-' || b]) AS c) WHERE b <> '') a
    LEFT JOIN (SELECT command, count(*) AS n, first(attr || '.' || output ORDER BY toplevel DESC, attr, output) AS first FROM ({PROVIDERS}) GROUP BY 1) s USING (command)""",
    FP,
)
META = ("meta_ord", "attr", "score")


def _meta(name: str, q: MetaQuery, where: str, score: str, tail: str = "") -> None:
    _files(lambda m: metasearch.search(m, q).select(*META), name, f"SELECT meta_ord, attr, {score} AS score FROM package_meta WHERE {where} {tail}", "package_meta")


def _points(name: str, text: str, pts: tuple[int, int, int]) -> str:
    return f"CASE WHEN lower({name}) = '{text}' THEN {pts[0]} WHEN starts_with(lower({name}), '{text}') THEN {pts[1]} WHEN contains(lower({name}), '{text}') THEN {pts[2]} ELSE 0 END"


ALL3 = lambda t: " + ".join(_points(n, t, metasearch.POINTS[n]) for n in metasearch.POINTS)
_meta("meta_literal", MetaQuery("ECONOMY", Field.DESCRIPTION), "contains(lower(description), 'economy')", _points("description", "economy", metasearch.POINTS["description"]))
_meta("meta_exact", MetaQuery("Ring", Field.MAIN_PROGRAM, exact=True), "lower(main_program) = 'ring'", "300")
_meta("meta_relevance", MetaQuery("ring", limit=40), "contains(lower(attr), 'ring') OR contains(lower(description), 'ring') OR contains(lower(main_program), 'ring')", ALL3("ring"), f"ORDER BY {ALL3('ring')} DESC, attr, meta_ord LIMIT 40")
RX = "CASE WHEN regexp_full_match({0}, '{1}') THEN {2} WHEN regexp_matches({0}, '^(?:{1})') THEN {3} WHEN regexp_matches({0}, '{1}') THEN {4} ELSE 0 END"
_meta("meta_regex", MetaQuery("gear-[0-9]$", Field.ATTR, regex=True, case_sensitive=True), "regexp_matches(attr, 'gear-[0-9]$')", "1000")
_meta("meta_relevance_regex", MetaQuery("(red|blue)-r[a-z]+-[0-9]", Field.ATTR, regex=True), "regexp_matches(attr, '(red|blue)-r[a-z]+-[0-9]')", RX.format("attr", "(red|blue)-r[a-z]+-[0-9]", 3000, 2000, 1000))
_meta("meta_sort_main_program", MetaQuery("widget", Field.ATTR, sort=MetaSort.MAIN_PROGRAM_DESC, limit=60), "contains(lower(attr), 'widget')", _points("attr", "widget", metasearch.POINTS["attr"]), "ORDER BY coalesce(main_program, '') DESC, meta_ord LIMIT 60")
_files(lambda m: metasearch.info(m, "cold-widget-77"), "info_attr", "SELECT * FROM package_meta WHERE attr = 'cold-widget-77' ORDER BY meta_ord LIMIT 1", "package_meta")
_files(lambda m: m.where(metasearch.fuzzy.subsequence(F.col("attr"), "rdwt")).select("meta_ord", "attr"), "fuzzy_subsequence", "SELECT meta_ord, attr FROM package_meta WHERE regexp_matches(lower(attr), 'r.*d.*w.*t')", "package_meta")
PLACE = "CASE WHEN i = 1 THEN 24 WHEN regexp_matches(substr(s, CAST(i - 1 AS INT), 1), '[a-z0-9]') THEN 16 ELSE 22 END"
STEP = "list_transform(range(1, n + 1), lambda i: CASE WHEN substr(s, CAST(i AS INT), 1) = '{0}' {1} ELSE -1000000 END) AS l"
FIRST = STEP.format("r", f"THEN {PLACE}")
NEXT = "AND i > 1 THEN " + PLACE + " + greatest(list_max(list_transform(range(1, i), lambda j: l[j] - (i - 1 - j))), l[i - 1] + 8)"
_files(
    lambda m: metasearch.search(m, MetaQuery("rdwgt", Field.ATTR, fuzzy=True)).select(*META), "fuzzy_ranked",
    f"SELECT meta_ord, attr, CAST(list_max(l) AS INT) AS score FROM (SELECT * REPLACE ({STEP.format('t', NEXT)}) FROM (SELECT * REPLACE ({STEP.format('g', NEXT)}) FROM (SELECT * REPLACE ({STEP.format('w', NEXT)}) "
    f"FROM (SELECT * REPLACE ({STEP.format('d', NEXT)}) FROM (SELECT *, {FIRST} FROM (SELECT meta_ord, attr, lower(attr) AS s, length(attr) AS n FROM package_meta)))))) WHERE list_max(l) > 0",
    "package_meta",
)
_files(
    lambda p: p.select("pkg_id", fn.parse_store_path(fn.store_path(F.col("store_dir"), F.col("hash"), F.col("name"))).alias("q")).select("pkg_id", "q.dir", "q.hash", "q.name"),
    "store_path_parse", "SELECT pkg_id, store_dir AS dir, hash, name FROM packages", "packages",
)
_files(lambda p: p.select("pkg_id", fn.shown_label(F.col("attr"), F.col("output"), F.col("toplevel")).alias("shown")), "label_format", f"SELECT pkg_id, {SHOWN} FROM packages", "packages")
_files(lambda p: incremental.last_writes(p).select("attr", "output", "pkg_id"), "last_write_wins", "SELECT attr, output, max(pkg_id) AS pkg_id FROM packages GROUP BY ALL", "packages")
_catalog(lambda c: c.totals(), "catalog_stats", "SELECT * FROM (SELECT count(*) AS entries, count(DISTINCT path) AS paths FROM files), (SELECT count(*) AS packages, count(DISTINCT attr) AS attrs FROM packages)")

# Searches through the indexes, and the sets that they are made of.
ENDS = r"/share/.*bolt3$"
_catalog(lambda c: textindex.candidate_paths(c.table("path_trigrams"), literals(ENDS)), "regex_prefix_suffix_candidates", "SELECT DISTINCT path FROM files WHERE contains(path, '/share/') AND contains(path, 'bolt3')", ("path_trigrams",), ("files",))
HAS = " AND ".join(f"bool_or(contains(path, '{t}'))" for t in ("man", "an1", "n1/", "1/r", "/ro", "rod"))
_catalog(lambda c: textindex.candidate_packages(c.table("package_trigrams"), ("man1/rod",)), "package_trigram_pruning", f"SELECT pkg_id FROM files GROUP BY 1 HAVING {HAS}", ("package_trigrams",), ("files",))
_catalog(
    lambda c: textindex.union_packages(c.table("basename_postings").where("basename = 'gear2'"), textindex.prefix_packages(c.table("path_entries"), "/sbin/")).join(
        textindex.candidate_packages(c.table("package_trigrams"), ("lib",)), "pkg_id", "left_semi"),
    "candidate_union_intersect", "SELECT pkg_id FROM files GROUP BY 1 HAVING (bool_or(regexp_extract(path, '[^/]*$') = 'gear2') OR bool_or(starts_with(path, '/sbin/'))) AND bool_or(contains(path, 'lib'))",
    ("basename_postings", "path_entries", "package_trigrams"), ("files",),
)
_catalog(lambda c: textindex.named(c.table("basename_postings").where("basename = 'ring1'"), c.table("packages")).select("basename", "label"), "postings_named", "SELECT 'ring1' AS basename, attr || '.' || output AS label FROM packages WHERE pkg_id IN (SELECT pkg_id FROM files WHERE regexp_extract(path, '[^/]*$') = 'ring1')", ("basename_postings",))
_catalog(
    lambda c: textindex.entries_of(c.table("path_dict"), c.table("path_entries"), c.table("packages"), c.table("path_dict").where("path_id % 5 = 0")),
    "path_id_entries", "SELECT path, attr || '.' || output AS label, '/store/' || hash || '-' || name AS store_path, kind, size FROM files JOIN packages USING (pkg_id) JOIN (SELECT path, row_number() OVER (ORDER BY path) - 1 AS path_id FROM (SELECT DISTINCT path FROM files WHERE path <> '')) USING (path) WHERE path_id % 5 = 0",
    ("path_dict", "path_entries"),
)
_catalog(lambda c: c.lookup("hot-rod-27", "out").select("attr", "output", "pkg_id"), "point_lookup", "SELECT attr, output, max(pkg_id) AS pkg_id FROM packages WHERE attr = 'hot-rod-27' AND output = 'out' GROUP BY ALL", (), ("packages",))
_catalog(lambda c: c.which("ring1").select("command", "attr", "output", "toplevel", "shown"), "which_indexed", f"SELECT command, attr, output, toplevel, {SHOWN} FROM ({PROVIDERS}) WHERE command = 'ring1'", ("command_providers",))
REGEXES = ["^/bin/r", "lib/g.*[13]$", "(bolt|nut)4"]
_catalog(
    lambda c: c.batch(Q("", regex=True, all=True, group=False), REGEXES).select("pkg_id", "path", "pattern_no", "pattern"), "locate_batch_regex",
    "SELECT f.pkg_id, f.path, b.pattern_no, b.pattern FROM files f, (VALUES (0, '^/bin/r'), (1, 'lib/g.*[13]$'), (2, '(bolt|nut)4')) b(pattern_no, pattern) WHERE regexp_matches(f.path, b.pattern)", (), ("files",),
)
_catalog(lambda c: locate.json_lines(c.locate(Q("man1/rod", minimal=True)), minimal=True), "locate_json_minimal", """SELECT DISTINCT '{"attr":"' || CASE WHEN toplevel THEN attr || '.' || output ELSE '(' || attr || '.' || output || ')' END || '"}' AS line FROM files f JOIN packages p USING (pkg_id) WHERE contains(f.path, 'man1/rod')""", ("path_trigrams",))


def _modes(c: Catalog) -> DataFrame:
    asked, out = c.table("files").select(fn.basename(F.col("path")).alias("command")).where("command <> ''").distinct(), None
    for mode in commands.MODES:
        part = c.suggest(asked, mode).select(F.lit(mode).alias("mode"), "command", "n", "action", "exit_code")
        out = part if out is None else out.unionByName(part)
    return out


_catalog(
    _modes, "suggest_modes",
    f"""SELECT mode, command, n, action, CASE WHEN action IN ('install', 'run') THEN 0 ELSE 127 END AS exit_code FROM (
        SELECT mode, a.command, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n IS NULL THEN 'none' WHEN mode = 'json' THEN 'json'
            WHEN n = 1 AND mode = 'message' THEN 'tell' WHEN n = 1 AND mode = 'interactive' THEN CASE WHEN top THEN 'prompt' ELSE 'tell' END
            WHEN n = 1 THEN CASE WHEN NOT top THEN 'refuse' WHEN mode = 'auto-run' THEN 'run' ELSE 'install' END
            WHEN mode = 'message' THEN 'list' WHEN mode = 'interactive' THEN 'prompt' ELSE 'refuse' END AS action
        FROM (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS command FROM files WHERE path <> '') a CROSS JOIN (VALUES ('message'), ('auto-install'), ('auto-run'), ('interactive'), ('json')) m(mode)
        LEFT JOIN (SELECT command, count(*) AS n, bool_or(toplevel) AS top FROM ({PROVIDERS}) GROUP BY 1) s USING (command))""",
    ("command_providers",),
)
_files(lambda m: m.select("meta_ord", fn.percent_encoded(F.concat("description", F.lit(" *+~(é)/"))).alias("enc")), "percent_encode", "SELECT meta_ord, url_encode(description || ' *+~(é)/') AS enc FROM package_meta", "package_meta")
_files(lambda f: f.select("pkg_id", "path", fn.highlighted(F.col("path"), "bin/|g").alias("shown")), "highlight", "SELECT pkg_id, path, regexp_replace(path, '(bin/|g)', chr(27) || '[31m\\1' || chr(27) || '[0m', 'g') AS shown FROM files", "files")
_files(lambda m: m.select("meta_ord", fn.cache_digest(F.col("license")).alias("cache_key")), "cache_digest", "SELECT meta_ord, CASE WHEN license IS NULL THEN 'unknown' ELSE sha256(license) END AS cache_key FROM package_meta", "package_meta")


def _metadata_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    (meta,) = tables(spark, sf_dir, "package_meta")
    path = f"{shared_folder(spark).rstrip('/')}/meta-{uuid.uuid4().hex}"
    evaluation.write_metadata(meta.drop("meta_ord"), path)
    return evaluation.read_metadata(spark, path)


register("metadata_roundtrip", _metadata_copy, "SELECT attr, name, description, main_program, license, homepage, maintainers, platforms FROM package_meta", ("package_meta",))


def _scopes(p: DataFrame) -> DataFrame:
    def broken() -> DataFrame:
        raise OSError("gone")

    part = lambda k: p.where(F.col("pkg_id") % 4 == k).select("pkg_id")
    return evaluation.union_scopes(part(0), {"extra": lambda: part(1), "bad;name": lambda: part(2), "../up": lambda: part(2), "lost": broken})


_files(_scopes, "scope_union", "SELECT pkg_id FROM packages WHERE pkg_id % 4 < 2", "packages")
_files(
    lambda p: p.select("pkg_id", evaluation.valid_scope(F.concat(F.when(F.col("pkg_id") % 3 == 0, "x..").when(F.col("pkg_id") % 3 == 1, "9").otherwise("s"), F.col("attr"))).alias("ok")),
    "scope_validation", "SELECT pkg_id, pkg_id % 3 = 2 AS ok FROM packages", "packages",
)
_files(lambda p, r: closure.closure(_roots(p), r.withColumn("dst_name", F.lit("n")), deep=False).select("hash", "attr", "output", "toplevel"), "closure_shallow", "SELECT hash, attr, output, toplevel FROM packages WHERE pkg_id % 50 = 1", "packages", "refs")


def _eval_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, files, meta = derive(spark, sf_dir, "packages", "files", "package_meta")
    c = Catalog.build(spark, f"{shared_folder(spark).rstrip('/')}/eval-{uuid.uuid4().hex}", packages, files, meta, BuildOptions(eval_only=True))
    return c.search(MetaQuery("Ring", Field.MAIN_PROGRAM, exact=True)).select("meta_ord", "attr", F.lit(c.counters.entries).alias("entries"))


register("build_eval_only", _eval_only, "SELECT meta_ord, attr, 0 AS entries FROM package_meta WHERE lower(main_program) = 'ring'", ("package_meta",))


def _narinfo(p: DataFrame) -> DataFrame:
    other = F.concat(F.lpad((F.col("pkg_id") * 2).cast("string"), 32, "0"), F.lit("-dep"))
    refs = F.when(F.col("pkg_id") % 5 == 0, F.lit("")).when(F.col("pkg_id") % 7 == 0, F.lit("short-x")).otherwise(F.concat_ws(" ", F.concat("hash", F.lit("-"), "name"), other))
    return listings.references(p.select("hash", F.concat(F.lit("StorePath: /store/x\nURL: nar/"), "hash", F.lit(".nar\nReferences: "), refs, F.lit("\n")).alias("value")))


_files(
    _narinfo, "narinfo_references",
    """SELECT hash, 'nar/' || hash || '.nar' AS url, pkg_id % 5 = 0 OR pkg_id % 7 <> 0 AS ok, CASE WHEN pkg_id % 5 <> 0 AND pkg_id % 7 <> 0 THEN k END AS ord,
        CASE WHEN pkg_id % 5 <> 0 AND pkg_id % 7 <> 0 THEN CASE k WHEN 0 THEN hash ELSE lpad(CAST(pkg_id * 2 AS VARCHAR), 32, '0') END END AS dst_hash,
        CASE WHEN pkg_id % 5 <> 0 AND pkg_id % 7 <> 0 THEN CASE k WHEN 0 THEN name ELSE 'dep' END END AS dst_name
    FROM packages, (VALUES (0), (1)) v(k) WHERE k = 0 OR (pkg_id % 5 <> 0 AND pkg_id % 7 <> 0)""",
    "packages",
)
_files(
    lambda p: incremental.upsert(p.where("pkg_id % 2 = 0").select(F.lit("k").alias("cache_key"), "hash", F.lit("old").alias("tree")), p.where("pkg_id % 3 = 0").select(F.lit("k").alias("cache_key"), "hash", F.lit("new").alias("tree"))),
    "cache_upsert", "SELECT 'k' AS cache_key, hash, CASE WHEN pkg_id % 3 = 0 THEN 'new' ELSE 'old' END AS tree FROM packages WHERE pkg_id % 2 = 0 OR pkg_id % 3 = 0", "packages",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


EV = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cached, CASE event_id % 5 WHEN 0 THEN 'cached' WHEN 1 THEN 'local' WHEN 2 THEN 'none' END AS status FROM events"


def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    cached = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    status = F.when(F.col("event_id") % 5 == 0, "cached").when(F.col("event_id") % 5 == 1, "local").when(F.col("event_id") % 5 == 2, "none")
    return e.select("event_id", evaluation.available(cached, status).alias("available"))


register("job_available", _available, f"SELECT event_id, coalesce(cached, false) OR coalesce(status IN ('cached', 'local'), false) OR (cached IS NULL AND status IS NULL) AS available FROM ({EV})")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records made of packages: some failed, some broken, with one or two outputs."""
    (p,) = derive(spark, sf_dir, "packages")
    path = fn.store_path(F.col("store_dir"), F.col("hash"), F.col("name"))
    line = F.format_string('{"attr":"%s","name":"%s","system":"x","outputs":{"out":"%s","doc":%s},"meta":{"mainProgram":"m%d","license":{"fullName":"F%d","spdx-id":"S"}}}', "attr", "name", path, F.when(F.col("pkg_id") % 2 == 0, F.concat(F.lit('"'), path, F.lit('-doc"'))).otherwise("null"), "pkg_id", "pkg_id")
    bad = F.when(F.col("pkg_id") % 10 == 0, F.lit('{"attr":"x","error":"no","fatal":false}')).when(F.col("pkg_id") % 11 == 0, F.lit("{broken")).when(F.col("pkg_id") % 13 == 0, F.lit("  "))
    return p.select(F.coalesce(bad, line).alias("value"))


register(
    "outputs_explode", lambda s, d: evaluation.outputs(evaluation.records(_lines(s, d))),
    """SELECT attr, o AS output, true AS toplevel, 'x' AS system, store_dir, hash, CASE WHEN o = 'doc' THEN name || '-doc' ELSE name END AS name, CASE WHEN o = 'out' THEN 'm' || pkg_id END AS main_program
    FROM packages, (VALUES ('out'), ('doc')) v(o) WHERE pkg_id % 10 <> 0 AND pkg_id % 11 <> 0 AND pkg_id % 13 <> 0 AND (o = 'out' OR pkg_id % 2 = 0)""",
    ("packages",),
)
register(
    "license_extract", lambda s, d: evaluation.metadata(evaluation.records(_lines(s, d))).select("attr", "name", "main_program", "license"),
    "SELECT attr, name, 'm' || pkg_id AS main_program, 'F' || pkg_id AS license FROM packages WHERE pkg_id % 10 <> 0 AND pkg_id % 11 <> 0 AND pkg_id % 13 <> 0",
    ("packages",),
)


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    (p,) = derive(spark, sf_dir, "packages")
    tree = F.format_string('{"root":{"type":"directory","entries":{"bin":{"type":"directory","entries":{"%s":{"type":"regular","size":%d,"executable":true},"l":{"type":"%s","target":"t"}}}}}}', "attr", "pkg_id", F.when(F.col("pkg_id") % 9 == 0, "fifo").otherwise("symlink"))
    return listings.file_rows(p.select("hash", tree.alias("tree")))


register(
    "tree_flatten", _trees,
    """SELECT hash, path, kind, size, target FROM packages, LATERAL (SELECT unnest([
        {'path': '', 'kind': 'd', 'size': 1, 'target': NULL}, {'path': '/bin', 'kind': 'd', 'size': 2, 'target': NULL},
        {'path': '/bin/' || attr, 'kind': 'x', 'size': pkg_id, 'target': NULL}, {'path': '/bin/l', 'kind': 's', 'size': 0, 'target': 't'}], recursive := true)) WHERE pkg_id % 9 <> 0""",
    ("packages",),
)


def _roots(p: DataFrame) -> DataFrame:
    return p.where("pkg_id % 50 = 1").select("hash", "attr", "output", "toplevel", "name", F.lit(None).cast("string").alias("main_program"), F.col("pkg_id").alias("ord"))


REACH = "r(hash) AS (SELECT hash FROM packages WHERE pkg_id % 50 = 1 UNION SELECT dst_hash FROM r JOIN refs ON src_hash = r.hash)"
_files(lambda p, r: closure.reachable(_roots(p), r).select("hash"), "closure_reachable", "SELECT hash FROM r", "packages", "refs")
ORACLES["closure_reachable"] = prelude("packages", "refs").replace("WITH", "WITH RECURSIVE", 1) + f", {REACH} SELECT hash FROM r"
_files(lambda p, r: closure.closure(_roots(p), r.withColumn("dst_name", F.lit("n"))).select("hash", "attr", "output", "toplevel", "is_root"), "closure_labels", "", "packages", "refs")
ORACLES["closure_labels"] = prelude("packages", "refs").replace("WITH", "WITH RECURSIVE", 1) + (
    f", {REACH} SELECT r.hash, CASE WHEN pkg_id % 50 = 1 THEN attr ELSE '' END AS attr, CASE WHEN pkg_id % 50 = 1 THEN output ELSE 'out' END AS output, "
    "coalesce(pkg_id % 50 = 1 AND toplevel, false) AS toplevel, coalesce(pkg_id % 50 = 1, false) AS is_root FROM r LEFT JOIN packages USING (hash)"
)


def _synth(p: DataFrame, f: DataFrame) -> DataFrame:
    own = p.withColumn("main_program", F.when(F.col("pkg_id") % 4 != 0, F.element_at(F.split("attr", "-"), 2)).otherwise("a/b")).withColumn("is_root", F.lit(True))
    status = p.select("hash", F.when(F.col("pkg_id") % 3 == 0, 404).otherwise(F.when(F.col("pkg_id") % 7 == 0, 500).otherwise(200)).alias("listing_status"), F.lit(200).alias("refs_status"))
    return closure.with_listings(own, f.join(p.select("pkg_id", "hash"), "pkg_id").select("hash", "path", "kind", "size", "target"), status)


_files(
    _synth, "main_program_synth",
    """SELECT hash, path, kind, size, target FROM files JOIN packages USING (pkg_id) WHERE pkg_id % 3 <> 0 AND pkg_id % 7 <> 0
    UNION ALL SELECT hash, path, kind, size, target FROM packages, LATERAL (SELECT unnest([{'path': '', 'kind': 'd', 'size': 1, 'target': CAST(NULL AS VARCHAR)},
        {'path': '/bin', 'kind': 'd', 'size': 1, 'target': CAST(NULL AS VARCHAR)}, {'path': '/bin/' || split_part(attr, '-', 2), 'kind': 'x', 'size': 0, 'target': CAST(NULL AS VARCHAR)}], recursive := true))
    WHERE pkg_id % 3 = 0 AND pkg_id % 4 <> 0""",
    "packages", "files",
)


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("event_type").alias("cache_key"), F.col("event_id").cast("string").alias("hash"), F.col("ts").cast("timestamp").alias("fetched_at"))
    now = e.agg(F.max("fetched_at").alias("now"))
    return incremental.fresh(e.crossJoin(F.broadcast(now)), "view", F.col("now")).select("hash")  # one row


register("cache_ttl_filter", _cache, "SELECT CAST(event_id AS VARCHAR) AS hash FROM events WHERE event_type = 'view' AND epoch((SELECT max(ts) FROM events)) - epoch(ts) < 604801")
_files(
    lambda p: incremental.reuse(p, p.where("pkg_id % 2 = 0").select("attr", "output", "hash"), p.where("pkg_id % 3 = 0").select("hash")).select("pkg_id", "reused"),
    "prev_build_reuse", "SELECT pkg_id, pkg_id % 6 = 0 AS reused FROM packages", "packages",
)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").cast("string").alias("name"), (F.floor("o_totalprice") * 100).alias("total"))


SEG = """SELECT name, k AS segment, CAST((total * k) // n AS BIGINT) AS first_byte, CAST((total * (k + 1)) // n AS BIGINT) - 1 AS last_byte FROM (
    SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(floor(o_totalprice) AS BIGINT) * 100 AS total, greatest(1, least(8, (CAST(floor(o_totalprice) AS BIGINT) * 100) // 1048576)) AS n FROM orders), range(0, 8) r(k) WHERE k < n AND total > 0"""
register("segment_plan", lambda s, d: incremental.segments(_sizes(s, d), 8), SEG)


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = incremental.segments(_sizes(spark, sf_dir), 8)
    return incremental.missing_segments(plan, plan.where("segment % 2 = 0").select("name", "segment"))


register("segments_missing", _missing, f"SELECT * FROM ({SEG}) WHERE segment % 2 <> 0")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("blob"), F.encode("html", "UTF-8").alias("data"))
    made = incremental.chunks(pages, 256, 1024, 4096)
    back = incremental.reconstruct(made.drop("data"), made.select("hash", "data"))
    return back.select("blob", F.sha2("data", 256).alias("sha"), "ok")


register("chunk_manifest", _chunks, "SELECT CAST(page_id AS VARCHAR) AS blob, sha256(html) AS sha, true AS ok FROM pages WHERE strlen(html) > 0")


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, packages = derive(spark, sf_dir, "files", "packages")
    files = files.withColumn("target", F.when(F.col("kind") == "s", fn.basename(F.col("path"))))
    path = f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}/files"
    archive.write_archive(packages, files, path, frame_bytes=1 << 18)
    packages, files = archive.read_archives(spark, path)
    return files.join(packages, "pkg_id").select("pkg_id", "attr", "output", "toplevel", "system", "hash", "name", "path", "kind", "size", "target")


register(
    "archive_roundtrip", _archive,
    "SELECT dense_rank() OVER (ORDER BY p.pkg_id) - 1 AS pkg_id, p.attr, p.output, p.toplevel, p.system, p.hash, p.name, f.path, f.kind, CASE WHEN f.kind = 's' THEN 0 ELSE f.size END AS size, CASE WHEN f.kind = 's' THEN regexp_extract(f.path, '[^/]*$') END AS target FROM files f JOIN packages p ON p.pkg_id = f.pkg_id",
    ("packages", "files"),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["locate_literal"](spark, sf_dir)
