"""Operators on packages and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import graph as G
from lintlake.operators import packages as P
from lintlake.operators.history import ordered_sum
from lintlake.plans.base import query, values

USED = "SELECT DISTINCT l_suppkey AS project, l_partkey AS package FROM lineitem WHERE l_partkey % 5 <> 0 UNION SELECT DISTINCT l_suppkey, l_partkey + 1 FROM lineitem WHERE l_partkey % 9 = 0"
TIERS = ["permissive", "permissive", "permissive", "weak-copyleft", "permissive", "strong-copyleft", "restrictive", "permissive", "public-domain", "weak-copyleft", "permissive", "permissive"]
NAMES = ["MIT", "Apache-2.0", "ISC", "MPL-2.0", "BSD-3-Clause", "GPL-3.0-only", "CC-BY-NC-4.0", "Zlib", "Unlicense", "LGPL-2.1-only", "BSD-2-Clause", "0BSD"]
TIER_SQL = "CASE license_no " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TIERS)) + " END"
NAME_SQL = "CASE license_no " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(NAMES)) + " END"


def used(s):
    s.view("lineitem").createOrReplaceTempView("lineitem")
    return s.spark.sql(USED)


def licensed(s):
    return s.view("locked").withColumn("tier", F.expr(TIER_SQL)).withColumn("license", F.expr(NAME_SQL))


@query("j16_unused_deps", "declared", f"WITH u AS ({USED}) SELECT project, package, scope FROM declared d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.project = d.project AND u.package = d.package)")
def _(s):
    return P.unused_deps(s.view("declared"), used(s), s.table("lineitem").count()).select("project", "package", "scope")


@query("j17_phantom_deps", "declared", f"WITH u AS ({USED}) SELECT project, package FROM u WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE u.project = d.project AND u.package = d.package)")
def _(s):
    return P.phantom_deps(used(s), s.view("declared"), s.table("lineitem").count()).select("project", "package")


@query("j18_version_mismatch", "declared locked", "SELECT project, package, range_text, version, CASE WHEN version IS NULL THEN 'missing' ELSE 'mismatch' END AS state FROM declared LEFT JOIN locked USING (project, package) WHERE version IS NULL OR major_no <> wanted")
def _(s):
    return P.version_mismatch(s.view("declared"), s.view("locked"))


MATRIX = [("MIT", "GPL-3.0-only", "incompatible"), ("MIT", "MIT", "compatible"), ("MIT", "Apache-2.0", "compatible"), ("MIT", "ISC", "compatible"), ("MIT", "LGPL-2.1-only", "review"), ("GPL-3.0-only", "GPL-3.0-only", "compatible"), ("GPL-3.0-only", "MIT", "compatible"), ("GPL-3.0-only", "CC-BY-NC-4.0", "incompatible")]
OWN = "CASE WHEN project % 3 = 0 THEN 'GPL-3.0-only' ELSE 'MIT' END"


@query("j19_license_compat", "locked", f"WITH m AS ({values(MATRIX, 'a, b, verdict')}), l AS (SELECT project, package, {OWN} AS project_license, {NAME_SQL} AS license FROM locked) SELECT project, package, project_license, license, coalesce(verdict, 'check-required') AS verdict FROM l LEFT JOIN m ON a = project_license AND b = license WHERE coalesce(verdict, '') <> 'compatible'")
def _(s):
    matrix = s.spark.createDataFrame(MATRIX, "project_license string, license string, verdict string")
    return P.license_compat(licensed(s).withColumn("project_license", F.expr(OWN)), matrix).select("project", "package", "project_license", "license", "verdict")


HEAVY = [(7, "small-seven"), (21, "small-21"), (100, "small-100"), (500, "small-500")]


@query("j20_heavy_packages", "declared", f"WITH h AS ({values(HEAVY, 'heavy, alternative')}) SELECT project, package, alternative FROM declared JOIN h ON heavy = package UNION ALL SELECT project, NULL, 'split' FROM declared GROUP BY project HAVING count(*) > 450")
def _(s):
    return P.heavy_packages(s.view("declared"), s.spark.createDataFrame(HEAVY, "package long, alternative string"), 450)


SWAPS = [(10, 11), (20, 22), (30, 33), (44, 55)]


@query("j21_migrations", "declared", f"WITH o AS ({values(SWAPS, 'old, replacement')}) SELECT project, package, CAST(replacement AS BIGINT) AS replacement FROM declared d JOIN o ON old = package WHERE NOT EXISTS (SELECT 1 FROM declared e WHERE e.project = d.project AND e.package = replacement)")
def _(s):
    return P.migrations(s.view("declared"), s.spark.createDataFrame(SWAPS, "package long, replacement long"))


@query("a13_ip_score", "locked", f"WITH l AS (SELECT project, {TIER_SQL} AS tier, CASE package % 50 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM locked), c AS (SELECT project, 100 - 15 * count(*) FILTER (WHERE severity = 'critical') - 5 * count(*) FILTER (WHERE severity = 'warning') - least(10 * count(*) FILTER (WHERE tier = 'strong-copyleft'), 30) - least(8 * count(*) FILTER (WHERE tier = 'restrictive'), 24) - least(2 * count(*) FILTER (WHERE tier = 'weak-copyleft'), 10) AS raw FROM l GROUP BY project), s AS (SELECT project, greatest(0, raw) AS score FROM c) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def _(s):
    packages = licensed(s)
    markers = packages.withColumn("severity", F.expr("CASE package % 50 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END"))
    return P.ip_score(markers, packages)


@query("a14_license_tiers", "locked", f"SELECT {TIER_SQL} AS tier, count(*) FILTER (WHERE is_direct) AS direct, count(*) FILTER (WHERE NOT is_direct) AS transitive FROM locked GROUP BY 1")
def _(s):
    return P.license_tiers(licensed(s))


@query("a16_multi_version", "locked", "SELECT package, string_agg(DISTINCT m, ',' ORDER BY m) AS majors, count(DISTINCT m) AS n FROM (SELECT package, CAST((major_no + project) % 3 AS VARCHAR) AS m FROM locked) GROUP BY package HAVING count(DISTINCT m) > 1")
def _(s):
    return P.multi_version(s.view("locked").withColumn("major_no", (F.col("major_no") + F.col("project")) % 3))


@query("a15_compliance_gate", "locked declared", f"WITH k AS (SELECT project, bool_and({TIER_SQL} <> 'strong-copyleft') AS ok FROM locked GROUP BY project UNION ALL SELECT project, count(*) <= 450 FROM declared GROUP BY project UNION ALL SELECT project, count(*) FILTER (WHERE is_direct) > 100 FROM locked GROUP BY project) SELECT project, count(*) FILTER (WHERE NOT ok) AS failed, bool_and(ok) AS passed FROM k GROUP BY project")
def _(s):
    packages = licensed(s)
    checks = [
        packages.groupBy("project").agg(F.bool_and(F.col("tier") != "strong-copyleft").alias("ok")),
        s.view("declared").groupBy("project").agg((F.count(F.lit(1)) <= 450).alias("ok")),
        packages.groupBy("project").agg((F.count_if("is_direct") > 100).alias("ok")),
    ]
    return P.compliance_gate(checks[0].union(checks[1]).union(checks[2]))


TESTS = "SELECT user_id AS test, event_id % 13 <> 0 AS ok FROM events"


@query("a35_flaky_tests", "", f"WITH t AS ({TESTS}), n AS (SELECT test, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM t GROUP BY test) SELECT *, CAST(floor(failed * 100 / (passed + failed) + 0.5) AS BIGINT) AS rate FROM n WHERE passed > 0 AND failed > 0")
def _(s):
    s.view("events").createOrReplaceTempView("events")
    return P.flaky_tests(s.spark.sql(TESTS))


COVERAGE = "SELECT user_id AS repo, event_type AS metric, CAST(floor(avg(value) * 10) AS BIGINT) % 101 AS pct FROM events GROUP BY user_id, event_type"


@query("a36_coverage_gaps", "", f"WITH c AS ({COVERAGE}), t AS (SELECT 'click' AS metric, 80 AS least UNION ALL SELECT 'view', 60 UNION ALL SELECT 'error', 40) SELECT repo, c.metric, pct, least, least - pct AS gap FROM c JOIN t ON t.metric = c.metric WHERE pct < least")
def _(s):
    sums = ordered_sum(s.table("events"), ["user_id", "event_type"], "value", "event_id")
    coverage = sums.select(F.col("user_id").alias("repo"), F.col("event_type").alias("metric"), (F.floor(F.col("total") / F.col("known") * 10).cast("long") % 101).alias("pct"))
    limits = s.spark.createDataFrame([("click", 80), ("view", 60), ("error", 40)], "metric string, least int")
    return P.coverage_gaps(coverage, limits)


ADVISORIES = "SELECT project, CASE package % 40 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' ELSE 'low' END AS severity, package % 2 = 0 AS fixable FROM locked WHERE package % 40 < 4"


@query("a47_advisory_summary", "locked", f"WITH a AS ({ADVISORIES}), n AS (SELECT project, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'moderate') AS moderate, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE fixable) AS fixable FROM a GROUP BY project) SELECT *, greatest(0, 100 - 25 * critical - 15 * high - 5 * moderate - low) AS score FROM n")
def _(s):
    s.view("locked").createOrReplaceTempView("locked")
    return P.advisory_summary(s.spark.sql(ADVISORIES))


@query("s03_read_manifests", "declared", "SELECT project AS repo, 'pkg' || package AS package, range_text AS range, scope FROM declared")
def _(s):
    entries = lambda scope: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.struct(F.concat(F.lit("pkg"), "package").alias("k"), F.col("range_text").alias("v"))))))
    manifests = s.view("declared").groupBy("project").agg(entries("prod").alias("dependencies"), entries("dev").alias("devDependencies"))
    return P.read_manifests(manifests.select(F.col("project").alias("repo"), F.to_json(F.struct("dependencies", "devDependencies")).alias("content")))


@query("s04_read_lockfiles", "locked", f"SELECT project AS repo, 'pkg' || package AS name, version, {NAME_SQL} AS license, NOT is_direct AS dev FROM locked")
def _(s):
    path = F.concat(F.when(F.col("is_direct"), F.lit("")).otherwise(F.lit("node_modules/root/")), F.lit("node_modules/pkg"), "package")
    entry = F.struct(path.alias("k"), F.struct("version", "license", (~F.col("is_direct")).alias("dev")).alias("v"))
    locks = licensed(s).groupBy("project").agg(F.map_from_entries(F.collect_list(entry)).alias("packages"))
    return P.read_lockfiles(locks.select(F.col("project").alias("repo"), F.to_json(F.struct("packages")).alias("content"))).select("repo", "name", "version", "license", "dev")


@query("s14_to_sarif", "findings", "SELECT repo, count(*) AS n_results, count(*) FILTER (WHERE severity IN ('critical', 'error')) AS n_errors, '2.1.0' AS version FROM findings GROUP BY repo")
def _(s):
    results = F.from_json("sarif", "version STRING, runs ARRAY<STRUCT<results:ARRAY<STRUCT<ruleId:STRING,level:STRING>>>>")
    read = P.to_sarif(s.view("findings")).select("repo", results.alias("d"))
    rows = F.col("d.runs")[0]["results"]
    return read.select("repo", F.size(rows).cast("long").alias("n_results"), F.size(F.filter(rows, lambda r: r["level"] == "error")).cast("long").alias("n_errors"), F.col("d.version").alias("version"))


@query("s15_to_cyclonedx", "locked", f"SELECT project, count(*) AS n_components, min('pkg:npm/' || package || '@' || version) AS first_purl, count(*) FILTER (WHERE {NAME_SQL} = 'MIT') AS n_mit FROM locked GROUP BY project")
def _(s):
    parts = licensed(s).select("project", F.col("package").cast("string").alias("name"), "version", "license")
    read = P.to_cyclonedx(parts).select("project", "n_components", F.from_json("bom", "components ARRAY<STRUCT<purl:STRING,licenses:ARRAY<STRUCT<license:STRUCT<id:STRING>>>>>").alias("d"))
    return read.select("project", "n_components", F.array_min("d.components.purl").alias("first_purl"), F.size(F.filter("d.components", lambda c: c["licenses"][0]["license"]["id"] == "MIT")).cast("long").alias("n_mit"))


@query("s16_to_spdx", "locked", "SELECT project, count(*) AS n_packages, count(*) + 1 AS n_relations, count(*) FILTER (WHERE NOT is_direct) AS n_dev FROM locked GROUP BY project")
def _(s):
    parts = licensed(s).select("project", F.col("package").cast("string").alias("name"), "version", "license", (~F.col("is_direct")).alias("dev"))
    read = P.to_spdx(parts).select("project", "n_packages", F.from_json("spdx", "relationships ARRAY<STRUCT<relationshipType:STRING>>").alias("d"))
    return read.select("project", "n_packages", F.size("d.relationships").cast("long").alias("n_relations"), F.size(F.filter("d.relationships", lambda r: r["relationshipType"] == "DEV_DEPENDENCY_OF")).cast("long").alias("n_dev"))


@query("a21_module_coupling", "edges", "WITH o AS (SELECT src AS module, count(*) AS out_degree FROM edges GROUP BY src), i AS (SELECT dst AS module, count(*) AS in_degree FROM edges GROUP BY dst) SELECT coalesce(o.module, i.module) AS module, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) + coalesce(in_degree, 0) AS coupling FROM o FULL JOIN i ON o.module = i.module")
def _(s):
    return G.module_coupling(s.view("edges"))


LOOPED = "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE src % 50 = 0 UNION SELECT src, src FROM edges WHERE src % 300 = 7"


@query("g01_cycles", "edges", f"WITH g AS ({LOOPED}), p AS (SELECT src AS start, dst AS last, [src, dst] AS path FROM g WHERE dst > src UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN g ON src = last WHERE dst > start AND NOT list_contains(path, dst) AND len(path) < 4), c AS (SELECT DISTINCT list_sort(path) AS nodes FROM p JOIN g ON src = last AND dst = start UNION SELECT [src] FROM g WHERE src = dst) SELECT array_to_string(nodes, '-') AS nodes FROM c")
def _(s):
    s.view("edges").createOrReplaceTempView("edges")
    return G.cycles(s.spark.sql(LOOPED), 4).select(F.array_join("nodes", "-").alias("nodes"))


@query("g01_components", "edges", f"WITH g AS ({LOOPED}), r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON g.src = r.dst), m AS (SELECT r.src AS module, greatest(r.src, max(r.dst)) AS component FROM r JOIN r b ON b.src = r.dst AND b.dst = r.src WHERE r.src <> r.dst GROUP BY r.src) SELECT * FROM m")
def _(s):
    s.view("edges").createOrReplaceTempView("edges")
    return G.strong_components(s.spark.sql(LOOPED))


@query("g02_orphans", "edges", "SELECT p_partkey AS module FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges)")
def _(s):
    return G.orphans(s.table("part").select(F.col("p_partkey").alias("module")), s.view("edges"))


#: Changed are the modules whose id is divisible by 20.
REACH = """WITH r AS (SELECT p_partkey AS module, 0 AS distance FROM part WHERE p_partkey % 20 = 0 UNION SELECT src, distance + 1 FROM r JOIN edges ON dst = module WHERE distance < 40),
    d AS (SELECT module, min(distance) AS distance FROM r GROUP BY module), v AS (SELECT d.module, min(below.module) AS via FROM d JOIN edges ON src = d.module JOIN d below ON below.module = dst AND below.distance = d.distance - 1 GROUP BY d.module),
    w AS (SELECT module, distance, module AS here, [module] AS route FROM d UNION ALL SELECT w.module, w.distance, via, list_append(route, via) FROM w JOIN v ON v.module = w.here)
    SELECT module, distance, array_to_string(route, '>') AS route FROM w WHERE len(route) = distance + 1"""


@query("g03_blast_radius", "edges", REACH)
def _(s):
    seeds = s.table("part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("module"))
    return G.reach(s.view("edges"), seeds).withColumn("route", F.array_join("route", ">"))


@query("g04_waves", "edges", "WITH t AS (SELECT src AS task, dst AS depends_on FROM edges WHERE dst < src AND src > 1), w AS (SELECT depends_on AS task, 0 AS wave FROM t WHERE depends_on NOT IN (SELECT task FROM t) UNION SELECT t.task, wave + 1 FROM w JOIN t ON t.depends_on = w.task) SELECT task, max(wave) AS wave FROM w GROUP BY task")
def _(s):
    return G.waves(s.view("edges").where("dst < src AND src > 1").select(F.col("src").alias("task"), F.col("dst").alias("depends_on")))


@query("g05_transitive_exposure", "edges", "WITH l AS (SELECT p_partkey AS package, 'GPL-3.0-only' AS license FROM part WHERE p_partkey % 12 = 5), r AS (SELECT p_partkey AS root, p_partkey AS package, 0 AS distance FROM part UNION SELECT root, dst, distance + 1 FROM r JOIN edges ON src = package WHERE distance < 30), d AS (SELECT root, r.package, min(distance) AS distance, license FROM r JOIN l ON l.package = r.package GROUP BY root, r.package, license), v AS (SELECT d.root, d.package, min(below.root) AS via FROM d JOIN edges ON src = d.root JOIN d below ON below.root = dst AND below.package = d.package AND below.distance = d.distance - 1 GROUP BY d.root, d.package), w AS (SELECT root, package, distance, license, root AS here, [root] AS path FROM d UNION ALL SELECT w.root, w.package, distance, license, via, list_append(path, via) FROM w JOIN v ON v.root = w.here AND v.package = w.package) SELECT root, package, distance, license, array_to_string(path, '>') AS path FROM w WHERE len(path) = distance + 1")
def _(s):
    part = s.table("part")
    licenses = part.select(F.col("p_partkey").alias("package"), F.lit("GPL-3.0-only").alias("license"), (F.col("p_partkey") % 12 == 5).alias("copyleft"))
    roots = part.select(F.col("p_partkey").alias("module"))
    return G.transitive_exposure(s.view("edges"), licenses, roots).withColumn("path", F.array_join("path", ">"))


#: Code lines with index files, of which some hold exports only, and imports of whole libraries.
BUNDLED = """SELECT repo, CASE WHEN path LIKE '%5.ts' THEN replace(path, '.ts', '/index.ts') ELSE path END AS path, line_no,
    CASE WHEN path LIKE '%15.ts' AND repo <> 'web' THEN 'export * from "./part";' WHEN text LIKE 'import lodash%' THEN 'import _ from "lodash";' WHEN text LIKE 'import { readFile%' THEN 'import * as fs from "fs";' ELSE text END AS text FROM code_line"""
MANIFEST = """SELECT source AS repo, 'package.json' AS path, CASE length(source) % 3 WHEN 0 THEN '{"sideEffects": false}' WHEN 1 THEN '{"type": "module"}' ELSE '{"module": "", "exports": {"a": 1}, "sideEffects": []}' END AS content FROM documents GROUP BY source"""
SHAKEN = rf"""l AS ({BUNDLED}), p AS (SELECT repo, path, length(repo) % 3 AS kind FROM ({MANIFEST})),
    x AS (SELECT repo, path, CAST(NULL AS INT) AS line, 'no-side-effects' AS rule_id FROM p WHERE kind = 1 UNION ALL SELECT repo, path, NULL, 'no-esm' FROM p WHERE kind = 0
        UNION ALL SELECT repo, path, line_no, 'export-all' FROM l WHERE path LIKE '%/index.ts' AND regexp_matches(text, 'export\s+\*\s+from')
        UNION ALL SELECT repo, path, line_no, 'whole-library' FROM l WHERE path LIKE '%.ts' AND regexp_matches(text, 'import\s+_?\s+from\s+"lodash"')
        UNION ALL SELECT repo, path, line_no, 'namespace-import' FROM l WHERE path LIKE '%.ts' AND regexp_matches(text, 'import\s+\*\s+as\s+\w+\s+from')
        UNION ALL SELECT repo, NULL, NULL, 'many-barrels' FROM (SELECT repo, path FROM l WHERE path LIKE '%/index.ts' AND trim(text) <> '' GROUP BY ALL HAVING bool_and(starts_with(text, 'export '))) GROUP BY repo HAVING count(*) > 5)"""


def shaken(s):
    for name in ("code_line", "documents"):
        s.view(name).createOrReplaceTempView(name)
    return P.tree_shaking(s.spark.sql(BUNDLED), s.spark.sql(MANIFEST))


@query("r20_tree_shaking_packages", "code_line", f"WITH {SHAKEN} SELECT *, CASE rule_id WHEN 'many-barrels' THEN 'info' ELSE 'warning' END AS severity FROM x")
def _(s):
    return shaken(s)


@query("r20_tree_shaking_score", "code_line", f"WITH {SHAKEN}, n AS (SELECT repo, count(*) FILTER (rule_id LIKE 'no-%') + least(5, count(*) FILTER (rule_id = 'export-all')) + least(10, count(*) FILTER (rule_id IN ('whole-library', 'namespace-import'))) AS warnings, count(*) FILTER (rule_id = 'many-barrels') AS notices FROM x GROUP BY repo) SELECT *, greatest(0, 100 - warnings * 10 - notices * 3) AS score FROM n")
def _(s):
    return P.tree_shaking_score(shaken(s))
