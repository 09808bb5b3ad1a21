"""Declared and locked packages, licences, coverage and test outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import grade, js_round, major
from lintlake.operators.scratch import deal

#: Node modules that need no declaration (fixed values).
BUILTIN = ["assert", "buffer", "child_process", "crypto", "events", "fs", "http", "https", "net", "os", "path", "process", "stream", "url", "util", "zlib"]


def read_manifests(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for each declared dependency of a package manifest: repo, package, range, scope. Broken JSON gives none."""
    parsed = df.withColumn("m", F.from_json(F.col(content), "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>"))
    each = lambda field, scope: parsed.select("repo", F.explode(F.col(f"m.{field}")).alias("package", "range"), F.lit(scope).alias("scope"))
    return each("dependencies", "prod").unionByName(each("devDependencies", "dev"))


def read_lockfiles(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for each locked package of a `packages` lockfile; the first path of a name wins."""
    entry = "STRUCT<version:STRING,license:STRING,dev:BOOLEAN,optional:BOOLEAN>"
    parsed = df.select("repo", F.explode(F.from_json(F.col(content), f"packages MAP<STRING,{entry}>")["packages"]).alias("path", "entry")).where("path <> ''")
    named = parsed.withColumn("name", F.regexp_replace("path", "^.*node_modules/", ""))
    first = W.partitionBy("repo", "name").orderBy("path")
    return named.withColumn("n", F.row_number().over(first)).where("n = 1").select("repo", "name", "path", "entry.version", "entry.license", F.coalesce("entry.dev", F.lit(False)).alias("dev"))


def _without(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """left without the pairs of right. rows: of how many rows both are made, by which they are dealt out to tasks; 0 leaves that to Spark."""
    pair = ["project", "package"]
    sides = [left, right.select(*pair)]
    if rows:
        sides = [deal(side, rows, *pair, each=1 << 18) for side in sides]
    return sides[0].join(sides[1], pair, "left_anti")


def unused_deps(declared: DataFrame, imported: DataFrame, rows: int = 0) -> DataFrame:
    return _without(declared, imported, rows)


def phantom_deps(imported: DataFrame, declared: DataFrame, rows: int = 0) -> DataFrame:
    own = imported.where(~F.col("package").cast("string").isin(BUILTIN)).select("project", "package")
    return _without(own, declared, rows).distinct()


def version_mismatch(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared packages that the lock lacks, or locks at another major version."""
    j = declared.join(locked, ["project", "package"], "left")
    state = F.when(F.col("version").isNull(), "missing").when(major(F.col("version")) != major(F.col("range_text")), "mismatch")
    return j.withColumn("state", state).where("state IS NOT NULL").select("project", "package", "range_text", "version", "state")


def multi_version(locked: DataFrame) -> DataFrame:
    """Packages locked at more than one major version across projects."""
    n = locked.groupBy("package").agg(F.array_join(F.transform(F.array_sort(F.collect_set("major_no")), lambda x: x.cast("string")), ",").alias("majors"), F.countDistinct("major_no").alias("n"))
    return n.where("n > 1")


def license_tiers(packages: DataFrame) -> DataFrame:
    return packages.groupBy("tier").agg(F.count_if("is_direct").alias("direct"), F.count_if(~F.col("is_direct")).alias("transitive"))


def license_compat(packages: DataFrame, matrix: DataFrame) -> DataFrame:
    """What is not compatible with the project's licence; pairs that the matrix lacks need a check."""
    j = packages.join(F.broadcast(matrix), ["project_license", "license"], "left")
    return j.withColumn("verdict", F.coalesce("verdict", F.lit("check-required"))).where("verdict <> 'compatible'")


def ip_score(markers: DataFrame, tiers: DataFrame) -> DataFrame:
    """Score and grade of each project from its markers and its packages' risk tiers."""
    m = markers.groupBy("project").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))
    t = tiers.groupBy("project").agg(F.count_if(F.col("tier") == "strong-copyleft").alias("strong"), F.count_if(F.col("tier") == "restrictive").alias("restrictive"), F.count_if(F.col("tier") == "weak-copyleft").alias("weak"))
    j = m.join(t, "project", "full").fillna(0)
    lost = F.col("critical") * 15 + F.col("warning") * 5 + F.least(F.col("strong") * 10, F.lit(30)) + F.least(F.col("restrictive") * 8, F.lit(24)) + F.least(F.col("weak") * 2, F.lit(10))
    out = j.select("project", F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"))
    return out.withColumn("grade", grade(F.col("score"), [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F"))


def heavy_packages(declared: DataFrame, heavy: DataFrame, most: int = 50) -> DataFrame:
    """Declared packages of the list with an alternative, and projects that declare too many."""
    named = declared.join(F.broadcast(heavy), "package").select("project", "package", "alternative")
    many = declared.groupBy("project").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return named.unionByName(many.select("project", F.lit(None).cast("long").alias("package"), F.lit("split").alias("alternative")))


def migrations(declared: DataFrame, options: DataFrame) -> DataFrame:
    """Packages to be replaced, unless the replacement is there already."""
    j = declared.join(F.broadcast(options), "package")
    there = declared.select("project", F.col("package").alias("replacement"))
    return j.join(there, ["project", "replacement"], "left_anti").select("project", "package", "replacement")


def compliance_gate(checks: DataFrame) -> DataFrame:
    """Projects with how many checks fail, and whether all pass. checks: project, check, ok."""
    return checks.groupBy("project").agg(F.count_if(~F.col("ok")).alias("failed"), F.bool_and("ok").alias("passed"))


def coverage_gaps(coverage: DataFrame, thresholds: DataFrame) -> DataFrame:
    return coverage.join(F.broadcast(thresholds), "metric").where("pct < least").withColumn("gap", F.col("least") - F.col("pct"))


def flaky_tests(runs: DataFrame) -> DataFrame:
    """Tests that both passed and failed, with their failure rate in per cent."""
    n = runs.groupBy("test").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed")).where("passed > 0 AND failed > 0")
    return n.withColumn("rate", js_round(F.col("failed") * 100 / (F.col("passed") + F.col("failed"))))


def advisory_summary(advisories: DataFrame) -> DataFrame:
    """Advisories of each project by severity, what can be fixed, and a score."""
    n = advisories.groupBy("project").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "moderate", "low")], F.count_if("fixable").alias("fixable"))
    return n.withColumn("score", F.greatest(F.lit(0), 100 - 25 * F.col("critical") - 15 * F.col("high") - 5 * F.col("moderate") - F.col("low")))


# ---------------------------------------------------------------- sinks


def to_sarif(findings: DataFrame, tool: str = "lintlake") -> DataFrame:
    """One SARIF 2.1.0 document for each repo. Findings of one repo make one document, so they meet in one row."""
    level = F.when(F.col("severity").isin("critical", "error"), "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    region = F.struct(F.col("line").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.col("finding_id").alias("rank"))
    runs = findings.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(F.col("finding_id").alias("k"), result.alias("r")))).alias("each"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.transform("each", lambda x: x["r"]).alias("results"))).alias("runs"))
    return runs.select("repo", F.to_json(document).alias("sarif"))


def _serial(*parts: Column) -> Column:
    return F.concat(F.lit("urn:lintlake:"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32)))


def to_cyclonedx(components: DataFrame) -> DataFrame:
    """One CycloneDX 1.5 document for each project. components: project, name, version, license."""
    part = F.struct(F.lit("library").alias("type"), "name", "version", F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version").alias("purl"), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))).alias("licenses"))
    each = components.groupBy("project").agg(F.array_sort(F.collect_list(part)).alias("components"))
    document = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), _serial(F.col("project").cast("string"), F.size("components").cast("string")).alias("serialNumber"), F.lit(1).alias("version"), "components")
    return each.select("project", F.size("components").cast("long").alias("n_components"), F.to_json(document).alias("bom"))


def to_spdx(components: DataFrame) -> DataFrame:
    """One SPDX 2.3 document for each project, with DESCRIBES, DEPENDENCY_OF and DEV_DEPENDENCY_OF relations. components: also dev."""
    name = F.concat(F.lit("SPDXRef-"), "name")
    package = F.struct(name.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.col("license").alias("licenseDeclared"))
    relation = F.struct(name.alias("spdxElementId"), F.when(F.col("dev"), "DEV_DEPENDENCY_OF").otherwise("DEPENDENCY_OF").alias("relationshipType"), F.lit("SPDXRef-root").alias("relatedSpdxElement"))
    each = components.groupBy("project").agg(F.array_sort(F.collect_list(package)).alias("packages"), F.array_sort(F.collect_list(relation)).alias("dependencies"))
    root = F.array(F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.lit("SPDXRef-root").alias("relatedSpdxElement")))
    document = F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), "packages", F.concat(root, F.col("dependencies")).alias("relationships"))
    return each.select("project", F.size("packages").cast("long").alias("n_packages"), F.to_json(document).alias("spdx"))


#: Source files, and those among them that stand for their folder.
SCRIPTS = r"\.(ts|tsx|js|jsx|mjs)$"
INDEX = r"(^|/)index\.(ts|tsx|js|jsx|mjs)$"


def tree_shaking(lines: DataFrame, manifests: DataFrame) -> DataFrame:
    """What keeps a bundler from leaving code out: repo, path, line, rule_id, severity. Rows of packages and barrels have no line.

    Of a package: no sideEffects field; none of module, exports and type 'module'. Of sources: `export * from` in an index file, a whole
    lodash, a namespace import (but of react). 'many-barrels' tells of over five index files whose lines that are not blank are all
    exports. lines: repo, path, line_no, text; manifests: repo, path, content (JSON; what is no JSON has no fields).
    """
    text, field = F.col("text"), lambda name: F.get_json_object("content", f"$.{name}")
    truthy = lambda c: F.coalesce(~c.isin("", "false", "0"), F.lit(False))
    esm = truthy(field("module")) | truthy(field("exports")) | F.coalesce(field("type") == "module", F.lit(False))
    told = F.array(F.when(field("sideEffects").isNull(), F.lit("no-side-effects")), F.when(~esm, F.lit("no-esm")))
    of_package = manifests.select("repo", "path", F.lit(None).cast("int").alias("line"), F.explode(F.array_compact(told)).alias("rule_id"))
    index = F.col("path").rlike(INDEX)
    whole = text.rlike(r"require\(\s*['\"]lodash['\"]\s*\)") | text.rlike(r"import\s+_?\s+from\s+['\"]lodash['\"]")
    space = text.rlike(r"import\s+\*\s+as\s+\w+\s+from") & ~text.rlike(r"from\s+['\"]react['\"]")
    marks = F.array(F.when(index & text.rlike(r"export\s+\*\s+from"), F.lit("export-all")), F.when(whole, F.lit("whole-library")), F.when(space, F.lit("namespace-import")))
    sources = lines.where(F.col("path").rlike(SCRIPTS))
    of_lines = sources.select("repo", "path", F.col("line_no").cast("int").alias("line"), F.explode(F.array_compact(marks)).alias("rule_id"))
    said = F.trim(F.regexp_replace(text, r"\s", " "))
    files = sources.where(index & (said != "")).groupBy("repo", "path").agg(F.bool_and(said.rlike("^export ")).alias("barrel"))
    many = files.groupBy("repo").agg(F.count_if("barrel").alias("n")).where("n > 5")
    of_barrels = many.select("repo", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit("many-barrels").alias("rule_id"))
    found = of_package.unionByName(of_lines).unionByName(of_barrels)
    return found.withColumn("severity", F.when(F.col("rule_id") == "many-barrels", "info").otherwise("warning"))


def tree_shaking_score(found: DataFrame) -> DataFrame:
    """Each repo with findings: 100 less 10 a warning and 3 a notice, not below 0; at most 5 `export-all` and 10 imports count."""
    n = lambda *rules: F.count_if(F.col("rule_id").isin(*rules))
    warnings = n("no-side-effects", "no-esm") + F.least(n("export-all"), F.lit(5)) + F.least(n("whole-library", "namespace-import"), F.lit(10))
    counts = found.groupBy("repo").agg(warnings.alias("warnings"), n("many-barrels").alias("notices"))
    return counts.withColumn("score", F.greatest(F.lit(0), 100 - F.col("warnings") * 10 - F.col("notices") * 3).cast("long"))
