"""Catalog rules, policies on findings, imports, branches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import branch_slug, grade, js_round
from lintlake.operators import audit as A
from lintlake.operators import catalog as C
from lintlake.operators import filters as X
from lintlake.operators import findings as O
from lintlake.operators import graph as G
from lintlake.operators import history as H
from lintlake.operators import rules as R
from lintlake.operators import scan
from lintlake.operators.span_rules import BRACKETS
from lintlake.plans.base import NEEDS, VIEWS, literal, query, values
from lintlake.plans.blocks import LEXED
from lintlake.plans.findings import LEVEL, POLICIES, POLICY_SQL
from lintlake.plans.scans import pack
from lintlake.sources import parse_blame

CATALOG_HIT = pack(C.LINE_RULES, skip=C.COMMENT)
FAMILIES = values(C.FAMILIES, "family, rules, category, quality")


def listed(groups: dict[str, str], otherwise: str) -> str:
    """CASE over a rule's id: the group that lists it."""
    return "CASE " + " ".join(f"WHEN list_contains(string_split('{ids}', ' '), rule_id) THEN '{group}'" for group, ids in groups.items()) + f" ELSE '{otherwise}' END"


CATALOG = f"""f AS ({FAMILIES}), i AS (SELECT family || '-' || lpad(CAST(unnest(range(1, rules + 1)) AS VARCHAR), 3, '0') AS rule_id, category FROM f),
    c AS (SELECT *, {listed(C.ENGINES, "ast")} AS engine, {listed(C.ACTIONS, "review")} AS action, {listed({"ai": C.FOR_MODELS}, "both")} AS source FROM i)"""


def pairs(rules: list[C.Pair]) -> str:
    """Twin CTEs: first and second, the lines that match either pattern of each rule."""
    rows = values([tuple(r) for r in rules], "rule_id, severity, a, b")
    first = f"SELECT repo, path, line_no AS line, rule_id, severity FROM script_line JOIN r ON regexp_matches(text, a) WHERE NOT regexp_matches(text, {literal(C.COMMENT)})"
    return f"r AS ({rows}), first AS ({first}), second AS (SELECT repo, path, line_no AS line, rule_id FROM script_line JOIN r ON regexp_matches(text, b))"


@query("r32_scan_catalog_files", "script_line", f"WITH {pairs(C.FILE_RULES)} SELECT repo, path, line, rule_id, severity FROM first WHERE NOT EXISTS (SELECT 1 FROM second WHERE second.repo = first.repo AND second.path = first.path AND second.rule_id = first.rule_id)")
def _(s):
    return C.scan_files(s.view("script_line"))


#: Both fixtures of code, in files of their own.
VIEWS["next_line"] = "SELECT repo, path, line_no, text FROM code_line UNION ALL SELECT repo, 'script/' || path AS path, line_no, text FROM script_line"
NEEDS["next_line"] = ("code_line", "script_line")


@query("r32_scan_catalog_next", "code_line script_line next_line", f"WITH {pairs(C.NEXT_RULES).replace('script_line', 'next_line')} SELECT first.* FROM first JOIN second ON second.repo = first.repo AND second.path = first.path AND second.rule_id = first.rule_id AND second.line = first.line + 1")
def _(s):
    return C.scan_next(s.view("next_line"))


@query(
    "r32_scan_catalog_totals",
    "code_line",
    LEXED.replace("block_line", "code_line").join(("WITH ", "")) + r""", n AS (SELECT repo, path, string_agg(text, '') AS whole, count(*) AS lines, sum(CAST(regexp_matches(text, '^\s*(?:export\s+)?interface\s+\w') AS INT)) AS interfaces, sum(CAST(regexp_matches(text, '^\s*(?:export\s+)?type\s+\w+\s*=') AS INT)) AS types FROM code_line GROUP BY repo, path),
    m AS (SELECT *, least(len(whole) - len(replace(whole, chr(39), '')), len(whole) - len(replace(whole, chr(34), ''))) AS q, least(interfaces, types) AS t FROM n)
    SELECT repo, path, 'CMX-004' AS rule_id, lines AS amount FROM m WHERE lines > 1000 UNION ALL SELECT repo, path, 'STL-009', CAST(q AS BIGINT) FROM m WHERE q > 0 UNION ALL SELECT repo, path, 'TYP-011', CAST(t AS BIGINT) FROM m WHERE t > 0"""
    + "".join(f" UNION ALL SELECT repo, path, '{rule}', CAST(abs(sum(len(replace(code, '{b}', '')) - len(replace(code, '{a}', '')))) AS BIGINT) FROM lexed_line GROUP BY repo, path HAVING sum(len(replace(code, '{b}', '')) - len(replace(code, '{a}', ''))) <> 0" for rule, a, b in BRACKETS),
)
def _(s):
    return C.scan_totals(s.view("code_line"))


@query("r32_scan_catalog", "code_line", f"WITH {CATALOG_HIT}, c AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line, place) AS n FROM hit) SELECT repo, path, line, rule_id, severity FROM c WHERE n <= 80")
def _(s):
    return C.scan_catalog(s.view("code_line"))


@query("r32_scan_catalog_security", "code_line", f"WITH {CATALOG_HIT} SELECT repo, path, line, rule_id, severity FROM hit WHERE rule_id LIKE 'SEC%' OR rule_id LIKE 'API%'")
def _(s):
    return C.scan_catalog(s.view("code_line"), ["SEC", "API"])


@query("s08_rule_catalog", "findings", f"WITH f AS ({FAMILIES}) SELECT finding_id, category, quality FROM findings JOIN f ON family = split_part(rule_id, '-', 1)")
def _(s):
    return s.view("findings").join(F.broadcast(C.rule_catalog(s.spark)), "rule_id").select("finding_id", "category", "quality")


@query("p11_select_rules", "findings", f"WITH {CATALOG} SELECT rule_id, count(*) AS n FROM findings JOIN c USING (rule_id) WHERE engine = 'ast' AND action = 'review' AND source = 'both' AND category <> 'syntax' GROUP BY rule_id")
def _(s):
    chosen = C.select_rules(C.rule_catalog(s.spark), engine="ast", action="review", source="both").where("category <> 'syntax'")
    return s.view("findings").join(F.broadcast(chosen), "rule_id", "left_semi").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("a42_catalog_stats", "findings", f"WITH {CATALOG}, n AS (SELECT rule_id, count(*) AS findings FROM findings GROUP BY 1) SELECT category, engine, action, count(*) AS rules, CAST(sum(coalesce(findings, 0)) AS BIGINT) AS findings FROM c LEFT JOIN n USING (rule_id) GROUP BY GROUPING SETS ((category), (engine), (action), ())")
def _(s):
    return C.catalog_stats(C.rule_catalog(s.spark), s.view("findings"))


GOOD_ROWS = values([(g, q, p) for g, q, p, _ in X.GOOD], "good_id, quality, pattern")


@query("a41_good_pattern_coverage", "code_line", f"WITH g AS ({GOOD_ROWS}), d AS (SELECT DISTINCT repo, path, good_id, quality FROM code_line JOIN g ON regexp_matches(text, pattern)) SELECT repo, quality, count(*) AS n, string_agg(DISTINCT good_id, ',' ORDER BY good_id) AS ids FROM d GROUP BY repo, quality")
def _(s):
    quality = F.create_map(*[F.lit(x) for g, q, _, _ in X.GOOD for x in (g, q)])
    good = X.detect_good_patterns(s.view("code_line")).withColumn("quality", quality[F.col("good_id")])
    return good.groupBy("repo", "quality").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("good_id")), ",").alias("ids"))


HIT = pack(R.SURFACE)
RESOLVED = f"""p AS ({POLICY_SQL}), t AS (SELECT DISTINCT repo, path, rule_id FROM hit), z AS (SELECT repo, path, t.rule_id, scope, action, row_number() OVER (PARTITION BY repo, path, t.rule_id ORDER BY CASE scope WHEN 'global' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END, len(prefix) DESC, action) AS n FROM t JOIN p ON p.rule_id = t.rule_id AND (scope = 'global' OR starts_with(path, prefix))),
    x AS (SELECT repo, path, line_no + 1 AS line, regexp_extract(text, '//\\s*quality-disable-next-line\\s+(\\S+)', 1) AS rule FROM code_line WHERE regexp_matches(text, '//\\s*quality-disable-next-line\\s+\\S'))"""


@query("j06_effective_rules", "code_line", f"WITH p AS ({POLICY_SQL}), f AS (SELECT DISTINCT repo, path FROM code_line), c AS (SELECT repo, path, rule_id, action, row_number() OVER (PARTITION BY repo, path, rule_id ORDER BY CASE scope WHEN 'global' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END, len(prefix) DESC, action) AS n FROM f JOIN p ON scope = 'global' OR starts_with(path, prefix)) SELECT repo, path, rule_id, action FROM c WHERE n = 1")
def _(s):
    policies = s.spark.createDataFrame(POLICIES, "rule_id string, scope string, prefix string, action string")
    rules = policies.select(F.collect_set("rule_id").alias("rules")).first()["rules"]
    targets = s.view("code_line").select("repo", "path").distinct().withColumn("rule_id", F.explode(F.array(*map(F.lit, sorted(rules)))))
    return O.resolve_policy(targets, policies).select("repo", "path", "rule_id", "action")


@query("j07_apply_scoped", "code_line", f"WITH {HIT}, {RESOLVED}, m AS (SELECT h.repo, h.path, h.line, h.rule_id, z.action, z.scope, x.rule IS NOT NULL AS hushed FROM hit h LEFT JOIN z ON z.n = 1 AND z.repo = h.repo AND z.path = h.path AND z.rule_id = h.rule_id LEFT JOIN x ON x.repo = h.repo AND x.path = h.path AND x.line = h.line AND x.rule IN (h.rule_id, '*')), o AS (SELECT repo, coalesce(action = 'enforce' AND scope IN ('global', 'workspace'), false) AS enforced, coalesce(action = 'off', false) AS off, hushed FROM m) SELECT repo, count(*) FILTER (WHERE enforced OR (NOT off AND NOT hushed)) AS kept, count(*) FILTER (WHERE NOT enforced AND (off OR hushed)) AS suppressed, count(*) FILTER (WHERE enforced AND hushed) AS overridden FROM o GROUP BY repo")
def _(s):
    lines = s.view("code_line")
    f = scan.scan_rules(lines, R.SURFACE).select("repo", "path", "line", "rule_id")
    policies = s.spark.createDataFrame(POLICIES, "rule_id string, scope string, prefix string, action string")
    resolved = O.resolve_policy(f.select("repo", "path", "rule_id").distinct(), policies)
    left = O.apply_suppressions(f, lines).withColumn("heard", F.lit(True))
    j = f.join(resolved, ["repo", "path", "rule_id"], "left").join(left, ["repo", "path", "line", "rule_id"], "left")
    enforced = F.coalesce((F.col("action") == "enforce") & F.col("scope").isin("global", "workspace"), F.lit(False))
    off, hushed = F.coalesce(F.col("action") == "off", F.lit(False)), F.col("heard").isNull()
    return j.groupBy("repo").agg(F.count_if(enforced | (~off & ~hushed)).alias("kept"), F.count_if(~enforced & (off | hushed)).alias("suppressed"), F.count_if(enforced & hushed).alias("overridden"))


@query("j12_resolve_imports", "", "WITH f AS (SELECT source AS repo, 'src/' || lang || '/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '/index.ts' END AS path, doc_id, lang FROM documents) SELECT a.repo, a.path, CASE WHEN a.doc_id % 2 = 0 THEN './f' ELSE '../f' END || b.doc_id AS specifier, b.path AS target FROM f a JOIN f b ON b.repo = a.repo AND b.lang = a.lang AND b.doc_id = a.doc_id + 40")
def _(s):
    end = F.when(F.col("doc_id") % 2 == 0, ".ts").otherwise("/index.ts")
    files = s.table("documents").select(F.col("source").alias("repo"), F.concat(F.lit("src/"), "lang", F.lit("/f"), "doc_id", end).alias("path"), "doc_id")
    up = F.when(F.col("doc_id") % 2 == 0, "./f").otherwise("../f")
    imports = files.select("repo", "path", F.concat(up, (F.col("doc_id") + 40).cast("string")).alias("specifier"))
    return G.resolve_imports(imports, files)


@query("j15_cross_file_null", "code_line", r"WITH e AS (SELECT repo, path, regexp_extract(text, 'export\s+function\s+(\w+)', 1) AS name FROM code_line), n AS (SELECT DISTINCT repo, path FROM code_line WHERE regexp_matches(text, 'return null')), x AS (SELECT DISTINCT e.repo, e.path, name FROM e JOIN n USING (repo, path) WHERE name <> ''), c AS (SELECT repo, path, line_no, unnest(regexp_extract_all(text, '(\w+)\(', 1)) AS name FROM code_line) SELECT c.repo, c.path, c.line_no AS line, c.name, count(DISTINCT x.path) AS definitions FROM c JOIN x ON x.repo = c.repo AND x.name = c.name AND x.path <> c.path GROUP BY ALL")
def _(s):
    lines = s.view("code_line")
    nullable = lines.where(F.col("text").rlike("return null")).select("repo", "path").distinct()
    exported = lines.select("repo", "path", F.regexp_extract("text", r"export\s+function\s+(\w+)", 1).alias("name")).where("name <> ''").join(nullable, ["repo", "path"], "left_semi").distinct()
    calls = lines.select("repo", "path", F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\("), 1)).alias("name"))
    # definitions are counted by repo and name first, so a popular name meets each call once
    total = exported.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("all"))
    own = exported.select("repo", "path", "name", F.lit(1).alias("own"))
    j = calls.distinct().join(total, ["repo", "name"]).join(own, ["repo", "path", "name"], "left").withColumn("definitions", F.col("all") - F.coalesce("own", F.lit(0)))
    return j.where("definitions > 0").select("repo", "path", "line", "name", "definitions")


@query("j32_validate_dismissals", "code_line", f"WITH {HIT}, t AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line, rule_id) AS n FROM hit), c AS (SELECT t.repo, t.path, t.line, t.rule_id, string_agg(l.text, chr(10) ORDER BY l.line_no) AS ctx FROM t JOIN code_line l ON l.repo = t.repo AND l.path = t.path AND l.line_no BETWEEN t.line - 3 AND t.line + 3 WHERE n <= 10 GROUP BY ALL) SELECT repo, path, line, rule_id, CASE WHEN regexp_matches(ctx, 'cleanup|TODO') THEN 'fp' WHEN regexp_matches(ctx, 'userInput|password') THEN 'tp' ELSE 'open' END AS verdict FROM c")
def _(s):
    f = scan.cap(scan.scan_rules(s.view("code_line"), R.SURFACE).select("repo", "path", "line", "rule_id"), ["repo", "path"], ["line", "rule_id"], 10)
    near = O.with_context(f, s.view("code_line"), 3)
    return near.select("repo", "path", "line", "rule_id", F.when(F.col("context").rlike("cleanup|TODO"), "fp").when(F.col("context").rlike("userInput|password"), "tp").otherwise("open").alias("verdict"))


@query("a04_repo_verdict", "findings", f"WITH l AS (SELECT repo, file, {LEVEL} AS level FROM findings WHERE finding_id % 6 <> 0), n AS (SELECT repo, count(*) FILTER (WHERE level = 'hard-fail') AS hard, count(*) FILTER (WHERE level = 'review-required') AS review, count(DISTINCT file) AS files FROM l GROUP BY repo), d AS (SELECT repo, count(*) FILTER (WHERE finding_id % 6 = 0) AS dismissed FROM findings GROUP BY repo) SELECT repo, CASE WHEN hard > 0 THEN 'fail' WHEN review > 5 THEN 'review' ELSE 'pass' END AS verdict, CAST(CASE WHEN hard > 0 THEN greatest(0, 50 - hard * 5) WHEN review > 5 THEN least(100, greatest(60, 100 - least(30, floor(review / files * 1.5 + 0.5))) + least(15, floor(dismissed / (review + dismissed) * 15 + 0.5))) ELSE 100 END AS BIGINT) AS score FROM n JOIN d USING (repo)")
def _(s):
    f = s.view("findings")
    level = O.classify_level(F.col("severity"), F.col("rule_id"), F.col("confidence"))
    n = f.where("finding_id % 6 <> 0").groupBy("repo").agg(F.count_if(level == "hard-fail").alias("hard"), F.count_if(level == "review-required").alias("review"), F.countDistinct("file").alias("files"))
    d = f.groupBy("repo").agg(F.count_if(F.col("finding_id") % 6 == 0).alias("dismissed"))
    penalty = F.least(F.lit(30), js_round(F.col("review") / F.col("files") * 1.5))
    bonus = F.least(F.lit(15), js_round(F.col("dismissed") / (F.col("review") + F.col("dismissed")) * 15))
    score = F.when(F.col("hard") > 0, F.greatest(F.lit(0), 50 - F.col("hard") * 5)).when(F.col("review") > 5, F.least(F.lit(100), F.greatest(F.lit(60), 100 - penalty) + bonus)).otherwise(100)
    return n.join(d, "repo").select("repo", F.when(F.col("hard") > 0, "fail").when(F.col("review") > 5, "review").otherwise("pass").alias("verdict"), score.cast("long").alias("score"))


AREAS = "SELECT repo, CAST(greatest(0, 100 - count(*) FILTER (WHERE severity = 'critical' AND rule_id LIKE 'SEC%') * 2) AS BIGINT) AS security, CAST(greatest(0, 100 - count(*) FILTER (WHERE severity = 'error')) AS BIGINT) AS errors, CAST(greatest(0, 100 - count(DISTINCT file)) AS BIGINT) AS spread, CAST(greatest(0, 100 - count(*) FILTER (WHERE rule_id LIKE 'STL%')) AS BIGINT) AS style FROM findings GROUP BY repo"


#: Each path is a project of its own here; amounts are counts of lines by a pattern.
AMOUNTS = {"deep": r"NaN\b", "syntax": r"\bany\[\]", "deprecated": r"Buffer|\.getTime\(", "critical": r"\beval\(", "high": r"innerHTML"}
AUDIT_SQL = f"""p AS (SELECT path AS repo, count(*) AS lines, {" + ".join(f"max(CAST(regexp_matches(text, {literal(x)}) AS INT))" for x in A.SECRETS)} AS secrets,
    sum(len(regexp_extract_all(text, {literal(r":\s*any\b")}))) AS anys, sum(len(regexp_extract_all(text, {literal(r"catch\s*\(\s*\)\s*\{")}))) AS empty,
    CAST(count(*) FILTER (WHERE regexp_matches(text, {literal(r";\s*$")})) > 5 AND count(*) FILTER (WHERE regexp_matches(text, {literal(r"[^;{}\s]\s*$")})) > 5 AS INT) AS mixed,
    {", ".join(f"count(*) FILTER (WHERE regexp_matches(text, {literal(x)})) AS {n}" for n, x in AMOUNTS.items())}, count(*) FILTER (WHERE starts_with(text, 'import ')) AS used,
    count(*) FILTER (WHERE starts_with(text, '//')) AS lint FROM code_line GROUP BY path),
    a AS (SELECT repo, unnest([
    {{'area': 'structure', 'category': 'structure', 'score': CASE WHEN lines < 300 THEN 90 WHEN lines < 500 THEN 70 ELSE 50 END}}, {{'area': 'tests', 'category': 'quality', 'score': CASE WHEN regexp_matches(repo, '(?i)test|spec') THEN 70 ELSE 20 END}},
    {{'area': 'security', 'category': 'security', 'score': CASE WHEN secrets = 0 THEN 95 ELSE greatest(0, 70 - 15 * secrets) END}}, {{'area': 'dependencies', 'category': 'performance', 'score': CASE WHEN used < 30 THEN 90 ELSE 70 END}},
    {{'area': 'types', 'category': 'quality', 'score': CASE WHEN anys = 0 THEN 95 ELSE greatest(0, 85 - 3 * anys) END}}, {{'area': 'errors', 'category': 'quality', 'score': CASE WHEN empty < 3 THEN 85 ELSE greatest(0, 75 - 5 * empty) END}},
    {{'area': 'documents', 'category': 'structure', 'score': CASE WHEN used > 0 THEN 30 ELSE 10 END}}, {{'area': 'style', 'category': 'quality', 'score': CASE WHEN mixed < 2 THEN 90 ELSE 60 END}},
    {{'area': 'lint', 'category': 'quality', 'score': 100 - lint}}, {{'area': 'unused', 'category': 'performance', 'score': 80}}, {{'area': 'deep', 'category': 'quality', 'score': greatest(0, 100 - 25 * deep)}},
    {{'area': 'advisories', 'category': 'security', 'score': greatest(0, 100 - 30 * critical - 15 * high)}}, {{'area': 'accessibility', 'category': 'quality', 'score': lines}}, {{'area': 'syntax', 'category': 'quality', 'score': greatest(0, 100 - 10 * syntax)}},
    {{'area': 'deprecated', 'category': 'quality', 'score': greatest(0, 100 - 15 * deprecated)}}, {{'area': 'bundle', 'category': 'performance', 'score': 100 - used}}], recursive := true) FROM p)"""


def audit(s):
    lines = s.view("code_line").withColumn("repo", F.col("path"))
    text = F.col("text")
    n = lines.groupBy("repo").agg(F.count(F.lit(1)).alias("lines"), F.count_if(text.startswith("import ")).alias("used"), (100 - F.count_if(text.startswith("//"))).alias("lint"), *[F.count_if(text.rlike(p)).alias(k) for k, p in AMOUNTS.items()])
    amounts = {"dependencies": F.col("used"), "lint": F.col("lint"), "accessibility": F.col("lines"), "bundle": 100 - F.col("used")} | {k: F.col(k) for k in ("deep", "syntax", "deprecated")}
    return A.project_audit(lines, {k: n.select("repo", v.alias("amount")) for k, v in amounts.items()} | {"advisories": n.select("repo", "critical", "high")})


@query("a11_project_audit", "code_line", f"WITH {AUDIT_SQL} SELECT repo, area, category, CAST(score AS BIGINT) AS score FROM a")
def _(s):
    return audit(s)


@query("a11_audit_summary", "code_line", f"WITH {AUDIT_SQL} SELECT repo, CAST(floor(avg(score) + 0.5) AS BIGINT) AS score, bool_or(category = 'security' AND score < 50) AS stopped FROM a GROUP BY repo")
def _(s):
    return A.audit_summary(audit(s))


@query("a11_finding_areas", "findings", f"WITH a AS ({AREAS}) UNPIVOT a ON security, errors, spread, style INTO NAME area VALUE score".replace("WITH a AS", "SELECT * FROM (WITH a AS").replace(") UNPIVOT", ") SELECT * FROM (UNPIVOT") + "))")
def _(s):
    part = lambda test: F.greatest(F.lit(0), 100 - F.count_if(test)).cast("long")
    areas = s.view("findings").groupBy("repo").agg(
        F.greatest(F.lit(0), 100 - 2 * F.count_if((F.col("severity") == "critical") & F.col("rule_id").startswith("SEC"))).cast("long").alias("security"),
        part(F.col("severity") == "error").alias("errors"),
        F.greatest(F.lit(0), 100 - F.countDistinct("file")).cast("long").alias("spread"),
        part(F.col("rule_id").startswith("STL")).alias("style"),
    )
    return areas.unpivot(["repo"], ["security", "errors", "spread", "style"], "area", "score")


BRANCHES = "SELECT user_id AS repo, event_type AS branch, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY user_id, event_type"


@query("a30_branch_report", "", f"WITH b AS ({BRANCHES}), a AS (SELECT *, date_diff('day', last_day, DATE '2024-03-01') AS age FROM b) SELECT repo, branch, age, CASE WHEN age > 45 THEN 'error' WHEN age > 32 THEN 'warning' ELSE 'info' END AS severity FROM a")
def _(s):
    b = s.table("events").groupBy(F.col("user_id").alias("repo"), F.col("event_type").alias("branch")).agg(F.to_date(F.max("ts")).alias("last_day"))
    age = F.datediff(F.lit("2024-03-01").cast("date"), "last_day")
    return b.select("repo", "branch", age.cast("long").alias("age"), F.when(age > 45, "error").when(age > 32, "warning").otherwise("info").alias("severity"))


@query("a31_repo_health", "commits", "SELECT author % 10 AS team, count(*) AS commits, count(DISTINCT author) AS authors, max(day) AS last_day, count(*) FILTER (WHERE message LIKE 'fix%') AS fixes FROM commits GROUP BY 1")
def _(s):
    c = s.view("commits")
    return c.groupBy((F.col("author") % 10).alias("team")).agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"), F.max("day").alias("last_day"), F.count_if(F.col("message").startswith("fix")).alias("fixes"))


#: Branches of each repo: kinds of events, the commonest kind of all being the default one.
BRANCH = """SELECT user_id % 25 AS repo, event_type || CAST(user_id % 8 AS {text}) AS branch, CAST(max(ts) AS DATE) AS last_day, CAST(max(user_id) AS {text}) AS author, max(event_id) % 3 = 0 AS merged,
    CAST(count(*) % 7 AS INT) AS ahead, CAST(count(*) * 5 % 83 AS INT) AS behind, event_type = 'view' AND user_id % 8 = 0 AS is_default FROM events GROUP BY user_id % 25, event_type, user_id % 8"""
BRANCH_SQL = f"b AS ({BRANCH.format(text='VARCHAR')}), o AS (SELECT *, date_diff('day', last_day, DATE '2024-03-01') AS age FROM b)"
BRANCH_COUNTS = "SELECT repo, count(*) FILTER (NOT is_default) AS total, count(*) FILTER (NOT is_default AND age <= 30) AS active, count(*) FILTER (NOT is_default AND age > 30) AS stale, count(*) FILTER (NOT is_default AND merged) AS merged, count(*) FILTER (NOT is_default AND NOT merged) AS unmerged, count(*) FILTER (NOT is_default AND NOT merged AND behind > 50) AS drifted FROM o GROUP BY repo"


def branches(s):
    s.view("events").createOrReplaceTempView("events")
    return s.spark.sql(BRANCH.format(text="STRING"))


@query("a30_branch_ages", "", f"WITH {BRANCH_SQL} SELECT repo, branch, age, last_day, author, '+' || ahead || '/-' || behind AS distance, CASE WHEN age > 90 THEN 'error' WHEN age > 30 THEN 'warning' ELSE 'info' END AS severity FROM o WHERE age > 14 AND NOT is_default")
def _(s):
    return H.branch_ages(branches(s), "2024-03-01")


@query("a30_branch_summary", "", f"WITH {BRANCH_SQL}, n AS ({BRANCH_COUNTS}) SELECT * , concat_ws(' ', CASE WHEN merged > 3 THEN 'delete-merged' END, CASE WHEN stale > 5 THEN 'review-stale' END, CASE WHEN drifted > 0 THEN 'rebase' END) AS advice FROM n")
def _(s):
    return H.branch_summary(branches(s), "2024-03-01").withColumn("advice", F.array_join("advice", " "))


@query("a31_repo_health_score", "changes commits", f"""WITH {BRANCH_SQL}, n AS ({BRANCH_COUNTS}), c AS (SELECT author % 700 AS repo, commit_id, author, day, commit_id % 37 = 0 AS fix FROM commits),
    g AS (SELECT repo, count(*) AS commits, count(DISTINCT author) AS contributors, date_diff('day', max(day), DATE '2024-03-01') AS last_commit_age FROM c GROUP BY repo),
    f AS (SELECT repo, file, count(*) FILTER (fix) AS fixes, count(*) AS n, sum(added + deleted) AS churn FROM changes JOIN c USING (commit_id) GROUP BY ALL),
    k AS (SELECT repo, count(*) FILTER (fixes * 10 + CAST(floor(fixes * 100 / n + 0.5) AS BIGINT) > 50) AS risky_files, count(*) FILTER (churn > 58) AS restless_files FROM f GROUP BY repo)
    SELECT g.*, coalesce(risky_files, 0) AS risky_files, coalesce(restless_files, 0) AS restless_files, coalesce(stale, 0) AS stale_branches, CAST(floor((greatest(0, 100 - coalesce(risky_files, 0) * 15) + CASE WHEN restless_files > 5 THEN 60 WHEN restless_files > 2 THEN 80 ELSE 100 END) / 2 + 0.5) AS BIGINT) AS score
    FROM g LEFT JOIN k USING (repo) LEFT JOIN n USING (repo)""")
def _(s):
    message = F.when(F.col("commit_id") % 37 == 0, "fix: bug").otherwise("feat: add")
    commits = s.view("commits").withColumn("repo", F.col("author") % 700).withColumn("message", message)
    changes = s.view("changes").join(commits.select("repo", "commit_id"), "commit_id")
    return H.repo_health(commits, changes, branches(s), "2024-03-01", high=58)


#: Code lines of which some take what a function of another file returns, read it and test it.
TAKEN = "SELECT repo, path, line_no, CASE text WHEN '  cleanup();' THEN '  const got = load(a);' WHEN '}' THEN '} got.name;' WHEN 'const ok = value === NaN;' THEN 'if (!got) return;' WHEN '  eval(userInput);' THEN '  return null;' ELSE text END AS text FROM code_line"


@query("j15_unguarded_results", "code_line", rf"""WITH l AS ({TAKEN}), d AS (SELECT *, regexp_extract(text, '(?:^|\s)function\s+(\w+)', 1) AS fn FROM l),
    m AS (SELECT *, regexp_matches(text, '\breturn\s+(?:null|undefined)\b') OR (fn <> '' AND regexp_matches(text, '\b(?:null|undefined)\b')) AS said, max(CASE WHEN fn <> '' THEN line_no END) OVER (PARTITION BY repo, path ORDER BY line_no) AS at FROM d),
    x AS (SELECT DISTINCT m.repo, m.path, d.fn AS name FROM m JOIN d ON d.repo = m.repo AND d.path = m.path AND d.line_no = m.at WHERE said AND regexp_matches(d.text, '^\s*export\s')),
    c AS (SELECT repo, path, line_no AS line, regexp_extract(text, '(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(\w+)\(', 1) AS variable, regexp_extract(text, '(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(\w+)\(', 2) AS name FROM l),
    e AS (SELECT c.repo, c.path, line, variable, c.name, count(*) AS definitions FROM c JOIN x ON x.repo = c.repo AND x.name = c.name AND x.path <> c.path WHERE variable <> '' GROUP BY ALL)
    SELECT e.* FROM e JOIN l ON l.repo = e.repo AND l.path = e.path AND l.line_no BETWEEN line + 1 AND line + 10 GROUP BY ALL
    HAVING bool_or(regexp_matches(l.text, '\b' || variable || '\.\w')) AND NOT bool_or(contains(l.text, '!' || variable) OR contains(l.text, variable || '?.') OR contains(l.text, variable || ' == null') OR contains(l.text, variable || ' === null') OR contains(l.text, variable || ' === undefined'))""")
def _(s):
    s.view("code_line").createOrReplaceTempView("code_line")
    return O.cross_file_null(s.spark.sql(TAKEN))


@query("a34_fix_stats", "", "SELECT p_type AS category, count(*) AS patterns, CAST(sum(p_size) AS BIGINT) AS uses, floor(avg(p_size) * 100 + 0.5) / 100 AS mean_confidence FROM part GROUP BY p_type")
def _(s):
    return s.table("part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("patterns"), F.sum("p_size").cast("long").alias("uses"), (js_round(F.avg("p_size") * 100) / 100).alias("mean_confidence"))


@query("a50_suggestions", "runs", "WITH r AS (SELECT repo, avg(score) AS m, count(*) AS n, count(*) FILTER (WHERE status = 'fail') AS f FROM runs GROUP BY repo), s AS (SELECT repo, 'raise-score' AS suggestion, 1 AS priority FROM r WHERE m < 50 UNION ALL SELECT repo, 'fix-failures', 2 FROM r WHERE f * 2 > n UNION ALL SELECT repo, 'run-more', 3 FROM r WHERE n < 65) SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY priority) AS INT) AS place FROM s")
def _(s):
    r = s.view("runs").groupBy("repo").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "fail").alias("f"))
    each = F.array(*[F.when(t, F.struct(F.lit(name).alias("suggestion"), F.lit(k).alias("priority"))) for k, (name, t) in enumerate([("raise-score", F.col("m") < 50), ("fix-failures", F.col("f") * 2 > F.col("n")), ("run-more", F.col("n") < 65)], 1)])
    out = r.select("repo", F.inline(F.filter(each, lambda x: x.isNotNull())))
    return out.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy("priority")))


@query("r20_tree_shaking", "code_line", r"SELECT repo, path, line_no AS line, 'whole-library' AS rule_id FROM code_line WHERE regexp_matches(text, 'import\s+\w+\s+from\s+''lodash''') UNION ALL SELECT repo, path, line_no, 'export-all' FROM code_line WHERE regexp_matches(text, 'export\s+\*')")
def _(s):
    rules = [R.Rule("whole-library", "warning", r"import\s+\w+\s+from\s+'lodash'", ""), R.Rule("export-all", "info", r"export\s+\*", "")]
    return scan.scan_rules(s.view("code_line"), rules).select("repo", "path", "line", "rule_id")


#: A conflict after every third line of a document whose number leaves one with its document's, with other texts in each.
CONFLICT = """SELECT source AS repo, CAST(doc_id AS {text}) AS path, line_no, text FROM (
    SELECT repo AS source, path AS doc_id, line_no * 10 AS line_no, text FROM text_line
    UNION ALL SELECT t.repo, t.path, t.line_no * 10 + k.k, CASE k.k WHEN 1 THEN '<<<<<<< ours' WHEN 2 THEN 'our ' || t.text WHEN 3 THEN 'more' WHEN 4 THEN '=======' WHEN 5 THEN 'their ' || t.text ELSE '>>>>>>> theirs' END
    FROM text_line t, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) k
    WHERE (t.line_no + length(t.path)) % 3 = 1 AND NOT (k.k = 3 AND t.line_no % 2 = 0)) x"""


@query("r28_conflict_blocks", "text_line", f"""WITH c AS ({CONFLICT.format(text="VARCHAR")}), o AS (SELECT * FROM c WHERE text = '<<<<<<< ours'), b AS (SELECT o.repo, o.path, o.line_no AS first_line, c.line_no, c.text, c.line_no % 10 AS k FROM o JOIN c ON c.repo = o.repo AND c.path = o.path AND c.line_no > o.line_no AND c.line_no < o.line_no + 9)
    SELECT repo, path, first_line, max(line_no) AS last_line, string_agg(text, chr(10) ORDER BY line_no) FILTER (k IN (2, 3)) AS ours, string_agg(text, chr(10) ORDER BY line_no) FILTER (k = 5) AS theirs, string_agg(text, chr(10) ORDER BY line_no) FILTER (k IN (2, 3, 5)) AS both FROM b GROUP BY ALL""")
def _(s):
    s.view("text_line").createOrReplaceTempView("text_line")
    return X.conflict_blocks(s.spark.sql(CONFLICT.format(text="STRING")))



@query("s07_parse_blame", "changes", "SELECT CAST(file AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY file ORDER BY commit_id) AS INT) AS line, CAST(commit_id AS VARCHAR) AS commit_id FROM changes")
def _(s):
    nth = F.row_number().over(W.partitionBy("file").orderBy("commit_id"))
    rows = s.view("changes").select((F.col("file") % 16).alias("repo"), F.col("file").cast("string").alias("path"), nth.alias("n"), F.col("commit_id").cast("string").alias("id"))
    head = F.concat_ws(" ", "id", F.col("n").cast("string"), F.col("n").cast("string"))
    each = F.array(F.struct((F.col("n") * 3).alias("pos"), head.alias("text")), F.struct((F.col("n") * 3 + 1).alias("pos"), F.lit("author someone").alias("text")), F.struct((F.col("n") * 3 + 2).alias("pos"), F.concat(F.lit("\t"), "id").alias("text")))
    return parse_blame(rows.select("repo", "path", F.inline(each))).select("path", "line", "commit_id")


@query("s12_read_test_runs", "", "SELECT user_id AS run, event_type AS test, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'passed' END AS status, count(*) AS n FROM events GROUP BY ALL")
def _(s):
    status = F.when(F.col("event_id") % 9 == 0, "failed").otherwise("passed")
    rows = s.table("events").withColumn("status", status)
    nested = rows.where("event_id % 2 = 0").select(F.col("user_id").alias("run"), F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("event_type").alias("title"), "status")).alias("assertionResults"))).alias("testResults"))).alias("content"))
    flat = rows.where("event_id % 2 = 1").select(F.col("user_id").alias("run"), F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("name"), "status")).alias("tests"))).alias("content"))
    parsed = nested.unionByName(flat).select("run", F.from_json("content", "testResults ARRAY<STRUCT<assertionResults:ARRAY<STRUCT<title:STRING,status:STRING>>>>, tests ARRAY<STRUCT<name:STRING,status:STRING>>").alias("c"))
    a = parsed.select("run", F.explode(F.flatten("c.testResults.assertionResults")).alias("t")).select("run", F.col("t.title").alias("test"), "t.status")
    b = parsed.select("run", F.explode("c.tests").alias("t")).select("run", F.col("t.name").alias("test"), "t.status")
    return a.unionByName(b).groupBy("run", "test", "status").agg(F.count(F.lit(1)).alias("n"))


@query("w22_aggressiveness", "runs", """WITH e AS (SELECT repo, row_number() OVER w AS i, CAST(count(*) FILTER (status = 'pass') OVER w AS DOUBLE) / count(*) OVER w AS rate FROM runs WINDOW w AS (PARTITION BY repo ORDER BY ts, run_id)),
    r AS (SELECT DISTINCT repo, CAST(0 AS BIGINT) AS i, 50 AS v FROM e UNION ALL SELECT e.repo, e.i, greatest(10, least(100, v + CASE WHEN rate > 0.7 THEN 5 WHEN rate < 0.3 THEN -5 ELSE 0 END)) FROM r JOIN e ON e.repo = r.repo AND e.i = r.i + 1)
    SELECT repo, CAST(arg_max(v, i) AS INT) AS aggressiveness_hundredths FROM r GROUP BY repo""")
def _(s):
    return H.aggressiveness(s.view("runs"))


@query("f10_commit_type", "changes commits", "SELECT commit_id, CASE WHEN bool_or(file % 50 = 0) THEN 'test' WHEN bool_or(file % 51 = 0) THEN 'docs' WHEN max(message) LIKE 'fix%' THEN 'fix' WHEN sum(added) > sum(deleted) THEN 'feat' ELSE 'refactor' END AS type, 'feat/' || 'c-' || commit_id AS branch FROM changes JOIN commits USING (commit_id) GROUP BY commit_id")
def _(s):
    c = s.view("changes").join(s.view("commits"), "commit_id").groupBy("commit_id").agg(F.bool_or(F.col("file") % 50 == 0).alias("test"), F.bool_or(F.col("file") % 51 == 0).alias("docs"), F.max("message").alias("m"), F.sum("added").alias("a"), F.sum("deleted").alias("d"))
    kind = F.when(F.col("test"), "test").when(F.col("docs"), "docs").when(F.col("m").startswith("fix"), "fix").when(F.col("a") > F.col("d"), "feat").otherwise("refactor")
    return c.select("commit_id", kind.alias("type"), F.concat(F.lit("feat/"), branch_slug(F.concat(F.lit("C "), "commit_id"))).alias("branch"))


@query("f14_swap_and_rescan", "code_line", r"WITH h AS (SELECT repo, path, line_no, text FROM code_line WHERE regexp_matches(text, '[^=!<>]==[^=]')) SELECT repo, path, line_no, regexp_replace(text, '([^=!<>])==([^=])', '\1===\2', 'g') AS text, regexp_matches(regexp_replace(text, '([^=!<>])==([^=])', '\1===\2', 'g'), '[^=!<>]==[^=]') AS still FROM h")
def _(s):
    loose = r"[^=!<>]==[^=]"
    flagged = s.view("code_line").where(F.col("text").rlike(loose))
    fixed = flagged.withColumn("text", F.regexp_replace("text", r"([^=!<>])==([^=])", "$1===$2"))
    return fixed.select("repo", "path", "line_no", "text", F.col("text").rlike(loose).alias("still"))
