"""Operators on findings (events fixture) and on findings of the code fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import findings as O
from lintlake.operators import rules as R
from lintlake.operators import scan
from lintlake.plans.base import literal, query, values
from lintlake.plans.scans import pack

FAMILY = "upper(split_part(rule_id, '-', 1))"
SEV = "CASE severity WHEN 'critical' THEN 1 WHEN 'error' THEN 2 WHEN 'warning' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
CONF = "CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
LEVEL = f"""CASE WHEN severity = 'critical' THEN CASE WHEN {FAMILY} IN ('SEC', 'RTE') AND confidence <> 'low' THEN 'hard-fail' WHEN confidence = 'high' THEN 'review-required' ELSE 'style-note' END
    WHEN severity = 'error' THEN CASE WHEN confidence = 'low' THEN 'style-note' ELSE 'review-required' END
    WHEN severity = 'warning' AND confidence <> 'low' THEN 'review-required' ELSE 'style-note' END"""


def ext_map() -> str:
    return values(R.EXTENSIONS, "extension, language")


@query("p02_with_language", "code_line", f"WITH e AS ({ext_map()}), f AS (SELECT DISTINCT repo, path FROM code_line) SELECT repo, path, language FROM f LEFT JOIN e ON extension = regexp_extract(path, '\\.[^./]+$', 0)")
def _(s):
    langs = s.spark.createDataFrame(R.EXTENSIONS, "extension string, language string")
    files = s.view("code_line").select("repo", "path").distinct().withColumn("extension", F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.join(F.broadcast(langs), "extension", "left").select("repo", "path", "language")


@query(
    "p01_drop_ignored",
    "code_line",
    "WITH f AS (SELECT DISTINCT repo, path FROM code_line) SELECT * FROM f WHERE NOT (path LIKE 'src/de/%' OR path LIKE '%.java' OR path = 'src/en/f0.ts' OR path LIKE '%/f3.ts')",
)
def _(s):
    ignore = s.spark.createDataFrame([("prefix", "src/de/"), ("suffix", ".java"), ("name", "src/en/f0.ts"), ("suffix", "/f3.ts")], "kind string, value string")
    files = s.view("code_line").select("repo", "path").distinct()
    return files.join(F.broadcast(ignore), F.expr("(kind = 'prefix' AND startswith(path, value)) OR (kind = 'suffix' AND endswith(path, value)) OR (kind = 'name' AND path = value)"), "left_anti")


@query(
    "p03_flag_unscannable",
    "",
    """WITH c AS (SELECT doc_id, len(text) AS size, len(string_split(text, chr(10))) AS n, list_sum(list_transform((string_split(text, chr(10)))[1:10], lambda l: len(l))) AS head, least(10, len(string_split(text, chr(10)))) AS k FROM documents)
    SELECT doc_id, size > 150000 OR head / k > 200 AS engine_skip, size > 150000 OR (size - n + 1) / n > 200 AS filter_skip FROM c""",
)
def _(s):
    lines = F.split("text", "\n")
    head = F.slice(lines, 1, 10)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + F.length(y))
    return s.table("documents").select("doc_id", ((F.length("text") > 150000) | (total(head) / F.size(head) > 200)).alias("engine_skip"), ((F.length("text") > 150000) | (total(lines) / F.size(lines) > 200)).alias("filter_skip"))


@query(
    "p04_strip_noise",
    "",
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '"[^"\\n]*"', '""', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents""",
)
def _(s):
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"//[^\n]*", ""), r'"[^"\n]*"', '""'), r"\n{3,}", "\n\n")
    return s.table("documents").select("doc_id", F.sha2(out, 256).alias("digest"))


@query("p06_with_file_context", "code_line", "SELECT DISTINCT repo, path, regexp_matches(path, '\\.(test|spec)\\.|/f1') AS is_test, regexp_matches(path, '^src/en') AS is_cli FROM code_line")
def _(s):
    return s.view("code_line").select("repo", "path", F.col("path").rlike(r"\.(test|spec)\.|/f1").alias("is_test"), F.col("path").rlike("^src/en").alias("is_cli")).distinct()


@query("p07_validate_findings", "findings", "SELECT repo, file, rule_id, line, min(finding_id) AS finding_id, 'regex:' || rule_id AS evidence FROM findings WHERE line >= 1 AND trim(message) <> '' AND severity IN ('critical', 'error', 'warning', 'info') GROUP BY repo, file, rule_id, line")
def _(s):
    return O.validate_findings(s.view("findings")).select("repo", "file", "rule_id", "line", "finding_id", "evidence")


@query("p08_normalize_severity", "findings", f"SELECT finding_id, CASE WHEN severity = 'critical' THEN CASE WHEN {FAMILY} IN ('SEC', 'RTE') THEN 'critical' WHEN {FAMILY} IN ('ERR', 'TYP', 'ASY') THEN 'error' ELSE 'warning' END WHEN severity IN ('error', 'warning') THEN severity ELSE 'info' END AS severity FROM findings")
def _(s):
    return O.normalize_severity(s.view("findings")).select("finding_id", "severity")


@query("p09_route_team", "code_line", "SELECT repo, path, line_no, CASE " + " ".join(f"WHEN regexp_matches(text, {literal('(?i)' + p)}) THEN '{t}'" for t, p in O.ROUTES) + " ELSE 'governance' END AS team FROM code_line")
def _(s):
    return s.view("code_line").select("repo", "path", "line_no", O.route_team(F.col("text")).alias("team"))


@query("p10_classify_level", "findings", f"SELECT finding_id, {LEVEL} AS level FROM findings")
def _(s):
    return s.view("findings").select("finding_id", O.classify_level(F.col("severity"), F.col("rule_id"), F.col("confidence")).alias("level"))


@query("p12_only_changed", "code_line", "SELECT DISTINCT repo, path FROM code_line WHERE path IN (SELECT 'src/' || lang || '/f' || doc_id || '.ts' FROM documents WHERE doc_id % 6 = 0)")
def _(s):
    changed = s.table("documents").where("doc_id % 6 = 0").select(F.concat(F.lit("src/"), "lang", F.lit("/f"), "doc_id", F.lit(".ts")).alias("path"))
    return s.view("code_line").select("repo", "path").distinct().join(changed, "path", "left_semi").select("repo", "path")


@query("j01_enrich", "findings", f"WITH r AS ({values([('SEC-006', 'security', 'hard-fail'), ('RTE-001', 'runtime', 'hard-fail'), ('STL-010', 'style', 'hint'), ('CMX-007', 'complexity', 'hint')], 'id, category, action')}) SELECT finding_id, category, CASE WHEN action = 'hint' THEN 'low' ELSE confidence END AS confidence FROM findings LEFT JOIN r ON id = rule_id")
def _(s):
    catalog = s.spark.createDataFrame([("SEC-006", "security", "hard-fail"), ("RTE-001", "runtime", "hard-fail"), ("STL-010", "style", "hint"), ("CMX-007", "complexity", "hint")], "rule_id string, category string, action string")
    joined = s.view("findings").join(F.broadcast(catalog), "rule_id", "left")
    return joined.select("finding_id", "category", F.when(F.col("action") == "hint", "low").otherwise(F.col("confidence")).alias("confidence"))


SURFACE = pack(R.SURFACE)
HASHES = f"""{SURFACE}, near AS (SELECT h.repo, h.path, h.line, h.rule_id, left(sha256(trim(string_agg(c.text, chr(10) ORDER BY c.line_no))), 16) AS snippet_hash
    FROM hit h JOIN code_line c ON c.repo = h.repo AND c.path = h.path AND c.line_no BETWEEN h.line - 2 AND h.line + 2 GROUP BY ALL)"""


def hits(s):
    return scan.scan_rules(s.view("code_line"), R.SURFACE).select("repo", "path", "line", "rule_id", "severity")


@query("j03_init_baseline", "code_line", f"WITH {HASHES} SELECT * FROM near")
def _(s):
    return O.snippet_hashes(hits(s), s.view("code_line")).select("repo", "path", "line", "rule_id", "snippet_hash")


@query("j02_apply_baseline", "code_line", f"WITH {HASHES} SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM near b WHERE b.repo = n.repo AND b.path = n.path AND b.snippet_hash = n.snippet_hash AND b.rule_id = n.rule_id AND b.line % 2 = 0)")
def _(s):
    now = O.snippet_hashes(hits(s), s.view("code_line")).select("repo", "path", "line", "rule_id", "snippet_hash")
    return O.apply_baseline(now, now.where("line % 2 = 0")).select("repo", "path", "line", "rule_id", "snippet_hash")


@query(
    "j04_apply_suppressions",
    "code_line",
    f"""WITH {SURFACE}, s AS (SELECT repo, path, line_no + 1 AS line, regexp_extract(text, '//\\s*quality-disable-next-line\\s+(\\S+)', 1) AS rule FROM code_line WHERE regexp_matches(text, '//\\s*quality-disable-next-line\\s+\\S'))
    SELECT repo, path, line, rule_id FROM hit h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo = h.repo AND s.path = h.path AND s.line = h.line AND s.rule IN (h.rule_id, '*'))""",
)
def _(s):
    return O.apply_suppressions(hits(s), s.view("code_line")).select("repo", "path", "line", "rule_id")


POLICIES = [("API-006", "global", "", "off"), ("SEC-006", "workspace", "src/en/", "enforce"), ("SEC-006", "workspace", "src/", "off"), ("SEC-006", "module", "src/en/f1", "warn"), ("STL-010", "module", "src/fr/", "off"), ("STL-010", "workspace", "src/fr/", "enforce")]
POLICY_SQL = values(POLICIES, "rule_id, scope, prefix, action")


@query(
    "j05_resolve_policy",
    "code_line",
    f"""WITH {SURFACE}, p AS ({POLICY_SQL}), t AS (SELECT DISTINCT repo, path, rule_id FROM hit),
    c AS (SELECT repo, path, t.rule_id, scope, action, row_number() OVER (PARTITION BY repo, path, t.rule_id ORDER BY CASE scope WHEN 'global' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END, len(prefix) DESC, action) AS n
          FROM t JOIN p ON p.rule_id = t.rule_id AND (scope = 'global' OR starts_with(path, prefix))) SELECT repo, path, rule_id, scope, action FROM c WHERE n = 1""",
)
def _(s):
    policies = s.spark.createDataFrame(POLICIES, "rule_id string, scope string, prefix string, action string")
    return O.resolve_policy(hits(s).select("repo", "path", "rule_id").distinct(), policies)


@query("j08_policy_conflicts", "findings", f"WITH p AS ({POLICY_SQL}), u AS (SELECT DISTINCT rule_id FROM findings) SELECT p.rule_id, count(DISTINCT action) AS actions, arg_min(action, CASE scope WHEN 'global' THEN 0 WHEN 'workspace' THEN 1 ELSE 2 END * 100 + CASE action WHEN 'enforce' THEN 0 WHEN 'off' THEN 1 ELSE 2 END) AS winner FROM p JOIN u ON u.rule_id = p.rule_id GROUP BY p.rule_id HAVING count(DISTINCT action) > 1")
def _(s):
    policies = s.spark.createDataFrame(POLICIES, "rule_id string, scope string, prefix string, action string")
    return O.policy_conflicts(policies.join(s.view("findings").select("rule_id").distinct(), "rule_id", "left_semi"))


@query("j11_with_context", "code_line", f"WITH {SURFACE} SELECT h.repo, h.path, h.line, h.rule_id, string_agg(c.text, chr(10) ORDER BY c.line_no) AS context FROM hit h JOIN code_line c ON c.repo = h.repo AND c.path = h.path AND c.line_no BETWEEN h.line - 3 AND h.line + 3 GROUP BY ALL")
def _(s):
    return O.with_context(hits(s), s.view("code_line"), 3).select("repo", "path", "line", "rule_id", "context")


@query("j27_apply_dismissals", "findings", "WITH l AS (SELECT * FROM findings WHERE NOT (finding_id % 3 = 0 OR finding_id % 4 = 0)) SELECT repo, count(*) AS total, greatest(0, 100 - least(30, count(*) FILTER (WHERE severity = 'error') * 5) - least(20, count(*) FILTER (WHERE severity = 'warning') * 2)) AS score FROM l GROUP BY repo")
def _(s):
    f = s.view("findings")
    return O.apply_dismissals(f, f.where("finding_id % 3 = 0"), f.where("finding_id % 4 = 0"))


@query("j30_corroborate", "findings", "WITH t AS (SELECT repo, file, line, rule_id, count(DISTINCT team) AS teams FROM findings GROUP BY ALL) SELECT finding_id, teams, CASE WHEN teams > 1 THEN CASE confidence WHEN 'low' THEN 'medium' ELSE 'high' END ELSE confidence END AS confidence FROM findings JOIN t USING (repo, file, line, rule_id)")
def _(s):
    return O.corroborate(s.view("findings")).select("finding_id", F.col("teams").cast("long").alias("teams"), "confidence")


@query("j31_correlate", "findings", f"WITH p AS ({values(R.CORRELATED, 'a, b, root_cause')}), f AS (SELECT DISTINCT repo, file, rule_id FROM findings) SELECT x.repo, x.file, root_cause FROM p JOIN f x ON x.rule_id = a JOIN f y ON y.rule_id = b AND y.repo = x.repo AND y.file = x.file")
def _(s):
    return O.correlate(s.view("findings"))


@query("a01_severity_report", "findings", "SELECT repo, rule_id, file, count(*) AS total, count(*) FILTER (WHERE severity IN ('critical', 'error')) AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM findings GROUP BY GROUPING SETS ((repo), (repo, rule_id), (repo, file))")
def _(s):
    return O.severity_report(s.view("findings"))


WEIGHTS = {"error": 2.0, "click": 1.0, "view": 0.5, "purchase": 1.5, "login": 0.7}
COUNTS = f"count(*) AS total, count(*) FILTER (WHERE severity = 'critical' AND {FAMILY} IN ('SEC', 'RTE')) AS sec_critical, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning"


@query("a02_team_scores", "findings", f"WITH w AS ({values(list(WEIGHTS.items()), 'name, weight')}), c AS (SELECT repo, team, {COUNTS} FROM findings GROUP BY repo, team) SELECT repo, team, CAST(greatest(0, 100 - floor((15 * sec_critical + 10 * error + 3 * (critical - sec_critical) + 2 * warning) * CAST(coalesce(weight, 1.0) AS DOUBLE) + 0.5)) AS BIGINT) AS score FROM c LEFT JOIN w ON name = team")
def _(s):
    return O.team_scores(s.view("findings"), WEIGHTS)


@query("a03_run_verdict", "findings", f"WITH l AS (SELECT repo, {LEVEL} AS level FROM findings), n AS (SELECT repo, count(*) FILTER (WHERE level = 'hard-fail') AS hard_fail, count(*) FILTER (WHERE level = 'review-required') AS review, count(*) FILTER (WHERE level = 'style-note') AS note FROM l GROUP BY repo) SELECT *, CASE WHEN hard_fail > 0 THEN 'fail' WHEN review > 0 THEN 'review' ELSE 'pass' END AS verdict, CAST(CASE WHEN hard_fail > 0 THEN greatest(0, 50 - hard_fail * 10) WHEN review > 0 THEN greatest(60, 100 - least(35, floor(log2(review + 1) * 5 + 0.5))) ELSE 100 END AS BIGINT) AS score FROM n")
def _(s):
    return O.run_verdict(s.view("findings"))


@query("a05_capped_score", "findings", f"WITH c AS (SELECT repo, file, {COUNTS} FROM findings GROUP BY repo, file) SELECT repo, file, greatest(50, 100 - least(critical, 3) * 8 - least(error, 5) * 3 - least(warning, 10)) AS score FROM c")
def _(s):
    return O.capped_score(s.view("findings"))


TEAM_VERDICTS = """c AS (SELECT *, count(*) OVER (PARTITION BY repo, team) AS n_all, row_number() OVER (PARTITION BY repo, team ORDER BY finding_id) AS n FROM findings),
    v AS (SELECT repo, team, count(*) FILTER (WHERE severity = 'critical') AS hard_fail, count(*) FILTER (WHERE severity IN ('error', 'warning')) AS review, count(*) FILTER (WHERE severity NOT IN ('critical', 'error', 'warning')) AS note, least(n_all, 30) AS total,
      CASE WHEN n_all > 30 THEN 'bail-out' WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE severity IN ('error', 'warning')) > 0 THEN 'review' ELSE 'pass' END AS verdict FROM c WHERE n <= 30 GROUP BY repo, team, n_all)"""


@query("a06_team_verdicts", "findings", f"WITH {TEAM_VERDICTS} SELECT * FROM v")
def _(s):
    return O.team_verdicts(s.view("findings"))


@query("a07_composite_verdict", "findings", f"WITH {TEAM_VERDICTS}, w AS (SELECT *, CASE WHEN verdict = 'bail-out' THEN 40.0::DOUBLE ELSE greatest(0, 100 - 10 * hard_fail - 2 * review)::DOUBLE END AS s, CASE WHEN verdict = 'bail-out' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k FROM v) SELECT repo, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict IN ('review', 'bail-out')) THEN 'review' ELSE 'pass' END AS verdict, CAST(floor(sum(s * k) / sum(k) + 0.5) AS BIGINT) AS score, count(*) AS teams FROM w GROUP BY repo")
def _(s):
    return O.composite_verdict(O.team_verdicts(s.view("findings")))


ANOMALIES = """n AS (SELECT repo, team AS file, count(*) AS findings FROM findings GROUP BY repo, team),
    m AS (SELECT *, avg(findings) OVER (PARTITION BY repo) AS mean, stddev_pop(findings) OVER (PARTITION BY repo) AS dev FROM n),
    z AS (SELECT repo, file, findings, floor(CASE WHEN dev > 0 THEN (findings - mean) / dev ELSE 0 END * 100 + 0.5) / 100 AS z_score, CASE WHEN findings > greatest(mean + 1 * dev, 20) THEN 'anomaly' WHEN dev > 0 AND (findings - mean) / dev > 1.5 THEN 'elevated' ELSE 'normal' END AS status FROM m)"""


@query("a08_volume_anomalies", "findings", f"WITH {ANOMALIES} SELECT * FROM z")
def _(s):
    return O.volume_anomalies(s.view("findings").withColumn("file", F.col("team")), 1)


@query("a09_adjust_for_anomalies", "findings", f"WITH {ANOMALIES} SELECT f.repo, count(*) AS total, count(*) FILTER (WHERE status <> 'anomaly') AS adjusted FROM findings f JOIN z ON z.repo = f.repo AND z.file = f.team GROUP BY f.repo")
def _(s):
    f = s.view("findings").withColumn("file", F.col("team"))
    return O.adjust_for_anomalies(f, O.volume_anomalies(f, 1))


@query("a40_filter_stats", "findings", "SELECT rule_id, count(*) AS total, count(*) FILTER (WHERE finding_id % 3 = 0 OR line > 30) AS dismissed, count(*) FILTER (WHERE finding_id % 3 = 0 OR line > 30) * 2 > count(*) AS over_suppressed FROM findings GROUP BY rule_id")
def _(s):
    return O.filter_stats(s.view("findings"), F.expr("finding_id % 3 = 0 OR line > 30"))


@query("a43_review_metrics", "findings", "SELECT repo, count(*) AS before, count(*) FILTER (WHERE finding_id % 3 <> 0 AND finding_id % 4 <> 0) AS after, count(*) FILTER (WHERE (finding_id % 3 = 0) = (finding_id % 4 = 0)) AS agreed FROM findings GROUP BY repo")
def _(s):
    f = s.view("findings")
    return O.review_metrics(f, f.where("finding_id % 3 = 0"), f.where("finding_id % 4 = 0"))


@query("w05_cap", "findings", "SELECT finding_id FROM findings QUALIFY row_number() OVER (PARTITION BY repo, rule_id ORDER BY finding_id) <= 3")
def _(s):
    return scan.cap(s.view("findings"), ["repo", "rule_id"], ["finding_id"], 3).select("finding_id")


@query("w13_keep_best", "findings", f"SELECT finding_id FROM findings QUALIFY row_number() OVER (PARTITION BY repo, file, team, line, left(message, 40) ORDER BY {CONF}, finding_id) = 1")
def _(s):
    return O.keep_best(s.view("findings")).select("finding_id")


@query("w14_merge_duplicates", "findings", f"SELECT repo, file, line, message, arg_min(severity, {SEV}) AS severity, arg_min(confidence, {CONF}) AS confidence, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS evidence, count(*) AS merged FROM findings GROUP BY repo, file, line, message")
def _(s):
    return O.merge_duplicates(s.view("findings"))


@query("u02_merge_engines", "findings", f"WITH b AS (SELECT *, CASE WHEN finding_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine FROM findings), m AS (SELECT repo, file, rule_id, line, array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines, arg_min(confidence, {CONF}) AS confidence FROM b GROUP BY ALL) SELECT * REPLACE (CASE WHEN engines = 'a,b' AND confidence = 'medium' THEN 'high' ELSE confidence END AS confidence) FROM m")
def _(s):
    f = s.view("findings")
    return O.merge_engines(f.where("finding_id % 2 = 0"), f.where("finding_id % 2 = 1"))


@query("u01_union_findings", "findings code_line", f"WITH {SURFACE} SELECT rule_id, count(*) AS n, count(file) AS with_file FROM (SELECT rule_id, file FROM findings UNION ALL SELECT rule_id, NULL FROM hit) GROUP BY rule_id")
def _(s):
    both = s.view("findings").unionByName(hits(s).withColumn("repo", F.lit(None).cast("long")), allowMissingColumns=True)
    return both.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count("file").alias("with_file"))


@query("u03_compare_scans", "findings", "WITH a AS (SELECT DISTINCT repo, file, rule_id, line FROM findings WHERE finding_id % 3 <> 0), b AS (SELECT DISTINCT repo, file, rule_id, line FROM findings WHERE finding_id % 3 <> 1) SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, coalesce(a.rule_id, b.rule_id) AS rule_id, coalesce(a.line, b.line) AS line, CASE WHEN a.repo IS NULL THEN 'new' WHEN b.repo IS NULL THEN 'fixed' ELSE 'persisting' END AS state FROM a FULL JOIN b ON a.repo = b.repo AND a.file = b.file AND a.rule_id = b.rule_id AND a.line = b.line")
def _(s):
    f = s.view("findings")
    return O.compare_scans(f.where("finding_id % 3 <> 0"), f.where("finding_id % 3 <> 1"))


@query("u05_distinct_languages", "code_line", "SELECT DISTINCT repo, language FROM code_line")
def _(s):
    return s.view("code_line").select("repo", "language").distinct()
