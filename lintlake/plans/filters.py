"""The false-positive chain and flow checks over the code fixture, and readers of logs and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import js_round
from lintlake.operators import filters as X
from lintlake.operators import rules as R
from lintlake.operators import scan
from lintlake.operators.history import ordered_sum
from lintlake.plans.base import literal, query, values
from lintlake.plans.findings import POLICIES, POLICY_SQL
from lintlake.plans.scans import DEPTH, pack
from lintlake.sources import parse_commit_log

GOOD_ROWS = values([(g, q, p, r) for g, q, p, r in X.GOOD], "good_id, quality, pattern, off")
GOOD = f"g AS ({GOOD_ROWS}), d AS (SELECT DISTINCT repo, path, good_id FROM code_line JOIN g ON regexp_matches(text, pattern))"
HIT = pack(R.SURFACE)


def found(s):
    return scan.scan_rules(s.view("code_line"), R.SURFACE).drop("place").withColumn("confidence", F.lit("medium")).withColumn("finding_id", F.col("line"))


@query("fp1_detect_good_patterns", "code_line", f"WITH {GOOD} SELECT * FROM d")
def _(s):
    return X.detect_good_patterns(s.view("code_line"))


@query("j09_apply_good_suppress", "code_line", f"WITH {HIT}, {GOOD} SELECT repo, path, line, rule_id FROM hit h WHERE NOT EXISTS (SELECT 1 FROM d JOIN g USING (good_id) WHERE d.repo = h.repo AND d.path = h.path AND list_contains(string_split(off, ','), h.rule_id))")
def _(s):
    return X.apply_good_suppress(found(s), X.detect_good_patterns(s.view("code_line"))).select("repo", "path", "line", "rule_id")


QUALITY = values(list(X.QUALITY.items()), "fam, quality")


@query("j10_apply_boost", "code_line", f"WITH {HIT}, {GOOD}, q AS ({QUALITY}), b AS (SELECT repo, path, g.quality FROM d JOIN g USING (good_id) GROUP BY ALL HAVING count(*) >= 2) SELECT h.repo, h.path, line, rule_id, CASE WHEN b.repo IS NOT NULL THEN 'low' ELSE 'medium' END AS confidence FROM hit h LEFT JOIN q ON fam = split_part(rule_id, '-', 1) LEFT JOIN b ON b.repo = h.repo AND b.path = h.path AND b.quality = q.quality")
def _(s):
    return X.apply_boost(found(s), X.detect_good_patterns(s.view("code_line"))).select("repo", "path", "line", "rule_id", "confidence")


REASON = r"""CASE WHEN regexp_matches(t, '^\s*("|''|`)') OR regexp_matches(t, ':\s*("|''|`)') THEN 'SYN-001' WHEN regexp_matches(t, '^\s*//') OR regexp_matches(t, '^\s*\*') THEN 'SYN-002'
    WHEN regexp_matches(t, 'regex\s*:|new RegExp|/.*/[gimsuy]') THEN 'SYN-004' WHEN regexp_matches(t, 'dispose|destroy|cleanup|teardown') THEN 'CTX-009' END"""
FIRST = f"""{HIT}, w AS (SELECT h.repo, h.path, h.line, h.rule_id, h.severity, h.message, {REASON.replace("(t,", "(c.text,")} AS reason FROM hit h JOIN code_line c ON c.repo = h.repo AND c.path = h.path AND c.line_no = h.line)"""


@query("fp2_first_match_dismissal", "code_line", f"WITH {FIRST} SELECT repo, path, line, rule_id, reason, CASE left(reason, 3) WHEN 'SYN' THEN 2 WHEN 'CTX' THEN 3 END AS stage FROM w")
def _(s):
    return X.first_match_dismissal(found(s), s.view("code_line")).select("repo", "path", "line", "rule_id", "reason", "stage")


@query("fp4_filter_report", "code_line", f"WITH {FIRST} SELECT rule_id, reason, count(*) AS n, floor(count(*) * 1000 / sum(count(*)) OVER (PARTITION BY rule_id) + 0.5) / 10 AS share FROM w GROUP BY rule_id, reason")
def _(s):
    return X.filter_report(X.first_match_dismissal(found(s), s.view("code_line")))


@query("fp3_fp_filter", "code_line", f"WITH {FIRST}, {GOOD}, q AS ({QUALITY}), b AS (SELECT repo, path, g.quality FROM d JOIN g USING (good_id) GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT w.*, CASE WHEN rule_id = 'STL-010' OR b.repo IS NOT NULL THEN 'low' ELSE 'medium' END AS confidence FROM w LEFT JOIN q ON fam = split_part(rule_id, '-', 1) LEFT JOIN b ON b.repo = w.repo AND b.path = w.path AND b.quality = q.quality WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM d JOIN g USING (good_id) WHERE d.repo = w.repo AND d.path = w.path AND list_contains(string_split(off, ','), w.rule_id))) SELECT repo, path, line, message, severity, confidence, rule_id AS evidence, CAST(1 AS BIGINT) AS merged FROM k")
def _(s):
    return X.fp_filter(found(s), s.view("code_line"), ["STL-010"])


@query("j13_taint_flow", "code_line", r"WITH o AS (SELECT repo, path, line_no AS source_line, regexp_extract(text, '(?:const|let|var)\s+(\w+)\s*=.*(?:value|input|req\.|x \?)', 1) AS name FROM code_line), k AS (SELECT repo, path, line_no AS sink_line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\w*'))) AS name FROM code_line WHERE regexp_matches(text, 'eval\(|exec\(|innerHTML\s*=|document\.write\(|print\(|use\(')) SELECT repo, path, name, source_line, sink_line FROM o JOIN k USING (repo, path, name) WHERE name <> '' AND sink_line > source_line")
def _(s):
    return X.taint_flow(s.view("code_line"))


@query("j14_null_flow", "code_line", r"WITH d AS (SELECT repo, path, line_no AS decl, regexp_extract(text, '(?:const|let|var)\s+(\w+)\s*=.*(?:find\(|match\(|null|as any|parseInt)', 1) AS name FROM code_line), u AS (SELECT DISTINCT repo, path, line_no AS use, unnest(regexp_extract_all(text, '(\w+)[.=]', 1)) AS name FROM code_line), g AS (SELECT repo, path, line_no AS guard, regexp_extract(text, 'if\s*\(\s*!?(\w+)', 1) AS name FROM code_line) SELECT d.repo, d.path, d.name, decl, use FROM d JOIN u ON u.repo = d.repo AND u.path = d.path AND u.name = d.name WHERE d.name <> '' AND use > decl AND NOT EXISTS (SELECT 1 FROM g WHERE g.repo = d.repo AND g.path = d.path AND g.name = d.name AND g.name <> '' AND guard > decl AND guard <= use)")
def _(s):
    return X.null_flow(s.view("code_line"))


@query("w16_marker_blocks", "code_line", f"WITH o AS (SELECT *, sum(CASE WHEN regexp_matches(text, 'function ') THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line_no) AS block FROM code_line), e AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^\\}}$') THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path, block ORDER BY line_no) AS closed FROM o WHERE block > 0), i AS (SELECT *, regexp_matches(text, '^\\}}$') AND closed = 1 AS is_end FROM e) SELECT repo, path, CAST(block AS BIGINT) AS block, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS length FROM i WHERE closed = 0 OR is_end GROUP BY repo, path, block HAVING bool_or(is_end)")
def _(s):
    return X.marker_blocks(s.view("code_line"), "function ", r"^\}$")


FUNCTIONS = rf"""{DEPTH}, y AS (SELECT *, depth - delta AS before FROM b), h AS (SELECT repo, path, line_no AS start, regexp_extract(text, 'function\s+(\w+)\s*\(', 1) AS name, len(list_filter(string_split(regexp_extract(text, 'function\s+\w+\s*\(([^)]*)\)', 1), ','), lambda p: p <> '')) AS parameters, before FROM y WHERE delta > 0),
    f AS (SELECT h.repo, h.path, name, start, min(y.line_no) AS "end", parameters FROM h JOIN y ON y.repo = h.repo AND y.path = h.path AND y.line_no > start AND y.delta < 0 AND y.depth = h.before WHERE name <> '' GROUP BY h.repo, h.path, name, start, parameters)"""


@query("r31_extract_functions", "code_line", rf"""WITH {FUNCTIONS} SELECT f.repo, f.path, f.name, f.start, f."end", CAST(f.parameters AS INT) AS parameters, CAST(coalesce(sum(len(regexp_extract_all(c.text, '\b(?:if|for|while|case|catch)\b|&&|\|\|'))), 0) + 1 AS BIGINT) AS complexity FROM f LEFT JOIN code_line c ON c.repo = f.repo AND c.path = f.path AND c.line_no > f.start AND c.line_no <= f."end" GROUP BY ALL""")
def _(s):
    return X.extract_functions(s.view("code_line"))


@query("a45_duplicate_bodies", "code_line", rf"""WITH {FUNCTIONS}, t AS (SELECT f.repo, f.path, f.start, count(*) AS lines, string_agg(trim(regexp_replace(c.text, '\s+', ' ', 'g')), chr(10) ORDER BY c.line_no) AS body FROM f JOIN code_line c ON c.repo = f.repo AND c.path = f.path AND c.line_no > f.start AND c.line_no <= f."end" GROUP BY f.repo, f.path, f.start), g AS (SELECT min({{'repo': repo, 'path': path, 'start': start}}) AS first, count(*) AS copies, lines FROM t GROUP BY body, lines HAVING count(*) >= 2) SELECT first.repo AS repo, first.path AS path, first.start AS start, copies, lines FROM g""")
def _(s):
    return X.duplicate_bodies(s.view("code_line"), X.extract_functions(s.view("code_line")), least=2, least_lines=1)


@query("r23_check_async", "code_line", r"WITH a AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS ahead FROM code_line) SELECT repo, path, line_no AS line, 'await-in-loop' AS rule_id FROM a WHERE regexp_matches(text, '\b(?:for|while|forEach)\b') AND regexp_matches(ahead, '\bawait\b') UNION ALL SELECT repo, path, line_no, 'busy-wait' FROM a WHERE regexp_matches(text, 'while\s*\((?:true|k)\)\s*\{')")
def _(s):
    return X.check_async(s.view("code_line"))


@query("r14_check_patents", "", "WITH c AS (SELECT page_id, " + ", ".join(f"""({" OR ".join(f"contains(lower(html), {literal(w)})" for w in words)}) AS "{i}\"""" for i, _, words in X.PATENTS) + " FROM pages) SELECT page_id, CAST(" + " + ".join(f'CASE WHEN "{i}" THEN 1 ELSE 0 END' for i, _, _ in X.PATENTS) + " AS BIGINT) AS n, concat_ws(',', " + ", ".join(f"""CASE WHEN "{i}" THEN '{i}' END""" for i, _, _ in X.PATENTS) + ") AS ids, true AS safe FROM c")
def _(s):
    return X.check_patents(s.table("pages"), "page_id", "html")


DEEP = r"""c AS (SELECT repo, path, line_no AS line, 'P1' AS severity, 'unsafe-cast' AS category FROM code_line WHERE regexp_matches(text, 'as\s+never|\w+\([^)]*\)!\.') UNION ALL SELECT repo, path, line_no, 'P2', 'unsafe-cast' FROM code_line WHERE regexp_matches(text, 'as\s+any\b') UNION ALL SELECT repo, path, line_no, 'P2', 'sort' FROM code_line WHERE regexp_matches(text, '\w+\.sort\(')),
    n AS (SELECT repo, path, CAST(0 AS BIGINT) AS p0, count(*) FILTER (WHERE severity = 'P1') AS p1, count(*) FILTER (WHERE severity = 'P2') AS p2 FROM c GROUP BY repo, path)"""


@query("a10_deep_summary", "code_line", f"WITH {DEEP} SELECT *, greatest(0, 100 - 30 * p0 - 15 * p1 - 5 * p2) AS score FROM n")
def _(s):
    lines = s.view("code_line")
    casts = scan.check_casts(lines).select("repo", "path", "line", "severity", F.lit("unsafe-cast").alias("category"))
    sorts = scan.check_math(lines).where("rule_id = 'sort-in-place'").select("repo", "path", "line", "severity", F.lit("sort").alias("category"))
    return X.deep_summary(casts.unionByName(sorts))


# ---------------------------------------------------------------- readers

@query("s06_parse_commit_log", "changes", "SELECT commit_id, file, added, deleted FROM changes JOIN orders ON o_orderkey = commit_id")
def _(s):
    heads = s.table("orders").select(F.col("o_orderkey").alias("commit_id"), F.lit(0).cast("long").alias("n"), F.concat(F.lit("COMMIT|"), "o_orderkey", F.lit("|"), "o_custkey").alias("text"))
    rows = s.view("changes").join(heads.select("commit_id"), "commit_id").select("commit_id", (F.col("file") + 1).alias("n"), F.concat_ws("\t", "added", "deleted", "file").alias("text"))
    log = heads.unionByName(rows).select((F.col("commit_id") % 16).alias("repo"), F.struct("commit_id", "n").alias("pos"), "text")
    return parse_commit_log(log).select(F.col("commit_id").cast("long").alias("commit_id"), F.col("file").cast("long").alias("file"), "added", "deleted")


@query("s09_read_policies", "", f"WITH p AS ({POLICY_SQL}), r AS (SELECT DISTINCT source AS repo FROM documents) SELECT repo, rule_id, scope, action, CASE scope WHEN 'global' THEN 'org' ELSE 'repo' END AS source FROM p, r")
def _(s):
    rules = [{"rule_id": r, "scope": sc, "action": a} for r, sc, _, a in POLICIES] + [{"rule_id": None, "scope": "global", "action": "off"}, {"rule_id": "X", "scope": None, "action": "off"}]
    import json

    files = s.table("documents").select(F.col("source").alias("repo")).distinct().withColumn("content", F.lit(json.dumps({"rules": rules})))
    parsed = files.select("repo", F.explode(F.from_json("content", "rules ARRAY<STRUCT<rule_id:STRING,scope:STRING,action:STRING,source:STRING>>")["rules"]).alias("r"))
    kept = parsed.where("r.rule_id IS NOT NULL AND r.scope IS NOT NULL AND r.action IS NOT NULL")
    return kept.select("repo", "r.rule_id", "r.scope", "r.action", F.coalesce("r.source", F.when(F.col("r.scope") == "global", "org").otherwise("repo")).alias("source"))


@query("s10_read_ignore", "text_line", "SELECT repo, path, trim(text) AS pattern FROM text_line WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')")
def _(s):
    return s.view("text_line").select("repo", "path", F.trim("text").alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#')")


@query("s11_read_coverage", "", "WITH c AS (SELECT user_id, CAST(sum(value) AS BIGINT) % 101 AS lines, count(*) % 101 AS branches FROM events GROUP BY user_id) SELECT user_id AS repo, 'lines' AS metric, lines AS pct FROM c UNION ALL SELECT user_id, 'branches', branches FROM c")
def _(s):
    c = ordered_sum(s.table("events"), ["user_id"], "value", "event_id").select("user_id", (F.bround("total").cast("long") % 101).alias("lines"), (F.col("n") % 101).alias("branches"))
    text = c.select(F.col("user_id").alias("repo"), F.to_json(F.struct(F.struct(F.struct(F.col("lines").alias("pct")).alias("lines"), F.struct(F.col("branches").alias("pct")).alias("branches")).alias("total"))).alias("content"))
    parsed = text.select("repo", F.from_json("content", "total STRUCT<lines:STRUCT<pct:BIGINT>,branches:STRUCT<pct:BIGINT>>")["total"].alias("t"))
    return parsed.select("repo", F.col("t.lines.pct").alias("lines"), F.col("t.branches.pct").alias("branches")).unpivot(["repo"], ["lines", "branches"], "metric", "pct")


@query("s13_ingest_snippets", "", "SELECT item_id AS id, text FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, text FROM benchmark WHERE item_id % 3 <> 0")
def _(s):
    b = s.table("benchmark").select(F.col("item_id").alias("id"), "text")
    old = b.where("id % 3 = 0")
    return old.unionByName(b.join(old.select("id"), "id", "left_anti"))


@query("j29_compare_snapshots", "runs", "WITH m AS (SELECT repo, team, CAST(floor(avg(score) FILTER (WHERE run_id % 2 = 1) + 0.5) AS BIGINT) AS now, CAST(floor(avg(score) FILTER (WHERE run_id % 2 = 0) + 0.5) AS BIGINT) AS was FROM runs GROUP BY ALL) SELECT *, CASE WHEN now - was > 5 THEN 'up' WHEN now - was < -5 THEN 'down' ELSE 'flat' END AS trend FROM m WHERE now IS NOT NULL AND was IS NOT NULL")
def _(s):
    mean = lambda odd: js_round(F.avg(F.when(F.col("run_id") % 2 == odd, F.col("score"))))
    m = s.view("runs").groupBy("repo", "team").agg(mean(1).alias("now"), mean(0).alias("was")).dropna(subset=["now", "was"])
    return m.withColumn("trend", F.when(F.col("now") - F.col("was") > 5, "up").when(F.col("now") - F.col("was") < -5, "down").otherwise("flat"))


GRADE = "CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"


@query("a12_category_grades", "runs", f"WITH c AS (SELECT repo, CASE WHEN team IN ('click', 'view') THEN 'quality' ELSE 'operations' END AS category, CAST(floor(avg(score) + 0.5) AS BIGINT) AS score, bool_or(team = 'error' AND score < 5) AS gated FROM runs GROUP BY ALL) SELECT repo, category, score, {GRADE} AS grade, gated FROM c")
def _(s):
    from lintlake.functions import GRADES, grade

    category = F.when(F.col("team").isin("click", "view"), "quality").otherwise("operations")
    c = s.view("runs").groupBy("repo", category.alias("category")).agg(js_round(F.avg("score")).alias("score"), F.bool_or((F.col("team") == "error") & (F.col("score") < 5)).alias("gated"))
    return c.select("repo", "category", "score", grade(F.col("score"), *GRADES["audit"]).alias("grade"), "gated")


@query("a44_evidence_verdict", "findings", "WITH e AS (SELECT file, CAST(floor(avg(100 - line) + 0.5) AS BIGINT) AS score, count(*) FILTER (WHERE severity = 'critical') AS n FROM findings GROUP BY file) SELECT *, CASE WHEN score >= 90 AND n = 0 THEN 'approve' WHEN score < 50 THEN 'reject' WHEN score < 80 THEN 'fix' ELSE 'review' END AS verdict FROM e")
def _(s):
    e = s.view("findings").groupBy("file").agg(js_round(F.avg(100 - F.col("line"))).alias("score"), F.count_if(F.col("severity") == "critical").alias("n"))
    return e.withColumn("verdict", F.when((F.col("score") >= 90) & (F.col("n") == 0), "approve").when(F.col("score") < 50, "reject").when(F.col("score") < 80, "fix").otherwise("review"))


@query("a49_dismiss_rate", "findings", "SELECT team, count(*) AS pre, count(*) FILTER (WHERE finding_id % 4 <> 0) AS post, floor(count(*) FILTER (WHERE finding_id % 4 = 0) * 1000 / count(*) + 0.5) / 10 AS dismiss_rate FROM findings GROUP BY team")
def _(s):
    n = s.view("findings").groupBy("team").agg(F.count(F.lit(1)).alias("pre"), F.count_if(F.col("finding_id") % 4 != 0).alias("post"))
    return n.withColumn("dismiss_rate", js_round((F.col("pre") - F.col("post")) * 1000 / F.col("pre")) / 10)


@query("a51_hygiene_gaps", "text_line", "SELECT repo, path, count(*) AS lines FROM text_line GROUP BY repo, path HAVING count(*) > 30")
def _(s):
    return s.view("text_line").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("lines")).where("lines > 30")


@query("w09_complexity_trend", "changes commits", "WITH v AS (SELECT file, day, commit_id, added - deleted AS size FROM changes JOIN commits USING (commit_id)) SELECT file, commit_id, size, size - lag(size) OVER (PARTITION BY file ORDER BY day, commit_id) AS delta FROM v")
def _(s):
    v = s.view("changes").join(s.view("commits"), "commit_id").withColumn("size", F.col("added") - F.col("deleted"))
    w = W.partitionBy("file").orderBy("day", "commit_id")
    return v.select("file", "commit_id", "size", (F.col("size") - F.lag("size").over(w)).alias("delta"))


@query("t05_search_all", "code_line", r"WITH f AS (SELECT 'code' AS kind, path AS hit, count(*) AS score FROM code_line WHERE contains(lower(text), 'load') GROUP BY path UNION ALL SELECT 'file', path, 1 FROM (SELECT DISTINCT path FROM code_line) WHERE contains(path, 'load')) SELECT * FROM f ORDER BY score DESC, kind, hit LIMIT 30")
def _(s):
    lines = s.view("code_line")
    code = lines.where(F.contains(F.lower("text"), F.lit("load"))).groupBy("path").agg(F.count(F.lit(1)).alias("score")).select(F.lit("code").alias("kind"), F.col("path").alias("hit"), "score")
    files = lines.select("path").distinct().where(F.contains("path", F.lit("load"))).select(F.lit("file").alias("kind"), F.col("path").alias("hit"), F.lit(1).cast("long").alias("score"))
    return code.unionByName(files).orderBy(F.col("score").desc(), "kind", "hit").limit(30)
