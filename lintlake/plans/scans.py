"""Scan operators over source lines (code fixture) and text lines (documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import rules as R
from lintlake.operators import scan
from lintlake.plans.base import literal, query, values


def pack(rules: list[R.Rule], lines: str = "code_line", skip: str | None = None) -> str:
    """Twin CTEs: r (the pack), hit (lines by rules)."""
    rows = values([(k, r.rule_id, r.severity, r.pattern, r.message) for k, r in enumerate(rules)], "place, rule_id, severity, pattern, message")
    where = f"WHERE NOT regexp_matches(text, {literal(skip)})" if skip else ""
    return f"r AS ({rows}), l AS (SELECT * FROM {lines} {where}), hit AS (SELECT repo, path, line_no AS line, place, rule_id, severity, message FROM l JOIN r ON regexp_matches(text, pattern))"


def capped(rules: list[R.Rule], most: int, skip: str | None = None, columns: str = "repo, path, line, rule_id, severity, message", order: str = "line, place") -> str:
    return f"WITH {pack(rules, skip=skip)}, c AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY {order}) AS n FROM hit) SELECT {columns} FROM c WHERE n <= {most}"


ROW = "repo, path, line, rule_id, severity"


@query("s02_explode_lines", "text_line", "SELECT repo, path, line_no, replace(text, chr(13), '') AS text FROM text_line")
def _(s):
    files = s.table("documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return scan.explode_lines(files)


@query(
    "r01_scan_surface",
    "code_line",
    f"""WITH {pack(R.SURFACE, skip=R.RULE_LINE)},
    few AS (SELECT *, row_number() OVER (PARTITION BY repo, path, message ORDER BY line) AS n FROM hit QUALIFY n <= 3),
    b AS (SELECT *, count(*) OVER (PARTITION BY repo, path ORDER BY line RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM few)
    SELECT repo, path, line, rule_id, severity, message FROM b WHERE before < 20""",
)
def _(s):
    return scan.scan_surface(s.view("code_line")).select("repo", "path", "line", "rule_id", "severity", "message")


DEPTH = """d AS (SELECT *, CAST(len(text) - len(replace(text, '{', '')) - len(text) + len(replace(text, '}', '')) AS BIGINT) AS delta FROM code_line),
    b AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY repo, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM d)"""


@query(
    "r02_scan_structure",
    "code_line",
    f"""WITH {DEPTH},
    e AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY repo, path ORDER BY line_no), 0) AS before,
                 last_value(CASE WHEN regexp_matches(text, 'function\\s|=>|class\\s') THEN line_no END IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS start,
                 len(list_filter(string_split(regexp_extract(text, 'function\\s+\\w+\\(([^)]*)\\)', 1), ','), lambda p: p <> '')) AS params FROM b),
    f AS (SELECT repo, path, start AS line, 'long-function' AS rule_id, CAST(min(line_no) - start AS BIGINT) AS amount, 0 AS kind FROM e WHERE depth = 0 AND line_no - start > 50 GROUP BY repo, path, start
          UNION ALL SELECT repo, path, line_no, 'deep-nesting', depth, 1 FROM e WHERE depth > 5 AND before <= 5
          UNION ALL SELECT repo, path, line_no, 'many-parameters', CAST(params AS BIGINT), 2 FROM e WHERE params > 5),
    c AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY kind, line) AS n FROM f)
    SELECT repo, path, line, rule_id, amount FROM c WHERE n <= 15""",
)
def _(s):
    return scan.scan_structure(s.view("code_line")).select("repo", "path", "line", "rule_id", "amount")


@query(
    "r03_scan_hollow",
    "code_line",
    """WITH n AS (SELECT *, lead(text) OVER (PARTITION BY repo, path ORDER BY line_no) AS following FROM code_line)
    SELECT repo, path, line_no AS line, 'empty-function' AS rule_id, 'error' AS severity FROM n WHERE regexp_matches(text, 'function\\s+\\w+|=>\\s*\\{') AND regexp_matches(following, '^\\s*\\}\\s*$')
    UNION ALL SELECT repo, path, line_no, 'not-implemented', 'error' FROM n WHERE regexp_matches(text, 'throw\\s+new\\s+Error\\(\\s*[''"`]Not\\s+implemented')
    UNION ALL SELECT repo, path, line_no, 'stub-return', 'warning' FROM n WHERE regexp_matches(text, '(?i)return\\s+(null|undefined|void\\s+0)\\s*;?\\s*//\\s*(TODO|FIXME|stub)')""",
)
def _(s):
    return scan.scan_hollow(s.view("code_line"))


@query(
    "r04_scan_dead_code",
    "code_line",
    """WITH n AS (SELECT *, lead(text) OVER (PARTITION BY repo, path ORDER BY line_no) AS following FROM code_line),
    f AS (SELECT repo, path, line_no AS seen, line_no + 1 AS line, 'unreachable' AS rule_id, 'warning' AS severity FROM n
          WHERE regexp_matches(text, '^\\s*return\\b') AND following IS NOT NULL AND NOT regexp_matches(following, '^\\s*[})\\]]') AND trim(following) <> ''
          UNION ALL SELECT repo, path, line_no, line_no, 'commented-code', 'info' FROM n WHERE regexp_matches(text, '^\\s*//\\s*(const|let|var|function|if|for|while|return|import)\\s')),
    c AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY seen, rule_id DESC) AS k FROM f)
    SELECT repo, path, line, rule_id, severity FROM c WHERE k <= 10""",
)
def _(s):
    return scan.scan_dead_code(s.view("code_line"))


@query(
    "r05_scan_design",
    "code_line",
    """WITH c AS (SELECT repo, path, CAST(sum(len(regexp_extract_all(text, 'z-index:\\s*\\d+|z-\\[\\d+\\]'))) AS BIGINT) AS z_index, CAST(sum(len(regexp_extract_all(text, '(?i)#[0-9a-f]{6}'))) AS BIGINT) AS colours FROM code_line GROUP BY repo, path)
    SELECT *, greatest(0, 100 - 10 * (z_index + CASE WHEN colours > 5 THEN 1 ELSE 0 END)) AS score FROM c WHERE z_index > 0 OR colours > 5""",
)
def _(s):
    return scan.scan_design(s.view("code_line"))


@query(
    "r06_scan_cognitive",
    "text_line",
    """WITH f AS (SELECT repo, path, line_no AS line, 'long-line' AS rule_id, 0 AS kind FROM text_line WHERE len(text) > 120 QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line_no) <= 3
          UNION ALL SELECT repo, path, line_no, 'nested-ternary', 1 FROM text_line WHERE len(text) - len(replace(text, '?', '')) >= 2
          UNION ALL SELECT repo, path, 0, 'large-file', 2 FROM text_line GROUP BY repo, path HAVING count(*) > 300),
    c AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY kind, line) AS n FROM f) SELECT repo, path, line, rule_id FROM c WHERE n <= 10""",
)
def _(s):
    return scan.scan_cognitive(s.view("text_line"))


@query("r07_scan_bugs", "code_line", capped(R.BUGS, 15))
def _(s):
    return scan.scan_bugs(s.view("code_line"))


@query("r08_scan_security", "code_line", capped(R.SECURITY, 15, R.RULE_LINE))
def _(s):
    return scan.scan_security(s.view("code_line"))


CWE = values([(r.rule_id, c) for r, c in R.VULNS], "id, cwe")


@query("r09_scan_vulns", "code_line", capped([r for r, _ in R.VULNS], 50, r"^\s*(//|\*|/\*)", "repo, path, line, rule_id, severity, message, cwe").replace("FROM c WHERE", f"FROM c JOIN ({CWE}) w ON w.id = c.rule_id WHERE"))
def _(s):
    return scan.scan_vulns(s.view("code_line"))


def _secret_sql() -> str:
    rows = values([(k, r.rule_id, r.severity, r.pattern, int(g)) for k, (r, g) in enumerate(R.SECRETS)], "place, rule_id, severity, pattern, gated")
    return f"""WITH r AS ({rows}),
    l AS (SELECT * FROM code_line WHERE NOT regexp_matches(text, '^\\s*(//|#|\\*)') AND NOT regexp_matches(text, {literal(R.PLACEHOLDER)})),
    h AS (SELECT repo, path, line_no AS line, place, rule_id, severity, gated, regexp_extract(text, pattern, 0) AS secret FROM l JOIN r ON regexp_matches(text, pattern)),
    v AS (SELECT *, regexp_replace(regexp_extract(secret, '^.*?[=:]\\s*[''"]?(.*)$', 1), '[''"]$', '') AS value FROM h),
    e AS (SELECT *, list_reduce(list_transform(list_distinct(string_split(value, '')), lambda c: -(len(list_filter(string_split(value, ''), lambda d: d = c)) / len(value)) * log2(len(list_filter(string_split(value, ''), lambda d: d = c)) / len(value))), lambda a, b: a + b) AS entropy FROM v),
    f AS (SELECT * FROM e WHERE gated = 0 OR (len(value) >= 8 AND entropy >= 3.0) QUALIFY row_number() OVER (PARTITION BY repo, path, line ORDER BY place) = 1)
    SELECT repo, path, line, rule_id, severity, CASE WHEN len(secret) > 12 THEN left(secret, 6) || '***' || right(secret, 4) ELSE left(secret, 4) || '***' END AS preview
    FROM f QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) <= 50"""


@query("r10_scan_secrets", "code_line", _secret_sql())
def _(s):
    return scan.scan_secrets(s.view("code_line"))


def _generic_sql() -> str:
    rows = values([(r.rule_id, r.pattern) for r in R.SECRETS_GENERIC], "rule_id, pattern")
    return f"""WITH r AS ({rows}), h AS (SELECT repo, path, line_no AS line, rule_id, regexp_extract(text, pattern, 0) AS m FROM text_line JOIN r ON regexp_matches(text, pattern))
    SELECT repo, path, line, rule_id, left(m, 8) || '***' || right(m, 4) AS masked FROM h"""


@query("r11_scan_secrets_generic", "text_line", _generic_sql())
def _(s):
    return scan.scan_secrets_generic(s.view("text_line"))


@query("r12_scan_ip_markers", "text_line", f"WITH {pack(R.IP_MARKERS, 'text_line')} SELECT h.repo, h.path, line, rule_id, severity FROM hit h JOIN text_line t ON t.repo = h.repo AND t.path = h.path AND t.line_no = h.line WHERE NOT (rule_id = 'copyright' AND regexp_matches(t.text, {literal(R.KNOWN_LICENSE)}))")
def _(s):
    return scan.scan_ip_markers(s.view("text_line"))


def _license_sql() -> str:
    rows = values([(k, spdx, tier, p) for k, (spdx, tier, p) in enumerate(R.LICENSES)], "place, spdx_id, risk_tier, pattern")
    return f"""WITH r AS ({rows}), h AS (SELECT repo, path, line_no, spdx_id, risk_tier, row_number() OVER (PARTITION BY repo, path, line_no ORDER BY place) AS n FROM text_line JOIN r ON regexp_matches(text, pattern))
    SELECT repo, path, line_no, spdx_id, risk_tier FROM h WHERE n = 1"""


@query("r13_classify_license", "text_line", _license_sql())
def _(s):
    return scan.classify_license(s.view("text_line")).where("spdx_id IS NOT NULL").select("repo", "path", "line_no", "spdx_id", "risk_tier")


def _language_sql() -> str:
    rows = values([(k, lang, r.rule_id, r.severity, r.pattern) for k, (lang, r) in enumerate(R.LANGUAGE_PACKS)], "place, lang, rule_id, severity, pattern")
    return f"""WITH r AS ({rows}), h AS (SELECT repo, path, line_no AS line, rule_id, severity, row_number() OVER (PARTITION BY repo, path ORDER BY place, line_no) AS n FROM code_line JOIN r ON lang = language AND regexp_matches(text, pattern))
    SELECT {ROW} FROM h WHERE n <= 50"""


@query("r15_scan_language_pack", "code_line", _language_sql())
def _(s):
    return scan.scan_language_pack(s.view("code_line"))


MAJORS = "SELECT source AS repo, 'typescript' AS framework, CAST(max(doc_id) % 9 AS INT) AS major FROM documents GROUP BY source UNION ALL SELECT source, 'node', CAST(15 + max(doc_id) % 9 AS INT) FROM documents GROUP BY source"


@query(
    "r16_scan_deprecated",
    "code_line",
    f"""WITH m AS ({MAJORS}), r AS ({values(R.DEPRECATED, "framework, least, pattern, severity")})
    SELECT c.repo, path, line_no AS line, r.framework, pattern, severity FROM code_line c JOIN r ON regexp_matches(text, pattern) JOIN m ON m.repo = c.repo AND m.framework = r.framework WHERE major >= least""",
)
def _(s):
    s.view("documents").createOrReplaceTempView("documents")
    return scan.scan_deprecated(s.view("code_line"), s.spark.sql(MAJORS))


@query("r17_risky_api_inventory", "code_line", f"WITH {pack(R.RISKY)} SELECT DISTINCT repo, path, rule_id, severity FROM hit")
def _(s):
    return scan.risky_api_inventory(s.view("code_line"))


@query(
    "r18_embedded_languages",
    "",
    """WITH k AS (SELECT 'javascript' AS embedded, '(?i)<script[\\s>]' AS p UNION ALL SELECT 'css', '(?i)<style[\\s>]' UNION ALL SELECT 'svg', '(?i)<svg[\\s>]' UNION ALL SELECT 'sql', '(?i)\\bSELECT\\s+.+\\s+FROM\\s'),
    c AS (SELECT page_id, embedded, CAST(len(regexp_extract_all(html, p)) AS BIGINT) AS n FROM pages, k)
    SELECT *, CASE WHEN n > 10 THEN 'high' WHEN n > 3 THEN 'medium' ELSE 'low' END AS risk FROM c WHERE n > 0""",
)
def _(s):
    return scan.embedded_languages(s.table("pages"))


@query(
    "r19_accessibility",
    "",
    """WITH c AS (SELECT page_id,
      CAST(len(list_filter(regexp_extract_all(html, '(?i)<img(?:\\s[^>]*)?>'), lambda t: NOT regexp_matches(t, '(?i)\\salt\\s*='))) AS BIGINT) AS img_no_alt,
      CAST(len(list_filter(regexp_extract_all(html, '(?i)<input(?:\\s[^>]*)?>'), lambda t: NOT regexp_matches(t, '(?i)\\saria-label\\s*='))) AS BIGINT) AS input_no_label,
      CAST(len(regexp_extract_all(html, '(?i)<button[^>]*>\\s*</button>')) AS BIGINT) AS empty_button,
      CAST(len(list_filter(regexp_extract_all(html, '(?i)<html(?:\\s[^>]*)?>'), lambda t: NOT regexp_matches(t, '(?i)\\slang\\s*='))) AS BIGINT) AS no_lang FROM pages)
    SELECT *, greatest(0, 100 - 10 * (img_no_alt + input_no_label + empty_button + no_lang)) AS score FROM c""",
)
def _(s):
    return scan.accessibility(s.table("pages"))


@query(
    "r21_check_declaration_order",
    "code_line",
    """WITH d AS (SELECT repo, path, regexp_extract(text, '^\\s*(?:export\\s+)?(?:const|let|class)\\s+(\\w+)', 1) AS name, min(line_no) AS declared FROM code_line GROUP BY ALL HAVING name <> ''),
    w AS (SELECT repo, path, line_no, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\\w*'))) AS name FROM code_line),
    u AS (SELECT repo, path, name, min(line_no) AS used FROM w GROUP BY ALL)
    SELECT repo, path, name, declared, used FROM d JOIN u USING (repo, path, name) WHERE used < declared""",
)
def _(s):
    return scan.check_declaration_order(s.view("code_line"))


@query("r22_check_brace_balance", "code_line", f"WITH {DEPTH} SELECT repo, path, min(line_no) FILTER (WHERE depth < 0) AS early_line, CAST(sum(delta) AS BIGINT) AS left_open FROM b GROUP BY repo, path HAVING early_line IS NOT NULL OR left_open <> 0")
def _(s):
    return scan.check_brace_balance(s.view("code_line"))


@query(
    "r24_check_casts",
    "code_line",
    """SELECT repo, path, line_no AS line, 'as-never' AS rule_id, 'P1' AS severity FROM code_line WHERE regexp_matches(text, 'as\\s+never')
    UNION ALL SELECT repo, path, line_no, 'as-any', 'P2' FROM code_line WHERE regexp_matches(text, 'as\\s+any\\b') AND NOT regexp_matches(text, '//.*as any')
    UNION ALL SELECT repo, path, line_no, 'ts-suppress', 'P2' FROM code_line WHERE regexp_matches(text, '@ts-ignore|@ts-expect-error')
    UNION ALL SELECT repo, path, line_no, 'non-null-call', 'P1' FROM code_line WHERE regexp_matches(text, '\\w+\\([^)]*\\)!\\.')""",
)
def _(s):
    return scan.check_casts(s.view("code_line"))


LEAKS = [("interval", r"setInterval\(", r"clearInterval\("), ("listener", r"addEventListener\(", r"removeEventListener\("), ("stream", r"createReadStream\(|createWriteStream\(", r"\.close\(|\.destroy\(|\.end\("), ("push", r"\.push\(", r"\.pop\(|\.splice\(|\.shift\(")]


@query("r25_check_leaks", "code_line", f"WITH r AS ({values(LEAKS, 'kind, a, b')}) SELECT repo, path, kind, count(*) FILTER (WHERE regexp_matches(text, a)) AS acquired FROM code_line, r GROUP BY repo, path, kind HAVING acquired > 0 AND count(*) FILTER (WHERE regexp_matches(text, b)) = 0")
def _(s):
    return scan.check_leaks(s.view("code_line"))


@query(
    "r26_check_math",
    "code_line",
    """SELECT repo, path, line_no AS line, 'score-times-100' AS rule_id, 'P1' AS severity FROM code_line WHERE regexp_matches(text, 'Score.*Math\\.round\\(\\w+\\s*\\*\\s*100\\)|score.*\\*\\s*100')
    UNION ALL SELECT repo, path, line_no, 'divide-by-count', 'P1' FROM code_line WHERE regexp_matches(text, '/\\s*(?:\\w+\\.length|scores\\.length|total|count)') AND NOT regexp_matches(text, 'Math\\.max\\s*\\(\\s*1') AND NOT contains(text, ' 1')
    UNION ALL SELECT repo, path, line_no, 'sort-in-place', 'P2' FROM code_line WHERE regexp_matches(text, '\\w+\\.sort\\(') AND NOT contains(text, '[...') AND NOT contains(text, 'Array.from') AND NOT regexp_matches(text, '[\\])]\\s*\\.sort')
      AND NOT regexp_matches(regexp_extract(text, '(\\w+)\\.sort\\(', 1), '^(?:_|temp|sorted|copy)')""",
)
def _(s):
    return scan.check_math(s.view("code_line"))


@query(
    "r27_load_risk",
    "code_line",
    """WITH c AS (SELECT repo, path, CAST(sum(len(regexp_extract_all(text, '(?:for|while)\\s*\\(.*\\{.*(?:for|while)\\s*\\('))) AS BIGINT) AS nested, CAST(sum(len(regexp_extract_all(text, 'readFileSync|writeFileSync|execSync'))) AS BIGINT) AS sync_io,
      CAST(sum(len(regexp_extract_all(text, '\\.push\\('))) AS BIGINT) AS pushes, CAST(sum(len(regexp_extract_all(text, 'let\\s+\\w+\\s*[:=]'))) AS BIGINT) AS lets FROM code_line GROUP BY repo, path)
    SELECT *, CAST(greatest(0, 100 - CASE WHEN nested > 0 THEN 25 ELSE 0 END - CASE WHEN sync_io > 3 THEN 10 ELSE 0 END - CASE WHEN pushes > 5 THEN 10 ELSE 0 END - CASE WHEN lets > 10 THEN 5 ELSE 0 END) AS INT) AS score FROM c""",
)
def _(s):
    return scan.load_risk(s.view("code_line"))


SYMBOLS = [("function", r"(?:^|\s)function\s+(\w+)"), ("class", r"(?:^|\s)class\s+(\w+)"), ("variable", r"(?:^|\s)(?:const|let|var)\s+(\w+)"), ("type", r"(?:^|\s)type\s+(\w+)\s*="), ("interface", r"(?:^|\s)interface\s+(\w+)")]


@query("r29_extract_symbols", "code_line", f"WITH r AS ({values(SYMBOLS, 'kind, p')}) SELECT DISTINCT repo, path, line_no AS line, kind, regexp_extract(text, p, 1) AS name FROM code_line JOIN r ON regexp_matches(text, p)")
def _(s):
    return scan.extract_symbols(s.view("code_line"))


@query(
    "r30_extract_imports",
    "code_line",
    """WITH f AS (SELECT repo, path, line_no AS line, unnest(list_concat(regexp_extract_all(text, '(?:from|import)\\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(text, 'require\\([''"]([^''"]+)[''"]\\)', 1))) AS specifier FROM code_line)
    SELECT *, CASE WHEN specifier LIKE '.%' THEN 'local' WHEN specifier LIKE '@%' THEN 'scoped' ELSE 'external' END AS kind FROM f""",
)
def _(s):
    return scan.extract_imports(s.view("code_line"))


@query("w01_brace_depth", "code_line", f"WITH {DEPTH} SELECT repo, path, line_no, depth, max(depth) OVER (PARTITION BY repo, path) AS max_depth FROM b")
def _(s):
    return scan.brace_depth(s.view("code_line")).select("repo", "path", "line_no", "depth", "max_depth")


@query(
    "w02_blank_runs",
    "code_line",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS nth FROM code_line),
    b AS (SELECT *, nth - row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS island FROM n WHERE trim(text) = ''),
    p AS (SELECT *, row_number() OVER (PARTITION BY repo, path, island ORDER BY line_no) AS place FROM b) SELECT repo, path, line_no AS line FROM p WHERE place = 3""",
)
def _(s):
    return scan.blank_runs(s.view("code_line"))


@query(
    "w03_comment_streaks",
    "code_line",
    """WITH m AS (SELECT *, regexp_matches(text, '^\\s*(//|#|\\*|/\\*)') AS comment, row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS nth FROM code_line),
    a AS (SELECT *, count(*) FILTER (WHERE comment) OVER (PARTITION BY repo, path) AS comments, count(*) OVER (PARTITION BY repo, path) AS n FROM m),
    r AS (SELECT *, nth - row_number() OVER (PARTITION BY repo, path ORDER BY line_no) AS island FROM a WHERE comment)
    SELECT repo, path, min(line_no) AS first_line, count(*) AS length, floor(max(comments) * 1000 / max(n) + 0.5) / 1000 AS comment_share FROM r GROUP BY repo, path, island HAVING count(*) >= 2""",
)
def _(s):
    return scan.comment_streaks(s.view("code_line"))


@query("w04_adjacent_match", "code_line", "WITH n AS (SELECT *, lead(text) OVER (PARTITION BY repo, path ORDER BY line_no) AS next_text FROM code_line) SELECT repo, path, line_no, text, next_text FROM n WHERE regexp_matches(text, 'return') AND regexp_matches(next_text, '\\w+\\(')")
def _(s):
    return scan.adjacent_match(s.view("code_line"), "return", r"\w+\(").select("repo", "path", "line_no", "text", "next_text")


@query("a46_repeated_literals", "code_line", "WITH f AS (SELECT repo, path, unnest(regexp_extract_all(text, '''([^'']{3,})''', 1)) AS value FROM code_line) SELECT repo, path, value, count(*) AS n FROM f GROUP BY ALL HAVING count(*) >= 2")
def _(s):
    return scan.repeated_literals(s.view("code_line"), least=2)
