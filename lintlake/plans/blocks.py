"""Lexed lines, spans and scopes over a fixture of programs, with twins that read the characters one by one."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lintlake.operators import scopes, structure
from lintlake.operators import span_rules as R
from lintlake.operators import syntax as S
from lintlake.plans.base import NEEDS, VIEWS, literal, query, values

#: Pieces of programs that the fixture deals out: (place, every how many documents, text).
PIECES: list[tuple[int, int, str]] = [
    (1, 2, "import { one, two as other } from 'x';"),
    (2, 3, "import whole from 'y';"),
    (3, 2, "async function load(a, b: number, c, d, e, f) {\n  for (const x of all) {\n    const y = 1;\n    await send(x, y);\n  }\n  return list.then(whole);\n}"),
    (4, 3, "const open = '{'; // }"),
    (5, 3, "/* a { comment\n  function hidden() { } */ let text = `one {\n two ${ join(map, (k) => { return `}`; }) } }`;"),
    (6, 4, "while (true) {\n  spin({ pos: 1 });\n}"),
    (7, 5, "while (true) { if (spin()) { break; } }"),
    (8, 3, "class Box {\n  constructor(private size: number) { this.size = size; }\n  grow(by) { if (by && by > 1 || this.size) { for (;;) { by--; } } else if (by) { return 2; }\n  }\n}"),
    (9, 4, "all.forEach(async (item) => {\n  await item.go(/[{'\"`]+/g, item.find(k => k));\n  const z = JSON.parse(item) ? 1 : 2;\n});"),
    (10, 3, "describe('box', () => {\n  it('works', () => { setTimeout(() => { throw new Error('{'); }, 5); });\n  it('fails on empty', function () { expect(one).toBe(other); });\n});"),
    (11, 4, "try { open(createReadStream(other)); } catch (e) { console.log(e); }"),
    (12, 5, "try { try { try { a = 1; } finally { } } catch { } } catch (e) { throw e; } finally { done(); }"),
    (13, 4, "function again(n) { return again(n - 1); }"),
    (14, 5, "for (let i = 0; i < rows.length; i++) { rows.push(i); document.querySelector(i); }"),
    (15, 4, "switch (text) { case 1: break; }\nswitch (open) { default: go(go(1)); }"),
    (16, 5, "const { p, q: r } = whole;\nvar p = r;"),
    (17, 6, "export const shown = (a, { b, c }) => { const a = b; return a; };"),
    (18, 6, "use(late);\nconst late = 1 / 2 / 3;\nlet never;"),
    (19, 7, "async function idle() {\n  await one;\n  await two;\n  await three;\n  readFileSync(text);\n}"),
    (20, 7, "if (a) { } else if (b) { } else if (c) { } else if (d) { } else if (e) { } else if (f) { } else { }"),
    (21, 8, "}"),
    (22, 9, "function left(a, b, c, d, e, f, g) {"),
    (23, 9, "if (a) { if (b) { while (c) { try { switch (d) { case 1: if (e) { if (f) { stop(); } } } } catch (x) { log(x.code instanceof Error); } } } }"),
]
VIEWS["piece"] = values([(k, j, every, line) for k, every, text in PIECES for j, line in enumerate(text.split("\n"))], "k, j, every_n, text")
VIEWS["block_line"] = """
        SELECT d.source AS repo, 'src/f' || CAST(d.doc_id AS VARCHAR(20)) || CASE d.doc_id % 3 WHEN 0 THEN '.test.ts' ELSE '.ts' END AS path,
               CAST(row_number() OVER (PARTITION BY d.doc_id ORDER BY s.k, s.j) AS INT) AS line_no, s.text
        FROM documents d JOIN piece s ON (d.doc_id + s.k) % s.every_n = 0"""
NEEDS["block_line"] = ("piece",)

#: The lexer one character at a time: m mode, o code so far, k signs to skip, s braces open in each interpolation, p last sign of code.
LEXED = r"""
file AS (SELECT repo, path, string_agg(text, chr(10) ORDER BY line_no) AS whole FROM block_line GROUP BY repo, path),
sign AS (SELECT repo, path, list_zip(string_split(whole, ''), list_append(string_split(whole, '')[2:], '')) AS signs FROM file),
read AS (SELECT repo, path, list_reduce(signs, lambda a, z: CASE
    WHEN a.k > 0 THEN {'m': a.m, 'o': a.o || ' ', 'k': a.k - 1, 's': a.s, 'p': a.p}
    WHEN z[1] = chr(10) THEN {'m': CASE WHEN a.m IN ('b', 't') THEN a.m ELSE 'c' END, 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]}
    WHEN a.m = 'f' AND z[1] BETWEEN 'a' AND 'z' THEN {'m': 'f', 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p}
    WHEN a.m IN ('c', 'f') THEN CASE
        WHEN z[1] = '/' AND z[2] = '/' THEN {'m': 'l', 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p}
        WHEN z[1] = '/' AND z[2] = '*' THEN {'m': 'b', 'o': a.o || ' ', 'k': 1, 's': a.s, 'p': a.p}
        WHEN z[1] IN (chr(39), '"') THEN {'m': z[1], 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]}
        WHEN z[1] = '`' THEN {'m': 't', 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]}
        WHEN z[1] = '/' AND contains('(,=:[!&|?{};+*%<>~^-' || chr(10), a.p) THEN {'m': 'r', 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]}
        WHEN z[1] = '{' AND len(a.s) > 0 THEN {'m': 'c', 'o': a.o || z[1], 'k': 0, 's': list_append(a.s[:-2], a.s[-1] + 1), 'p': z[1]}
        WHEN z[1] = '}' AND len(a.s) > 0 AND a.s[-1] = 1 THEN {'m': 't', 'o': a.o || ' ', 'k': 0, 's': a.s[:-2], 'p': z[1]}
        WHEN z[1] = '}' AND len(a.s) > 0 THEN {'m': 'c', 'o': a.o || z[1], 'k': 0, 's': list_append(a.s[:-2], a.s[-1] - 1), 'p': z[1]}
        ELSE {'m': 'c', 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': CASE WHEN z[1] = ' ' THEN a.p ELSE z[1] END} END
    WHEN a.m = 'l' THEN {'m': 'l', 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p}
    WHEN a.m = 'b' THEN CASE WHEN z[1] = '*' AND z[2] = '/' THEN {'m': 'c', 'o': a.o || ' ', 'k': 1, 's': a.s, 'p': a.p} ELSE {'m': 'b', 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p} END
    WHEN z[1] = chr(92) THEN {'m': a.m, 'o': a.o || ' ', 'k': 1, 's': a.s, 'p': a.p}
    WHEN a.m = 't' THEN CASE
        WHEN z[1] = '`' THEN {'m': 'c', 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]}
        WHEN z[1] = '$' AND z[2] = '{' THEN {'m': 'c', 'o': a.o || ' ', 'k': 1, 's': list_append(a.s, 1), 'p': '{'}
        ELSE {'m': 't', 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p} END
    WHEN a.m = 'x' THEN {'m': CASE WHEN z[1] = ']' THEN 'r' ELSE 'x' END, 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p}
    WHEN a.m = 'r' THEN CASE WHEN z[1] = '/' THEN {'m': 'f', 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]} ELSE {'m': CASE WHEN z[1] = '[' THEN 'x' ELSE 'r' END, 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p} END
    WHEN z[1] = a.m THEN {'m': 'c', 'o': a.o || z[1], 'k': 0, 's': a.s, 'p': z[1]}
    ELSE {'m': a.m, 'o': a.o || ' ', 'k': 0, 's': a.s, 'p': a.p} END,
  {'m': 'c', 'o': '', 'k': 0, 's': CAST([] AS INT[]), 'p': chr(10)}).o AS code FROM sign),
lexed_line AS (SELECT repo, path, CAST(generate_subscripts(string_split(code, chr(10)), 1) AS INT) AS line_no, unnest(string_split(code, chr(10))) AS code FROM read)"""
#: What stands before each brace: t the statement so far, d brackets open, s what stands outside the braces open, h the heads.
HEADS = r"""
head_list AS (SELECT repo, path, code, list_reduce(string_split(code, ''), lambda a, c: CASE
    WHEN c = '{' THEN {'t': '', 'd': 0, 's': list_append(a.s, {'t': a.t, 'd': a.d}), 'h': list_append(a.h, trim(right(a.t, 400)))}
    WHEN c = '}' AND len(a.s) > 0 AND a.s[-1].d > 0 THEN {'t': a.s[-1].t || '{}', 'd': a.s[-1].d, 's': a.s[:-2], 'h': list_append(a.h, NULL)}
    WHEN c = '}' THEN {'t': '', 'd': 0, 's': a.s[:-2], 'h': list_append(a.h, NULL)}
    WHEN c = ';' AND a.d = 0 THEN {'t': '', 'd': 0, 's': a.s, 'h': a.h}
    WHEN c = chr(10) THEN {'t': right(a.t || ' ', 400), 'd': a.d, 's': a.s, 'h': a.h}
    ELSE {'t': a.t || c, 'd': CASE c WHEN '(' THEN a.d + 1 WHEN ')' THEN greatest(a.d - 1, 0) ELSE a.d END, 's': a.s, 'h': a.h} END,
  {'t': '', 'd': 0, 's': CAST([] AS STRUCT(t VARCHAR, d INT)[]), 'h': CAST([] AS VARCHAR[])}).h AS heads FROM read),
seg_list AS (SELECT repo, path, line_no, unnest(range(len(string_split_regex(code, '[{}]')))) AS part, unnest(string_split_regex(code, '[{}]')) AS code, unnest(list_resize(regexp_extract_all(code, '[{}]'), len(string_split_regex(code, '[{}]')), NULL)) AS brace FROM lexed_line),
seg_number AS (SELECT *, line_no * 1000 + part AS pos, count(brace) OVER (PARTITION BY repo, path ORDER BY line_no, part) AS nth, coalesce(sum(CASE brace WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line_no, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM seg_list),
seg AS (SELECT s.*, CASE WHEN brace = '{' THEN heads[nth] END AS head FROM seg_number s JOIN head_list USING (repo, path)),
span_open AS (SELECT o.repo, o.path, o.line_no AS start, o.pos, o.level, o.head,
                     (SELECT arg_min({'pos': c.pos, 'line': c.line_no, 'brace': c.brace}, c.pos) FROM seg c WHERE c.repo = o.repo AND c.path = o.path AND c.pos > o.pos AND ((c.brace = '}' AND c.level = o.level + 1) OR (c.brace = '{' AND c.level = o.level))) AS z
              FROM seg o WHERE brace = '{')"""


def duck(expression: str) -> str:
    """A Spark condition as DuckDB reads it."""
    out = expression.replace("\\\\", "\\").replace("rlike(", "regexp_matches(").replace("size(", "len(").replace("startswith(", "starts_with(")
    return re.sub(r"exists\(parameters, p -> (.*)\)$", r"len(list_filter(parameters, lambda p: \1)) > 0", out)


def first(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(head, {literal(p)}) THEN '{name}'" for name, p in rules) + f" ELSE '{otherwise}' END"


NAMED = "kind IN ('function', 'method', 'arrow')"
SPANS = rf"""
span_kind AS (SELECT *, CASE WHEN z.brace = '}}' THEN z.pos END AS end_at, CASE WHEN z.brace = '}}' THEN z.line END AS "end", {first(S.KINDS, "block")} AS kind,
                     CASE WHEN regexp_matches(head, '(?:=>|\bfunction\b.*)$') THEN regexp_extract(head, {literal(S.CALLED)}, 1) ELSE '' END AS called,
                     regexp_matches(head, '\basync\b') AS is_async, regexp_extract(head, {literal(S.PARAMETERS)}, 1) AS inside, regexp_extract(head, '(?:^|[(,=:\s])(\w+)\s*=>$', 1) AS single FROM span_open),
span AS (SELECT *, string_split(called, '.')[-1] AS called_last, '' AS raw,
                CASE WHEN kind = 'function' THEN regexp_extract(head, '\bfunction\b\s*\*?\s*(\w+)', 1) WHEN kind = 'arrow' THEN regexp_extract(head, {literal(S.ARROW_NAME)}, 1)
                     WHEN kind IN ('class', 'interface', 'enum') THEN regexp_extract(head, '\b(?:class|interface|namespace|enum)\s+(\w+)', 1) WHEN kind = 'method' THEN regexp_extract(head, {literal(S.METHOD_NAME)}, 1) ELSE '' END AS name,
                CASE WHEN {NAMED} THEN list_filter(list_transform(string_split(regexp_replace(regexp_replace(CASE WHEN kind = 'arrow' AND inside = '' AND single <> '' THEN single ELSE inside END, '\([^()]*\)', '', 'g'), '<[^<>]*>|\[[^\[\]]*\]', '', 'g'), ','), lambda p: trim(p)), lambda p: p <> '') END AS parameters,
                lead(kind) OVER (PARTITION BY repo, path, level ORDER BY pos) AS next_kind, lead(kind, 2) OVER (PARTITION BY repo, path, level ORDER BY pos) AS after_kind FROM span_kind),
seg_at AS (SELECT s.repo, s.path, s.line_no, s.part, s.pos, any_value(s.code) AS code, any_value(s.brace) AS brace, """ + ", ".join(f"count(*) FILTER ({duck(test)}) AS {name}" for name, test in S.DEPTHS.items() if name != "scrolls") + """, 0 AS scrolls
           FROM (SELECT repo, path, line_no, part, pos, code, brace FROM seg) s LEFT JOIN span ON span.repo = s.repo AND span.path = s.path AND span.pos < s.pos AND (span.end_at IS NULL OR s.pos <= span.end_at) GROUP BY s.repo, s.path, s.line_no, s.part, s.pos)"""  # fmt: skip
COUNTS = ", ".join(f"coalesce(sum(len(regexp_extract_all(s.code, {literal(p)}))), 0) AS {name}" for name, p in S.COUNTED.items())
FULL = rf"""
span_count AS (SELECT p.repo, p.path, p.pos, {COUNTS}, coalesce(sum(len(regexp_extract_all(s.code, {literal(S.BRANCHES)}))), 0) AS branching, coalesce(sum(len(regexp_extract_all(s.code, {literal(S.BRANCHES)})) * (s.weights + 1)), 0) AS weight
               FROM span p JOIN seg_at s ON s.repo = p.repo AND s.path = p.path AND s.pos > p.pos AND s.pos <= p.end_at GROUP BY p.repo, p.path, p.pos),
span_opened AS (SELECT p.repo, p.path, p.pos, """ + ", ".join(f"count(*) FILTER ({duck(re.sub(r'\b(kind|called|raw)\b', r'i.\1', test))}) AS {name}" for name, test in S.OPENED.items() if name != "error_tests") + rf""", 0 AS error_tests
                FROM span p LEFT JOIN span i ON i.repo = p.repo AND i.path = p.path AND i.pos > p.pos AND i.pos <= p.end_at GROUP BY p.repo, p.path, p.pos),
full_span AS (SELECT p.*, c.* EXCLUDE (repo, path, pos), o.* EXCLUDE (repo, path, pos), {", ".join(f"a.{d} AS at_{d}" for d in S.DEPTHS)}, c.weight - a.weights * c.branching + c.joins AS cognitive
              FROM span p JOIN span_count c USING (repo, path, pos) JOIN span_opened o USING (repo, path, pos) JOIN seg_at a USING (repo, path, pos) WHERE p.end_at IS NOT NULL)"""  # fmt: skip
TREE = f"{LEXED}, {HEADS}, {SPANS}, {FULL}"


@query("r22_lexed_lines", "block_line", f"WITH {LEXED} SELECT b.repo, b.path, b.line_no, c.code FROM block_line b JOIN lexed_line c USING (repo, path, line_no)")
def _(s):
    return S.lex(s.view("block_line")).select("repo", "path", "line_no", "code")


@query("r31_function_spans", "block_line", f"""WITH {TREE} SELECT repo, path, kind, name, start, "end", CAST(len(parameters) AS INT) AS parameters, CAST(decisions + 1 AS BIGINT) AS complexity, CAST(cognitive AS BIGINT) AS cognitive FROM full_span WHERE {NAMED}""")
def _(s):
    return S.functions(S.tree(S.lex(s.view("block_line"))))


INSIDE = " UNION ALL ".join(
    f"SELECT DISTINCT repo, path, line_no AS line, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity FROM seg_at WHERE regexp_matches(code, {literal(r.pattern)}) AND ({duck(r.where)} OR regexp_matches(code, {literal('|'.join(f'{b}(?:{r.pattern})' for b in r.behind) or 'a^')}))" for r in R.INSIDE
)
ABOUT = " UNION ALL ".join(f"""SELECT repo, path, start AS line, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity FROM full_span WHERE {duck(r.where).replace("(end - start", '("end" - start').replace("{{", "{")}""" for r in R.ABOUT)


@query("r32_scan_catalog_inside", "block_line", f"WITH {TREE} {INSIDE}")
def _(s):
    return R.scan_inside(S.tree(S.lex(s.view("block_line")), counts=False))


@query("r32_scan_catalog_about", "block_line", f"WITH {TREE} {ABOUT}")
def _(s):
    return R.scan_about(S.spans(S.tree(S.lex(s.view("block_line")))))


WITHIN = """s.pos > p.pos AND s.pos <= p.end_at"""
CALLS = rf"""SELECT DISTINCT p.repo, p.path, p.start AS line, 'RTE-012' AS rule_id, 'critical' AS severity FROM full_span p JOIN seg s ON s.repo = p.repo AND s.path = p.path AND {WITHIN} WHERE kind = 'function' AND name <> '' AND branches = 0 AND list_contains(regexp_extract_all(s.code, '(?:^|[^.\w$])(\w+)\s*\(', 1), p.name)
    UNION ALL SELECT DISTINCT p.repo, p.path, p.start, 'RTE-015', 'error' FROM full_span p JOIN seg s ON s.repo = p.repo AND s.path = p.path AND {WITHIN} WHERE kind = 'loop' AND list_contains(regexp_extract_all(s.code, '(\w+)\s*\.\s*(?:splice|push|unshift|shift|pop)\s*\(', 1), regexp_extract(p.head, '\bfor\s*\([^;]*;[^;]*?(\w+)\s*\.\s*length\b[^;]*;', 1))
    UNION ALL SELECT DISTINCT repo, path, line_no, 'RTE-013', 'warning' FROM seg WHERE regexp_extract(code, '(?:^|[^.\w$])(\w+)\s*\(\s*(\w+)\s*\(', 1) <> '' AND regexp_extract(code, '(?:^|[^.\w$])(\w+)\s*\(\s*(\w+)\s*\(', 1) = regexp_extract(code, '(?:^|[^.\w$])(\w+)\s*\(\s*(\w+)\s*\(', 2)"""


@query("r32_scan_catalog_calls", "block_line", f"WITH {TREE} {CALLS}")
def _(s):
    nodes = S.tree(S.lex(s.view("block_line")))
    return R.scan_calls(nodes, S.spans(nodes))


CHAINS = r"""SELECT repo, path, line_no AS line, 'ASY-006' AS rule_id, 'warning' AS severity FROM (SELECT *, regexp_matches(code, '^\s*await\s[^;]*;?\s*$') AND brace IS NULL AND part = 0 AS bare, lag(regexp_matches(code, '^\s*await\s[^;]*;?\s*$') AND brace IS NULL AND part = 0) OVER w AS b1, lag(regexp_matches(code, '^\s*await\s[^;]*;?\s*$') AND brace IS NULL AND part = 0, 2) OVER w AS b2 FROM seg WHERE brace IS NOT NULL OR regexp_matches(code, '\S') WINDOW w AS (PARTITION BY repo, path ORDER BY pos)) WHERE bare AND b1 AND b2
    UNION ALL SELECT repo, path, min(start), 'CMX-012', 'warning' FROM (SELECT *, sum(CASE WHEN regexp_matches(head, '^else\b') THEN 0 ELSE 1 END) OVER (PARTITION BY repo, path, level ORDER BY pos) AS chain FROM span) WHERE kind = 'if' OR regexp_matches(head, '^else\b') GROUP BY repo, path, level, chain HAVING count(*) >= 7"""


@query("r32_scan_catalog_chains", "block_line", f"WITH {TREE} {CHAINS}")
def _(s):
    nodes = S.tree(S.lex(s.view("block_line")), counts=False)
    return R.scan_chains(nodes, S.spans(nodes, counts=False))


BALANCE = " UNION ALL ".join(f"SELECT repo, path, 1 AS line, '{rule}' AS rule_id, 'critical' AS severity FROM lexed_line GROUP BY repo, path HAVING sum(len(code) - len(replace(code, '{a}', ''))) <> sum(len(code) - len(replace(code, '{b}', '')))" for rule, a, b in (("SYN-001", "{", "}"), ("SYN-002", "(", ")"), ("SYN-003", "[", "]")))


@query("r32_scan_catalog_brackets", "block_line", f"WITH {LEXED} {BALANCE}")
def _(s):
    return R.scan_brackets(S.lex(s.view("block_line")))


@query("r32_scan_catalog_scopes", "block_line")
def _(s):
    return scopes.scan_scopes(scopes.bindings(S.tree(S.lex(s.view("block_line")), counts=False)))


@query("r21_shadowed_names", "block_line")
def _(s):
    return scopes.bindings(S.tree(S.lex(s.view("block_line")), counts=False)).where(F.col("shadows")).select("repo", "path", "name", "sort", "line", "references")


NAME = r"[A-Za-z_$][\w$]*"
STRUCTURE = rf"""
held AS (SELECT s.*, p.kind AS inside FROM seg s LEFT JOIN span p ON p.repo = s.repo AND p.path = s.path AND p.level = s.level - 1 AND p.pos < s.pos AND (p.end_at IS NULL OR s.pos <= p.end_at)),
said AS (SELECT repo, path, unnest(regexp_extract_all(code, '\b(?:const|let|var|class)\s+({NAME})', 1)) AS name FROM seg
    UNION ALL SELECT repo, path, name FROM span WHERE kind = 'function' AND name <> '' AND regexp_matches(head, '^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b')
    UNION ALL SELECT repo, path, regexp_extract(p, '^(?:\.\.\.\s*|(?:public|private|protected|readonly)\s+)*({NAME})', 1) FROM (SELECT repo, path, unnest(parameters) AS p FROM span WHERE {NAMED})
    UNION ALL SELECT repo, path, regexp_extract(head, '^catch\s*\(\s*({NAME})', 1) FROM span WHERE kind = 'catch'
    UNION ALL SELECT s.repo, s.path, s.name FROM (SELECT repo, path, pos, unnest(regexp_extract_all(regexp_replace(code, '{NAME}\s*:\s*|\btype\s+|{NAME}\s+as\s+|=[^,]*', '', 'g'), '({NAME})', 1)) AS name FROM held WHERE inside = 'names') s
              JOIN span p ON p.repo = s.repo AND p.path = s.path AND p.kind = 'names' AND s.pos > p.pos AND s.pos <= p.end_at WHERE regexp_extract(p.head, '\b(const|let|var|import|export)\b', 1) IN ('const', 'let', 'var') AND s.name <> 'from'),
declared AS (SELECT repo, path, name, count(*) AS n FROM said WHERE name <> '' GROUP BY ALL),
word AS (SELECT repo, path, unnest(regexp_extract_all(replace(CASE WHEN inside = 'object' THEN regexp_replace(code, '(^|,)\s*{NAME}\s*:', '\1 ', 'g') ELSE code END, '...', ' '), {literal(scopes.USE)}, 1)) AS name FROM held),
used AS (SELECT repo, path, name, count(*) AS n FROM word GROUP BY ALL),
name_count AS (SELECT repo, path, count(*) AS names, count(*) FILTER (used.n > declared.n) AS shared FROM declared LEFT JOIN used USING (repo, path, name) GROUP BY repo, path),
shape AS (SELECT p.repo, p.path, count(*) FILTER ({NAMED} AND p."end" IS NOT NULL) AS functions, count(*) FILTER ({NAMED} AND p."end" - p.start + 1 > 40) AS long_functions, coalesce(max(CASE WHEN kind IN ('if', 'loop', 'switch', 'try') THEN a.nested + 1 END), 0) AS nesting FROM span p JOIN seg_at a USING (repo, path, pos) GROUP BY p.repo, p.path),
file_import AS (SELECT repo, path, count(*) FILTER (spec <> '' AND NOT starts_with(spec, '.')) AS external FROM (SELECT repo, path, regexp_extract(text, {literal(structure.SPECIFIER)}, 1) AS spec FROM block_line) GROUP BY repo, path),
score AS (SELECT i.repo, i.path, coalesce(functions, 0) AS functions, external, coalesce(nesting, 0) AS nesting, coalesce(long_functions, 0) AS long_functions,
                 CAST(greatest(0, least(100, floor(100 - 20 * external / greatest(coalesce(functions, 0), 1) + 0.5))) AS BIGINT) AS coupling, CAST(CASE WHEN names > 0 THEN floor(100 * shared / names + 0.5) ELSE 100 END AS BIGINT) AS cohesion
          FROM file_import i LEFT JOIN shape USING (repo, path) LEFT JOIN name_count USING (repo, path)),
total AS (SELECT *, (coupling * 3 + cohesion * 3 + greatest(0, 100 - 15 * least(long_functions, 10)) * 2 + greatest(0, 100 - 10 * nesting) * 2) / 10 AS composite FROM score)"""


@query("a22_structure_grade", "block_line", f"WITH {TREE}, {STRUCTURE} SELECT *, CASE WHEN composite >= 85 THEN 'A' WHEN composite >= 70 THEN 'B' WHEN composite >= 55 THEN 'C' WHEN composite >= 40 THEN 'D' ELSE 'F' END AS grade FROM total")
def _(s):
    lexed = S.lex(s.view("block_line"))
    return structure.structure_grade(lexed, S.tree(lexed))
