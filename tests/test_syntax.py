"""Lexer state, spans, span rules and scopes: known answers, and the same answers for every size of block."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import catalog, scopes, span_rules
from lintlake.operators import syntax as S

SCHEMA = "repo string, path string, line_no int, text string"


def lines(spark, files):
    return spark.createDataFrame([("r", path, i + 1, t) for path, text in files.items() for i, t in enumerate(text.split("\n"))], SCHEMA).repartition(3)


def rules(spark, text, path="a.ts"):
    lexed = S.lex(lines(spark, {path: text}))
    nodes = S.tree(lexed)
    found = span_rules.scan_spans(lexed, nodes).select("line", "rule_id").unionByName(scopes.scan_scopes(scopes.bindings(nodes)).select("line", "rule_id"))
    return {(r.line, r.rule_id) for r in found.collect()}


@pytest.mark.parametrize(
    "text,state,code,after",
    [
        ("const open = '{';", 0, "const open = ' ';", 0),
        ("a = 'it\\'s {'; // }", 0, "a = '       ';     ", 0),
        ("x /* { */ }", 0, "x         }", 0),
        ("x /* {", 0, "x     ", 4),
        ("still */ y", 4, "         y", 0),
        ("t = `a ${ { b } } {` + c", 0, "t = `     { b }    ` + c", 0),
        ("t = `a ${ f(", 0, "t = `     f(", 1),
        ("{ x", 1, "{ x", 2),
        (") } }` }", 2, ") }  ` }", 0),
        ("no {", 8, "    ", 8),
        ("s.match(/[/{'\"]+/g)", 0, "s.match(/       / )", 0),
        ("a / b / c", 0, "a / b / c", 0),
        ("return /{/", 0, "return / /", 0),
        ('"open', 0, '"    ', 0),
    ],
)
def test_lex_line(text, state, code, after):
    assert S.lex_line(text, state) == (code, after)


def test_measured_cases(spark):
    """A brace in a string balances nothing, awaits count on any line of a loop, and another function's return ends no loop."""
    assert not [r for r in rules(spark, "const open = '{';\nuse(open);") if r[1].startswith("SYN")]
    assert {(1, "SYN-001")} <= rules(spark, "function f() {")
    assert (4, "PRF-004") in rules(spark, "for (const x of all) {\n  const y = x;\n  if (y) {\n    await send(y);\n  }\n}")
    looped = rules(spark, "while (true) {\n  spin();\n}\nfunction g() {\n  return 1;\n}\nwhile (true) {\n  if (x) { break; }\n}")
    assert (1, "RTE-011") in looped and (7, "RTE-011") not in looped


def test_rules_of_spans(spark):
    text = """async function load(a, b, c, d, e, f) {
  for await (const x of a) { await x; }
  return b.then(c);
}
try { createReadStream(b); } catch (e) { console.log(e); }
try { createReadStream(b); } catch (e) { throw e; } finally { b.close(); }
switch (a) { case 1: break; }
switch (a) { default: break; }
setTimeout(() => { if (a) { throw b; } }, 1);
it('does', () => { setTimeout(go, 1); });
it('checks', () => { expect(a).toBe(b); });
const fact = function fact(n) { return fact(n - 1); };
function down(n) { if (n) { return down(n - 1); } }
function spin(n) { return spin(n); }
for (let i = 0; i < rows.length; i++) { rows.pop(); }
for (let i = 0; i < rows.length; i++) { others.pop(); }
a(a(b));
const parsed = JSON.parse(text);
try { JSON.parse(text); } catch (e) { if (e instanceof Error) { go(); } }
async function idle() { return 1; }"""
    got = rules(spark, text)
    yes = {(1, "CMX-002"), (1, "TYP-002"), (1, "TYP-013"), (2, "PRF-004"), (3, "ASY-005"), (5, "ERR-004"), (5, "AIP-008"), (5, "ERR-011"), (7, "RTE-018"), (9, "ASY-012"), (10, "TST-001"), (10, "TST-002")}
    yes |= {(14, "RTE-012"), (15, "RTE-015"), (17, "RTE-013"), (18, "RTE-008"), (20, "ASY-001"), (20, "ASY-008")}
    no = {(2, "ASY-002"), (1, "ASY-001"), (6, "ERR-004"), (6, "ERR-011"), (8, "RTE-018"), (11, "TST-001"), (13, "RTE-012"), (16, "RTE-015"), (19, "RTE-008"), (19, "ERR-011"), (12, "SYN-001")}
    assert yes <= got and not no & got


def test_functions_with_methods_and_arrows(spark):
    text = """class Box {
  constructor(private a, b = 1) { this.a = a; }
  grow(by: number): number {
    for (const x of by) {
      if (x && by) {
        while (x) { by--; }
      } else { by++; }
    }
    return by ? 1 : 2;
  }
}
const twice = async (x, { y, z }) => {
  return x;
};
items.map((i) => { return i; });"""
    got = {(r.kind, r.name): (r.start, r.end, r.parameters, r.complexity, r.cognitive) for r in S.functions(S.tree(S.lex(lines(spark, {"a.ts": text})))).collect()}
    assert got[("method", "constructor")] == (2, 2, 2, 1, 0)
    # for 1, if 2, while 3, ternary 1 and one join
    assert got[("method", "grow")] == (3, 10, 1, 6, 8)
    assert got[("arrow", "twice")] == (12, 14, 2, 1, 0)
    assert got[("arrow", "")] == (15, 15, 1, 1, 0)


def test_scopes_of_one_name(spark):
    text = """import { a, b as c, unused } from 'x';
import whole from 'y';
use(later);
const later = 1;
let x = 1;
function f(x, y) {
  const later = x;
  { let x = 2; x++; }
  return later + a;
}
export const shown = c;
const { p, q: r } = f(whole);
function dead() { try { g(); } catch (e) { log({ x: e, r: 1 }, 'x', whole); } } // x"""
    nodes = S.tree(S.lex(lines(spark, {"a.ts": text})))
    bound = {(b.name, b.line): (b.sort, b.references, b.shadows, b.top) for b in scopes.bindings(nodes).collect()}
    assert bound[("x", 5)] == ("let", 1, False, True)
    assert bound[("x", 6)] == ("parameter of function", 2, True, False)
    assert bound[("x", 8)] == ("let", 2, True, False)
    assert bound[("later", 4)][1] == 2 and bound[("later", 7)] == ("const", 2, True, False)
    assert bound[("r", 12)][1] == 1 and bound[("c", 1)][1] == 2 and bound[("whole", 2)][1] == 3
    got = {(r.line, r.rule_id, r.name) for r in scopes.scan_scopes(scopes.bindings(nodes)).collect()}
    assert {(1, "VAR-007", "unused"), (3, "VAR-001", "later"), (5, "VAR-005", "x"), (6, "VAR-006", "y"), (13, "VAR-012", "dead"), (12, "VAR-005", "p")} <= got
    assert not {n for _, rule, n in got if rule == "VAR-007"} - {"unused"} and (11, "VAR-012", "shown") not in got


def test_blocks_compose(spark):
    """Files cut into blocks of a few lines read like whole ones, wherever a comment, a template or a call is cut."""
    text = """const a = `one {
 ${ f({
   b: 1,
 }, `in {`) } { two
` + '{'; /* {
 { */ run((x) => {
  /* } */ go(x);
}, () => {
  for (const y of x) {
    await y; // {
  }
});
"""
    files = {f"f{k}.ts": "\n" * k + text * 3 for k in range(5)} | {"none.ts": "", "quote.ts": "'\n{\n`\n}\n`"}
    rows = lines(spark, files)

    def read(block):
        lexed = S.lex(rows, block)
        return sorted((r.path, r.line_no, r.code, r.heads) for r in lexed.collect()), sorted((tuple(r) for r in span_rules.scan_inside(S.tree(lexed)).collect()), key=str)

    whole = read(4096)
    assert any(r[3] == "PRF-004" for r in whole[1])
    for block in (1, 3, 7):
        assert read(block) == whole
    for row in whole[0]:
        assert len(row[2]) == len(rows.where((F.col("path") == row[0]) & (F.col("line_no") == row[1])).first().text) if row[1] == 5 else True


def test_odd_lines(spark):
    odd = spark.createDataFrame([("r", "p", 1, None), ("r", "p", 2, "}"), ("r", "p", 2, "{ {"), (None, None, 1, "x => {")], SCHEMA)
    nodes = S.tree(S.lex(odd))
    assert S.spans(nodes).where("end IS NOT NULL").count() == 0 and S.spans(nodes).count() == 3
    assert S.functions(nodes).count() == 0
    assert S.lex(odd.limit(0)).count() == 0 and span_rules.scan_spans(S.lex(odd.limit(0)), S.tree(S.lex(odd.limit(0)))).count() == 0
    assert scopes.bindings(S.tree(S.lex(odd.limit(0)))).count() == 0


def test_rules_built(spark):
    built = catalog.rule_catalog(spark).where("has_rule").count()
    assert built >= 170


def test_structure_grade(spark):
    from lintlake.operators import structure

    text = "import a from 'far';\nimport b from './near';\nfunction long(x, unused) {\n" + "  x();\n" * 40 + "  if (x) { for (;;) { try { y(); } catch (e) { } } }\n}\nconst once = 1;\nfunction used() { return long; }\nused();"
    lexed = S.lex(lines(spark, {"a.ts": text, "empty.ts": ""}))
    got = {r.path: r for r in structure.structure_grade(lexed, S.tree(lexed)).collect()}
    a = got["a.ts"]
    # long, x, used are used; unused, e and once are not
    assert (a.functions, a.external, a.nesting, a.long_functions, a.coupling, a.cohesion) == (2, 1, 3, 1, 90, 50)
    assert a.composite == pytest.approx(27 + 15 + 17 + 14) and a.grade == "B"
    assert (got["empty.ts"].functions, got["empty.ts"].grade) == (0, "A")


def test_conflict_blocks(spark):
    from lintlake.operators import filters

    text = "top\n<<<<<<< HEAD\nours 1\n\nours 2\n=======\ntheirs\n=======\n>>>>>>> other\nbetween\n<<<<<<< a\n=======\n>>>>>>> b\n<<<<<<< never\nleft open"
    got = [tuple(r)[2:] for r in filters.conflict_blocks(lines(spark, {"a": text, "b": "=======\n>>>>>>> x"})).orderBy("first_line").collect()]
    assert got == [(2, 9, "ours 1\n\nours 2", "theirs\n=======", "ours 1\n\nours 2\ntheirs\n======="), (11, 13, "", "", "")]
