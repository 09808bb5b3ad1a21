"""Branches, repository health and unguarded results across files, with known answers."""

import datetime as dt

from lintlake.operators import findings as O
from lintlake.operators import history as H
from lintlake.operators import packages as P

DAY = lambda n: dt.date(2024, 6, 30) - dt.timedelta(days=n)
BRANCHES = "repo string, branch string, last_day date, author string, merged boolean, ahead int, behind int, is_default boolean"


def test_branches(spark):
    rows = [("r", "main", DAY(400), "a", True, 0, 0, True), ("r", "x", DAY(14), "a", False, 1, 2, False), ("r", "y", DAY(15), "b", None, None, 51, None), ("r", "z", DAY(31), "b", True, 3, 60, False), ("r", "w", DAY(91), None, False, 0, 50, False), ("r", "v", None, "c", False, 0, 0, False)]
    rows += [("s", f"m{k}", DAY(40), "a", True, 0, 0, False) for k in range(6)] + [("t", "main", DAY(1), "a", None, 0, 0, True)]
    b = spark.createDataFrame(rows, BRANCHES)
    got = {(r.branch, r.age, r.distance, r.severity) for r in H.branch_ages(b.where("repo = 'r'"), "2024-06-30").collect()}
    assert got == {("y", 15, "+0/-51", "info"), ("z", 31, "+3/-60", "warning"), ("w", 91, "+0/-50", "error")}
    got = {r.repo: tuple(r)[1:] for r in H.branch_summary(b, "2024-06-30").collect()}
    assert got == {"r": (5, 3, 2, 1, 4, 1, ["rebase"]), "s": (6, 0, 6, 6, 0, 0, ["delete-merged", "review-stale"]), "t": (0, 0, 0, 0, 0, 0, [])}


def test_repo_health(spark):
    commits = spark.createDataFrame([("r", k, "a" if k else "b", DAY(k), "Fix it" if k < 3 else None) for k in range(5)] + [("s", 0, "a", DAY(3), "add")], "repo string, commit_id int, author string, day date, message string")
    changes = spark.createDataFrame([("r", k, f, 90, None) for k in range(5) for f in ("x", "y", "z")] + [("r", 4, "q", 500, 1)], "repo string, commit_id int, file string, added int, deleted int")
    branches = spark.createDataFrame([("r", "x", DAY(31), "a", False, 0, 0, False)], BRANCHES)
    got = {r.repo: r.asDict() for r in H.repo_health(commits, changes, branches, "2024-06-30").collect()}
    # three files of five commits, three of them fixes: risk 30 + 60; four restless files
    assert got["r"] == {"repo": "r", "commits": 5, "contributors": 2, "last_commit_age": 0, "risky_files": 3, "restless_files": 4, "stale_branches": 1, "score": 68}
    assert got["s"] == {"repo": "s", "commits": 1, "contributors": 1, "last_commit_age": 3, "risky_files": 0, "restless_files": 0, "stale_branches": 0, "score": 100}


def test_cross_file_null(spark):
    files = {
        "a.ts": ["export function find(id) {", "  return null;", "}", "export function sure(id) {", "  return id;", "}", "export function typed(): T | undefined {", "}", "function inner() {", "  return null;", "}"],
        "b.ts": ["const x = find(1);", "use(x.name);", "const y = find(2);", "if (!y) return;", "y.name;", "const s = sure(1);", "s.name;", "const i = inner();", "i.name;", "let t = await typed();", "t.name;", "const far = find(3);", *["-"] * 10, "far.name;", "const w = find(4);", "w?.name; w.name;", "const n = find(5);", *["-"] * 9, "n.name;", "const v = find(6); xv.name;"],
        "c.ts": ["export function find(id) {", "  return undefined;", "}", "const z = find(1);", "z.name;"],
    }
    rows = [("r", p, k, t) for p, ts in files.items() for k, t in enumerate(ts, 1)] + [("other", "d.ts", 1, "const x = find(1);"), ("other", "d.ts", 2, "x.name"), ("r", "e.ts", 1, None)]
    got = {tuple(r)[1:] for r in O.cross_file_null(spark.createDataFrame(rows, "repo string, path string, line_no int, text string")).collect()}
    lines = {t: k for k, t in enumerate(files["b.ts"], 1)}
    assert got == {("b.ts", 1, "x", "find", 2), ("b.ts", 10, "t", "typed", 1), ("b.ts", lines["const n = find(5);"], "n", "find", 2), ("c.ts", 4, "z", "find", 1)}
    empty = spark.createDataFrame([], "repo string, path string, line_no int, text string")
    assert O.cross_file_null(empty).count() == 0


def test_tree_shaking(spark):
    manifests = spark.createDataFrame([("r", "package.json", '{"type": "commonjs"}'), ("s", "package.json", '{"sideEffects": false, "exports": "./x.js"}'), ("t", "package.json", "no json"), ("u", "package.json", None)], "repo string, path string, content string")
    files = [("r", f"src/m{k}/index.ts", n, t) for k in range(6) for n, t in enumerate(["export { a } from './a';", "", "  export * from './b';"], 1)]
    files += [("s", "index.js", 1, "export * from './b';"), ("s", "index.js", 2, "const a = 1;"), ("s", "a.ts", 1, "export * from './b';"), ("s", "a.ts", 2, "const _ = require( \"lodash\" );"), ("s", "a.ts", 3, "import * as React from 'react';"), ("s", "a.ts", 4, "import * as d from 'd3';"), ("s", "a.py", 1, "import _ from 'lodash'"), ("s", "a.ts", 5, None)]
    found = P.tree_shaking(spark.createDataFrame(files, "repo string, path string, line_no int, text string"), manifests)
    got = sorted((r.repo, r.path or "", r.line or 0, r.rule_id, r.severity) for r in found.collect())
    want = [("r", f"src/m{k}/index.ts", 3, "export-all", "warning") for k in range(6)] + [("r", "", 0, "many-barrels", "info")]
    want += [(r, "package.json", 0, rule, "warning") for r in "rtu" for rule in ("no-esm", "no-side-effects")]
    want += [("s", "index.js", 1, "export-all", "warning"), ("s", "a.ts", 2, "whole-library", "warning"), ("s", "a.ts", 4, "namespace-import", "warning")]
    assert got == sorted(want)
    assert {r.repo: (r.warnings, r.notices, r.score) for r in P.tree_shaking_score(found).collect()} == {"r": (7, 1, 27), "s": (3, 0, 70), "t": (2, 0, 80), "u": (2, 0, 80)}
