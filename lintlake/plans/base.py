"""Views over the given tables, and the register of queries.

A view is one SQL text that Spark and DuckDB both read: Spark runs it over temp views of the parquet tables, the twin
query gets it as a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.operators.scratch import deal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Source lines that the code fixture deals out: (place, every how many documents, text).
SNIPPETS: list[tuple[int, int, str]] = [
    (1, 2, "import { readFile } from 'fs';"),
    (2, 3, "import lodash from 'lodash';"),
    (3, 2, "export function load(a, b, c, d, e, f) {"),
    (4, 5, "  // quality-disable-next-line API-006"),
    (5, 3, "  console.log('loading');"),
    (6, 7, "  // TODO: remove this"),
    (7, 11, "  eval(userInput);"),
    (8, 4, "  const items: any[] = [];"),
    (9, 5, "  if (a == null ) {"),
    (10, 6, "    document.write(b);"),
    (11, 7, "    element.innerHTML = b;"),
    (12, 8, "    const password = 'hunter2hunter2';"),
    (13, 5, "  }"),
    (14, 9, "  const when = new Date().getTime();"),
    (15, 10, "  items.forEach(async (x) => { await send(x); });"),
    (16, 6, "  const n = parseInt( raw );"),
    (17, 12, "  const url = 'http://example.org/data';"),
    (18, 13, "  const api_key = 'a1b2c3d4e5f6g7h8i9j0k1';"),
    (19, 9, "  return null; // TODO"),
    (20, 9, "  cleanup();"),
    (21, 2, "}"),
    (22, 14, "function empty() {"),
    (23, 14, "}"),
    (24, 8, "// const old = compute();"),
    (25, 10, "const style = 'z-index: 999; color: #aabbcc; background: #112233';"),
    (26, 15, "// Licensed under the GNU General Public License, version 3"),
    (27, 16, "const token = 'ghp_abcdefghijklmnopqrstuvwxyz0123456789';"),
    (28, 9, "const t = x ? (y ? 1 : 2) : 3;"),
    (29, 17, "throw new Error('Not implemented');"),
    (30, 6, "for (const k of keys) { while (k) { list.push(k); } }"),
    (34, 12, "const ok = value === NaN;"),
    (36, 4, ""),
    (40, 4, ""),
    (44, 4, ""),
    (45, 6, "enum Kind { One }"),
    (46, 7, "const cast = value as any;"),
    (47, 8, "names.sort(byName);"),
    (48, 9, "use(later); const pair = ['alpha', 'alpha', 'alpha'];"),
    (49, 9, "print(first.length / total);"),
    (57, 9, "const later = 'alpha';"),
    (60, 10, "const raw = req.query.value;"),
    (61, 10, "const hit = list.find(byId);"),
    (70, 10, "eval(raw);"),
    (71, 10, "hit.name = 1;"),
    (80, 10, "if (hit) { raw.trim(); }"),
]

#: Lines with and without their counterparts in the file or on the next line, for the rules that look for these.
SCRIPT: list[tuple[int, int, str]] = [
    (1, 3, "const timer = setInterval(tick, 100);"),
    (2, 4, "fetch(address);"),
    (3, 5, "const worker = new Worker(file);"),
    (4, 2, "try { go(); } catch (e) {"),
    (5, 3, "  console.warn(e);"),
    (6, 2, "}"),
    (7, 4, "for (const x of all) {"),
    (8, 3, "  await send(x);"),
    (9, 5, "window.addEventListener('resize', draw);"),
    (10, 6, "const seen = new Map();"),
    (11, 4, "return 1;"),
    (12, 3, "const after = 2;"),
    (13, 7, "clearInterval(timer);"),
    (14, 8, "worker.terminate();"),
    (15, 9, "fetch(address, { signal });"),
    (16, 10, "window.removeEventListener('resize', draw);"),
    (17, 11, "seen.delete(key);"),
]


def literal(text: str) -> str:
    """A string literal that both engines read alike: what Spark would unescape is built from character codes."""
    if "\\" in text:
        return " || chr(92) || ".join(literal(part) for part in text.split("\\"))
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """SELECT of literal rows."""

    def one(value) -> str:
        return "NULL" if value is None else literal(value) if isinstance(value, str) else str(value)

    first, *rest = rows
    columns = [n.strip() for n in names.split(",")]
    head = "SELECT " + ", ".join(f"{one(v)} AS {c}" for v, c in zip(first, columns, strict=True))
    return head + "".join(" UNION ALL SELECT " + ", ".join(map(one, r)) for r in rest)


VIEWS: dict[str, str] = {
    "text_line": "SELECT source AS repo, CAST(doc_id AS STRING) AS path, CAST(pos + 1 AS INT) AS line_no, line AS text FROM documents LATERAL VIEW posexplode(split(text, '\n', -1)) l AS pos, line",
    "snippet": values(SNIPPETS, "k, every_n, text"),
    "code_line": """
        SELECT d.source AS repo, 'src/' || d.lang || '/f' || CAST(d.doc_id AS VARCHAR(20)) || CASE d.doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.java' END AS path,
               CASE d.doc_id % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'java' END AS language,
               CAST(row_number() OVER (PARTITION BY d.doc_id ORDER BY s.k) AS INT) AS line_no, s.text
        FROM documents d JOIN snippet s ON (d.doc_id + s.k) % s.every_n = 0""",
    "commits": """
        SELECT o_orderkey AS commit_id, o_custkey AS author, CAST(o_orderdate AS DATE) AS day,
               CASE o_orderstatus WHEN 'F' THEN 'fix: bug' WHEN 'O' THEN 'feat: add' ELSE 'chore: update' END AS message FROM orders""",
    "changes": """
        SELECT l_orderkey AS commit_id, l_partkey AS file, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS added, CAST(sum(CAST(floor(l_discount * 100 + 0.5) AS INT)) AS BIGINT) AS deleted
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "runs": """
        SELECT event_id AS run_id, user_id AS repo, event_type AS team, ts, CAST(CAST(floor(value * 10) AS INT) % 101 AS INT) AS score,
               CASE WHEN CAST(floor(value * 10) AS INT) % 101 >= 77 THEN 'pass' WHEN CAST(floor(value * 10) AS INT) % 101 >= 60 THEN 'warn' ELSE 'fail' END AS status,
               CAST(event_id % 4 AS INT) AS fixes FROM events""",
    "calls": """
        SELECT event_id AS call_id, event_type AS task, CAST(user_id % 4 AS INT) AS provider, ts, CAST(floor(value) AS BIGINT) AS tokens, event_type <> 'error' AS success FROM events""",
    "edges": """
        SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey > 1
        UNION SELECT p_partkey, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) + 1 FROM part WHERE p_partkey % 5 = 0""",
    "declared": """
        SELECT DISTINCT l_suppkey AS project, l_partkey AS package, '^' || CAST(p_size % 9 AS VARCHAR(9)) || '.1.0' AS range_text, CAST(p_size % 9 AS INT) AS wanted,
               CASE WHEN p_partkey % 3 = 0 THEN 'dev' ELSE 'prod' END AS scope FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "locked": """
        SELECT DISTINCT l_suppkey AS project, l_partkey AS package, CAST(p_size % 9 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS major_no,
               CAST(p_size % 9 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) || '.0.3' AS version, CAST(p_partkey % 12 AS INT) AS license_no, l_partkey % 4 <> 0 AS is_direct
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 11 <> 0""",
    "findings": """
        SELECT event_id AS finding_id, user_id AS repo, CAST(event_id % 97 AS INT) AS file, CAST(event_id % 40 + 1 AS INT) AS line,
               CASE event_id % 7 WHEN 0 THEN 'SEC-006' WHEN 1 THEN 'RTE-001' WHEN 2 THEN 'TYP-001' WHEN 3 THEN 'ERR-001' WHEN 4 THEN 'STL-010' WHEN 5 THEN 'API-009' ELSE 'CMX-007' END AS rule_id,
               event_type AS team, CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity,
               CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, 'finding ' || CAST(event_id % 50 AS VARCHAR(9)) AS message FROM events""",
}
VIEWS["script"] = values(SCRIPT, "k, every_n, text")
VIEWS["script_line"] = VIEWS["code_line"].replace("JOIN snippet s", "JOIN script s")
#: The one view whose explosion the engines spell differently.
TWINS = {
    "text_line": "SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, CAST(generate_subscripts(split(text, chr(10)), 1) AS INT) AS line_no, unnest(split(text, chr(10))) AS text FROM documents",
}
NEEDS = {"code_line": ("snippet",), "script_line": ("script",)}

#: Views that number lines by document: documents are dealt out first, so many to a task, and the lines stay where their document is.
DEALT = {"code_line": "doc_id", "script_line": "doc_id", "block_line": "doc_id"}

REGISTER: dict[str, tuple[Callable[[Source], DataFrame], str | None]] = {}


class Source:
    """The tables of one folder, and views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A table or view as a DataFrame; tables and views below it become temp views."""
        if name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        else:
            text = VIEWS[name]
            for below in {*NEEDS.get(name, ()), *(t for t in TABLES if re.search(rf"\b{t}\b", text))}:
                self.view(below).createOrReplaceTempView(below)
            if name in DEALT:
                documents = self.table("documents")
                deal(documents, documents.count(), DEALT[name], each=1 << 12).createOrReplaceTempView("documents")
            return self.spark.sql(text)
        return self.table(name)


def twin(views: str, text: str) -> str:
    """DuckDB SQL: the views, then the query."""
    names: list[str] = []
    for name in views.split():
        for each in (*NEEDS.get(name, ()), name):
            if each not in names and each not in TABLES:
                names.append(each)
    ctes = [f"{n} AS ({TWINS.get(n, VIEWS[n])})" for n in names]
    body = text.strip()
    if body[:5].upper() == "WITH ":
        recursive = "RECURSIVE " if " UNION SELECT " in body or " UNION ALL SELECT " in body else ""
        return f"WITH {recursive}" + ", ".join([*ctes, body[5:]])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of a Source under a name, with the twin over the named views."""

    def add(f: Callable[[Source], DataFrame]):
        if name in REGISTER:
            raise ValueError(f"{name} is registered twice")
        REGISTER[name] = (f, twin(views, sql) if sql else None)
        return f

    return add
