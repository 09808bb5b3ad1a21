"""Catalog rules about what lies inside what: loops, functions, handlers, callbacks, tests and scopes of names."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.operators.scratch import deal
from lintlake.operators.syntax import FILE, PLACE, cognitive, spans

ANY_LOOP = "loops > 0 OR lists > 0"
ANY_LIST = "loops > 0 OR lists > 0 OR filters > 0"
#: A loop or list callback that has no braces of its own.
BARE_LOOP = r"\b(?:for|while)\s*\(.*"
BARE_LIST = r"\.(?:forEach|map|reduce|flatMap)\s*\(.*"


class Inside(NamedTuple):
    """A pattern in a piece of code that lies where a condition on the spans round it holds, or behind a pattern on its own piece."""

    rule_id: str
    severity: str
    pattern: str
    where: str
    behind: tuple[str, ...] = ()


class About(NamedTuple):
    """A condition on a span and the counts inside it."""

    rule_id: str
    severity: str
    where: str


#: Fixed values.
INSIDE = [
    Inside("PRF-001", "error", r"\b(?:querySelector|querySelectorAll|getElementById|getElementsByClassName|getElementsByTagName)\s*\(", ANY_LIST, (BARE_LOOP, BARE_LIST)),
    Inside("PRF-002", "warning", r"\.(?:find|findIndex|indexOf|includes|some|filter)\s*\(", ANY_LIST, (BARE_LOOP, BARE_LIST)),
    Inside("PRF-004", "error", r"\bawait\b", ANY_LOOP, (BARE_LOOP, BARE_LIST)),
    Inside("PRF-005", "info", r"\.(?:sort|reverse|slice|concat)\s*\(|JSON\.(?:parse|stringify)\s*\(|\bstructuredClone\s*\(|Object\.(?:keys|values|entries)\s*\(", ANY_LOOP, (BARE_LOOP, BARE_LIST)),
    Inside("PRF-008", "info", r"\bnew\s+RegExp\b|\.(?:match|test|replace|matchAll|search|split)\s*\(\s*/", ANY_LIST, (BARE_LOOP, BARE_LIST)),
    Inside("PRF-009", "warning", r"\.(?:offsetTop|offsetLeft|offsetWidth|offsetHeight|scrollTop|scrollLeft|scrollWidth|scrollHeight|clientTop|clientLeft|clientWidth|clientHeight|getBoundingClientRect)\b|\bgetComputedStyle\b", "scrolls > 0"),
    Inside("ASY-002", "warning", r"\bawait\b", "counted_loops > 0", (r"\b(?:for|while)\s*\(.*",)),
    Inside("ASY-005", "info", r"\.then\b", "async_functions > 0"),
    Inside("ASY-010", "warning", r"\.addEventListener\s*\(", "loops > 0", (BARE_LOOP,)),
    Inside("ASY-011", "warning", r"\b(?:readFileSync|writeFileSync|appendFileSync|readdirSync|statSync|lstatSync|existsSync|mkdirSync|rmSync|copyFileSync|readSync|writeSync|execSync|spawnSync|execFileSync)\s*\(", "true"),
    Inside("ASY-012", "error", r"\bthrow\b", "timers > 0"),
    Inside("RTE-008", "error", r"\bJSON\.parse\s*\(", "tries = 0"),
    Inside("TST-002", "warning", r"\b(?:setTimeout|setInterval)\s*\(", "in_tests > 0"),
    Inside("LOG-010", "info", r"(?:^|[^.\w$])if\s*\(", "true"),
]
NAMED = "kind IN ('function', 'method', 'arrow')"
LINES = "(end - start + 1)"
ABOUT = [
    About("ASY-001", "error", f"{NAMED} AND is_async AND awaits = 0 AND promises = 0"),
    About("ASY-008", "warning", "kind = 'function' AND is_async AND awaits = 0"),
    About("ERR-004", "error", "kind = 'try' AND resources > 0 AND NOT coalesce(next_kind = 'finally' OR (next_kind = 'catch' AND after_kind = 'finally'), false)"),
    About("ERR-006", "warning", f"kind = 'try' AND {LINES} > 50"),
    About("ERR-007", "warning", "kind = 'try' AND at_handlers >= 2"),
    About("ERR-011", "info", r"kind = 'catch' AND rlike(head, '^catch\\s*\\(') AND signs > 0 AND narrowing = 0 AND NOT (throws = 1 AND statements = 1)"),
    About("RTE-011", "critical", r"kind = 'loop' AND rlike(head, '\\bwhile\\s*\\(\\s*(?:true|1)\\s*\\)$|\\bfor\\s*\\(\\s*;\\s*;\\s*\\)$') AND exits = 0"),
    About("RTE-018", "warning", "kind = 'switch' AND defaults = 0"),
    About("TYP-002", "warning", rf"(kind = 'function' OR (kind IN ('method', 'arrow') AND name NOT IN ('', 'constructor'))) AND NOT rlike(head, '\\)\\s*:\\s*[^=()]+(?:=>)?$')"),
    About("TYP-013", "error", f"{NAMED} AND exists(parameters, p -> NOT rlike(p, '[:=]|^\\\\.\\\\.\\\\.|^[{{]|^this$'))"),
    About("CMX-001", "warning", f"{NAMED} AND {LINES} > 50"),
    About("CMX-002", "warning", f"{NAMED} AND name <> 'constructor' AND size(parameters) > 5"),
    About("CMX-003", "warning", f"kind = 'class' AND {LINES} > 500"),
    About("CMX-005", "warning", "kind = 'class' AND methods > 20"),
    About("CMX-006", "warning", f"kind = 'method' AND name = 'constructor' AND {LINES} > 100"),
    About("CMX-007", "warning", "kind IN ('if', 'loop', 'switch', 'try') AND at_nested = 5"),
    About("CMX-008", "warning", f"{NAMED} AND name <> 'constructor' AND decisions + 1 > 10"),
    About("CMX-009", "warning", f"{NAMED} AND name <> 'constructor' AND cognitive > 15"),
    About("CMX-011", "warning", "called <> '' AND kind IN ('function', 'arrow') AND at_callbacks = 3"),
    About("CMX-017", "warning", f"{NAMED} AND size(parameters) >= 7"),
    About("AIP-005", "info", f"kind = 'try' AND calls = 0 AND {LINES} <= 4"),
    About("AIP-008", "error", "kind = 'catch' AND (signs = 0 OR (console > 0 AND console >= statements AND throws = 0 AND returns = 0))"),
    About("TST-001", "error", "called IN ('it', 'test') AND asserts = 0"),
    About("TST-006", "info", "called IN ('it', 'test') AND expects >= 5"),
    About("TST-008", "info", r"called = 'describe' AND rlike(path, '\\.(?:test|spec)\\.(?:ts|js|tsx|jsx)$') AND test_spans >= 2 AND error_tests = 0"),
]
#: Rules whose conditions are more than one piece or span, and the rules of scopes.
OTHERS = {"ASY-006": "warning", "CMX-012": "warning", "RTE-012": "critical", "RTE-013": "warning", "RTE-015": "error", "SYN-001": "critical", "SYN-002": "critical", "SYN-003": "critical"}


def scan_inside(nodes: DataFrame) -> DataFrame:
    """(repo, path, line, rule_id, severity): rules of INSIDE, one finding a line and rule; findings are dealt out by the rows they come from."""
    hits = [
        F.when(F.col("code").rlike(r.pattern) & (F.expr(r.where) | F.col("code").rlike("|".join(f"{b}(?:{r.pattern})" for b in r.behind) or "a^")), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity")))
        for r in INSIDE
    ]
    found = nodes.select(*FILE, F.col("line_no").alias("line"), F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return deal(found, nodes.count(), *FILE, each=1 << 17).distinct()


def scan_about(tree_spans: DataFrame) -> DataFrame:
    """The same for rules of ABOUT, one finding a span."""
    seen = tree_spans.where("end IS NOT NULL").withColumn("cognitive", cognitive())
    hits = [F.when(F.expr(r.where), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in ABOUT]
    return seen.select(*FILE, F.col("start").alias("line"), F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def _found(df: DataFrame, rule: str, line: str) -> DataFrame:
    return df.select(*FILE, F.col(line).alias("line"), F.lit(rule).alias("rule_id"), F.lit(OTHERS[rule]).alias("severity"))


def scan_chains(nodes: DataFrame, tree_spans: DataFrame) -> DataFrame:
    """ASY-006, the third of statements in a row that only await; CMX-012, chains of seven branches and more."""
    here = W.partitionBy(*FILE).orderBy(*PLACE)
    bare = F.col("code").rlike(r"^\s*await\s[^;]*;?\s*$") & F.col("brace").isNull() & (F.col("part") == 0)
    solid = deal(nodes.where("brace IS NOT NULL OR rlike(code, '\\\\S')").select(*FILE, *PLACE, bare.alias("bare")), nodes.count(), *FILE, each=1 << 17)
    third = solid.withColumn("third", F.col("bare") & F.coalesce(F.lag("bare", 1).over(here), F.lit(False)) & F.coalesce(F.lag("bare", 2).over(here), F.lit(False))).where("third")
    order = W.partitionBy(*FILE, "level").orderBy("start", "start_part")
    goes_on = F.col("head").rlike(r"^else\b")
    chains = tree_spans.withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(order)).where((F.col("kind") == "if") | goes_on)
    long = chains.groupBy(*FILE, "level", "chain").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n")).where("n >= 7")
    return _found(third, "ASY-006", "line_no").unionByName(_found(long, "CMX-012", "start"))


def scan_calls(nodes: DataFrame, tree_spans: DataFrame) -> DataFrame:
    """RTE-012, functions that call themselves without a branch; RTE-013, a function of itself; RTE-015, arrays that a loop over their length changes.

    Calls meet the few spans that ask for their names by equality of file and name; the place decides afterwards. Both grow with the files,
    so both are dealt out by rows and neither is sent to every task.
    """
    rows = nodes.count()
    calls = nodes.select(*FILE, *PLACE, F.explode(F.regexp_extract_all("code", F.lit(r"(?:^|[^.\w$])(\w+)\s*\("), F.lit(1))).alias("name"))
    changes = nodes.select(*FILE, *PLACE, F.explode(F.regexp_extract_all("code", F.lit(r"(\w+)\s*\.\s*(?:splice|push|unshift|shift|pop)\s*\("), F.lit(1))).alias("name"))
    after = (F.col("line_no") > F.col("start")) | ((F.col("line_no") == F.col("start")) & (F.col("part") > F.col("start_part")))
    within = after & ((F.col("line_no") < F.col("end")) | ((F.col("line_no") == F.col("end")) & (F.col("part") <= F.col("end_part"))))

    def met(asking: DataFrame, names: DataFrame) -> DataFrame:
        sides = [deal(df, rows, *FILE, "name", each=1 << 17) for df in (asking, names)]
        return sides[0].join(sides[1].hint("merge"), [*FILE, "name"]).where(within).select(*FILE, "start", "start_part").distinct()

    place = [*FILE, "start", "start_part", "end", "end_part"]
    lonely = tree_spans.where("kind = 'function' AND name <> '' AND branches = 0").select(*place, "name")
    # a piece before a loop's first brace holds its head: the name whose length bounds it
    loops = tree_spans.where("kind = 'loop'").select(*place, F.regexp_extract("head", r"\bfor\s*\([^;]*;[^;]*?(\w+)\s*\.\s*length\b[^;]*;", 1).alias("name")).where("name <> ''")
    pair = r"(?:^|[^.\w$])(\w+)\s*\(\s*(\w+)\s*\("
    twice = nodes.where((F.regexp_extract("code", pair, 1) != "") & (F.regexp_extract("code", pair, 1) == F.regexp_extract("code", pair, 2)))
    return _found(met(lonely, calls), "RTE-012", "start").unionByName(_found(met(loops, changes), "RTE-015", "start")).unionByName(_found(twice, "RTE-013", "line_no").distinct())


BRACKETS = [("SYN-001", "{", "}"), ("SYN-002", "(", ")"), ("SYN-003", "[", "]")]


def bracket_totals(lexed: DataFrame) -> DataFrame:
    """(repo, path, rule_id, amount): by how many a file opens brackets more or less often than it closes them, outside of strings and comments."""
    of = lambda sign: F.sum(F.length("code") - F.length(F.replace("code", F.lit(sign))))
    sums = lexed.groupBy(*FILE).agg(*[(of(a) - of(b)).alias(rule) for rule, a, b in BRACKETS])
    each = F.array(*[F.when(F.col(f"`{r}`") != 0, F.struct(F.lit(r).alias("rule_id"), F.abs(F.col(f"`{r}`")).cast("long").alias("amount"))) for r, _, _ in BRACKETS])
    return sums.select(*FILE, F.inline(F.filter(each, lambda x: x.isNotNull())))


def scan_brackets(lexed: DataFrame) -> DataFrame:
    """SYN-001 to 003: files of bracket_totals(). line is 1."""
    return bracket_totals(lexed).select(*FILE, F.lit(1).alias("line"), "rule_id", F.lit("critical").alias("severity"))


def scan_spans(lexed: DataFrame, nodes: DataFrame) -> DataFrame:
    """All rules of this module: repo, path, line, rule_id, severity. nodes is tree(lexed)."""
    found = spans(nodes)
    parts = (scan_inside(nodes), scan_about(found), scan_chains(nodes, found), scan_calls(nodes, found), scan_brackets(lexed))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
