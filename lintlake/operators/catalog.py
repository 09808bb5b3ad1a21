"""The rule catalog as a dimension, and its line rules as one pack.

Ids are built from the families' sizes, attributes from what differs from the usual. Rules that need a type checker or resolved
symbols have no pattern here.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import family
from lintlake.operators import scopes, span_rules, syntax
from lintlake.operators.rules import Rule, unless
from lintlake.operators.scan import cap, scan_rules

#: Comment lines, which most rules skip.
COMMENT = r"^\s*(//|\*|/\*)"

#: Family, number of rules, category, quality dimension (fixed values).
FAMILIES = [
    ("SYN", 10, "syntax", "Reliability"), ("TYP", 15, "type", "Reliability"), ("VAR", 12, "variable", "Maintainability"), ("ASY", 15, "async", "Reliability"), ("ERR", 12, "error-handling", "Reliability"), ("RTE", 20, "runtime", "Reliability"), ("LOG", 20, "logic", "Maintainability"), ("API", 15, "api-misuse", "Reliability"),
    ("SEC", 27, "security", "Security"), ("CMX", 18, "complexity", "Maintainability"), ("AIP", 12, "ai-pattern", "Maintainability"), ("PRF", 10, "performance", "Performance"), ("RES", 8, "resource", "Reliability"), ("CFG", 11, "config", "Reliability"), ("TST", 9, "test", "Reliability"), ("STL", 10, "style", "Maintainability"),
]

#: Engine of the rules that are not of the engine ast, by family (fixed values).
ENGINES = {
    "regex": "ERR-008 LOG-018 SEC-001 SEC-004 SEC-005 SEC-008 SEC-009 SEC-010 SEC-011 SEC-012 SEC-014 SEC-018 SEC-020 SEC-023 SEC-024 CMX-013 CMX-014 CMX-016 AIP-001 CFG-010 TST-005 STL-001 STL-002 STL-003 STL-004 STL-005 STL-006 STL-007 STL-008 STL-009 STL-010",
    "symbol": "TYP-007 TYP-008 TYP-009 TYP-014 VAR-001 VAR-003 VAR-004 VAR-005 VAR-006 VAR-007 VAR-010 VAR-012 RTE-001 RTE-002 API-001 API-002 API-003 AIP-007 AIP-010 AIP-011 CFG-006 CFG-007",
    "cfg": "VAR-008 VAR-009 ASY-002 ASY-004 ASY-006 ASY-008 ASY-009 ASY-011 ASY-012 ASY-015 ERR-004 ERR-010 ERR-012 RTE-010 RTE-011 RTE-012 RTE-013 RTE-014 RTE-015 RTE-017 RTE-019 RTE-020 LOG-009 CMX-008 CMX-009 AIP-003 PRF-002 PRF-004 PRF-005 PRF-006 RES-001 RES-002 RES-003 RES-005 RES-006 TST-007 TST-008",
    "metric": "CMX-001 CMX-003 CMX-004 CMX-005 CMX-006 AIP-002 AIP-004 AIP-005 AIP-009",
}

#: Action of the rules that do not ask for a review (fixed values).
ACTIONS = {
    "hard-fail": "SYN-001 SYN-002 SYN-003 SYN-007 VAR-001 ASY-001 ASY-003 RTE-001 RTE-002 RTE-011 RTE-012 API-001 API-007 API-008 SEC-001 SEC-002 SEC-003 SEC-004 SEC-006 SEC-007 SEC-009 SEC-010 AIP-010 CFG-010",
    "hint": "SYN-004 TYP-011 TYP-015 VAR-006 VAR-008 ASY-005 ASY-008 LOG-003 LOG-004 LOG-010 LOG-013 API-004 API-006 API-014 API-015 CMX-005 CMX-013 CMX-015 CMX-016 CMX-018 AIP-001 AIP-003 AIP-004 AIP-007 AIP-011 AIP-012 PRF-008 RES-008 TST-006 TST-009 STL-002 STL-003 STL-004 STL-006 STL-007 STL-008 STL-009 STL-010",
}

#: Rules for code that a model wrote; all others are for any code (fixed values).
FOR_MODELS = "TYP-003 TYP-004 TYP-015 ASY-005 ERR-001 ERR-002 ERR-006 ERR-007 ERR-008 ERR-009 ERR-011 RTE-008 LOG-001 LOG-002 LOG-003 LOG-004 LOG-010 LOG-012 LOG-013 LOG-020 API-001 API-005 API-006 API-013 API-015 SEC-011 SEC-012 SEC-013 SEC-016 SEC-018 SEC-019 SEC-020 SEC-021 SEC-022 SEC-023 SEC-026 CMX-010 CMX-012 CMX-014 CMX-017 AIP-001 AIP-002 AIP-003 AIP-004 AIP-005 AIP-006 AIP-007 AIP-008 AIP-009 AIP-010 AIP-011 AIP-012 PRF-002 PRF-003 PRF-005 PRF-007 PRF-008 PRF-010 RES-007 RES-008 CFG-003 CFG-008 CFG-011 TST-006 TST-008 TST-009 STL-006"

#: Starts of names that say what a function does, and that a value is a truth value (fixed values).
VERBS = "get set is has can should will did was create make build fetch load save update delete remove add insert find search check validate compute calculate handle on init parse format render transform convert process map filter reduce sort merge split join compare test assert verify ensure enable disable show hide open close start stop run execute apply reset clear read write send receive emit dispatch subscribe unsubscribe listen trigger notify log print debug warn throw"
TRUTHS = "is has can should will did was are need allow enable disable show hide include exclude with without use"

#: Line rules of the catalog, by their descriptions.
LINE_RULES = [
    Rule("TYP-001", "warning", r":\s*any\b|<any>|any\[\]", "any type"),
    Rule("TYP-003", "warning", r"\bas\s+(?:any|unknown|never)\b", "unsafe assertion"),
    Rule("TYP-004", "warning", r"\w!\.|\)!\.", "non-null assertion"),
    Rule("TYP-005", "warning", r":\s*\{\}\s*[;,)=]", "empty object type"),
    Rule("TYP-006", "warning", r"new\s+(?:Map|Set|Array)\(\)", "missing type parameter"),
    Rule("VAR-002", "warning", r"^\s*var\s", "var"),
    Rule("VAR-011", "warning", r"\bwindow\.\w+\s*=[^=]", "global assignment"),
    Rule("ASY-007", "warning", r"Promise\.race\(", "race without timeout"),
    Rule("ASY-014", "warning", r"for\s*\([^)]*\sof\s[^)]*(?i:stream|async|cursor|iterator)", "async values without for await"),
    Rule("ASY-013", "warning", r"new\s+Promise\(\s*async", "async promise body"),
    Rule("ERR-005", "warning", r"throw\s+['\"`]", "thrown string"),
    Rule("ERR-008", "error", r"(?i)new\s+Error\(.*(?:password|token|secret)", "secret in an error"),
    Rule("ERR-009", "error", r"(?:send|json|write)\(.*\.stack", "stack shown"),
    Rule("RTE-004", "warning", r"\w\s\|\|\s(?:0|''|\"\"|false)", "or for nullish"),
    Rule("RTE-005", "error", r"\w\[\s*\w+\.length\s*\]", "index past the end"),
    Rule("RTE-006", "error", r"\w\[0\]\.", "first of a list"),
    Rule("RTE-009", "error", r"parseInt\(\s*\w+\s*\)", "parseInt"),
    Rule("RTE-010", "error", r"/\s*\w+\.length\b|/\s*(?:total|count)\b", "division by a count"),
    Rule("RTE-014", "error", r"<=\s*\w+\.length\b", "off by one"),
    Rule("RTE-016", "error", r"for\s*\(\s*(?:const|let|var)\s+\w+\s+in\s", "for in"),
    Rule("RTE-020", "warning", r"\bif\s*\(\s*(?:true|false|0|1)\s*\)", "dead branch"),
    Rule("LOG-001", "error", r"[^=!<>]==[^=]", "loose equality"),
    Rule("LOG-002", "error", r"!=[^=]", "loose inequality"),
    Rule("LOG-003", "info", r"===?\s*(?:true|false)\b", "boolean literal"),
    Rule("LOG-004", "info", r"!!\w", "double negation"),
    Rule("LOG-005", "error", r"===?\s*NaN\b", "NaN compared"),
    Rule("LOG-006", "error", r"===?\s*(?:\{\}|\[\])", "object identity"),
    Rule("LOG-007", "error", r"[\w)]\s+[&|]\s+[\w(]", "bit for logic operator"),
    Rule("LOG-008", "warning", r"\?[^?:]*\?[^?:]*:", "nested ternary"),
    Rule("LOG-009", "error", r"!\(\s*!?\w+\s*(?:&&|\|\|)", "negated group"),
    Rule("LOG-011", "error", r"\.sort\(\)", "sort without comparator"),
    Rule("LOG-012", "warning", r"\.map\(", "map"),
    Rule("LOG-013", "info", r"\.filter\(.*\)\.map\(", "filter then map"),
    Rule("LOG-014", "warning", r"\.(?:push|splice)\(", "array changed in place"),
    Rule("LOG-015", "error", r"['\"]\s*\+\s*\d|\d\s*\+\s*['\"]", "text plus number"),
    Rule("LOG-016", "warning", r"===?\s*\d+\.\d+", "float compared"),
    Rule("LOG-017", "warning", r"=\s*\w+\s*/\s*\d+\s*;", "division without rounding"),
    Rule("LOG-018", "error", r"new\s+Date\(\)", "date without zone"),
    Rule("LOG-019", "error", r"typeof\s+\w+\s*===?\s*['\"]object['\"]", "typeof object"),
    Rule("LOG-020", "warning", r"\{\s*\.\.\.\w", "shallow copy"),
    Rule("API-002", "warning", r"new\s+Buffer\(|\.substr\(|\b(?:un)?escape\(", "deprecated call"),
    Rule("API-003", "error", r"\barguments\.(?:map|filter|reduce|forEach)\(", "array method on no array"),
    Rule("API-004", "info", r"Object\.keys", "keys"),
    Rule("API-005", "warning", r"localStorage\.setItem\(", "local storage"),
    Rule("API-006", "info", r"console\.(?:log|debug)\(", "console"),
    Rule("API-007", "critical", r"\beval\s*\(", "eval"),
    Rule("API-008", "critical", r"new\s+Function\s*\(", "Function constructor"),
    Rule("API-009", "error", r"document\.write(?:ln)?\(", "document.write"),
    Rule("API-010", "error", r"innerHTML\s*=", "innerHTML"),
    Rule("API-011", "error", r"setTimeout\(\s*['\"`]", "string timeout"),
    Rule("API-012", "warning", r"new\s+Array\(\d+\)", "Array constructor"),
    Rule("API-013", "warning", r"Object\.assign\(\s*\w", "assign mutates"),
    Rule("API-014", "info", r"this\._\w+\s*=[^=]", "private by name"),
    Rule("API-015", "info", r"\[['\"]\w+['\"]\]\s*=[^=]", "text as key"),
    Rule("SEC-001", "critical", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE)\s.*(?:\$\{|['\"]\s*\+\s*\w)", "sql injection"),
    Rule("SEC-002", "critical", r"dangerouslySetInnerHTML|\.innerHTML\s*\+?=\s*[^'\"`=\s]", "cross-site scripting"),
    Rule("SEC-003", "critical", r"\b(?:exec|execSync|spawn|spawnSync)\(.*(?:\$\{|\+)", "command injection"),
    Rule("SEC-004", "critical", r"(?i)\.\.[\\/].*(?:path|fs|readFile|writeFile|open|createReadStream|join)|(?:path|fs|readFile|writeFile|open|createReadStream|join).*\.\.[\\/]", "path traversal"),
    Rule("SEC-005", "error", r"(?i)(?:\(cn=|\(uid=|ldap).*(?:\$\{|\+)", "ldap injection"),
    Rule("SEC-007", "critical", r"__proto__|\.prototype\s*[=.]", "prototype pollution"),
    Rule("SEC-008", "error", r"(?:/|new\s+RegExp\s*\().*(?:\([^)]*[+*][^)]*\)|\[[^\]]*[+*][^\]]*\])[+*]", "nested quantifiers"),
    Rule("SEC-009", "critical", r"(?i)(?:password|api_?key|secret)\s*[:=]\s*['\"][^'\"]{8,}", "hard-coded secret"),
    Rule("SEC-010", "critical", r"(?i)\b(?:salt|seed|pepper|iv)\s*[:=]\s*['\"`][^'\"`]{6,}['\"`]", "fixed salt"),
    Rule("SEC-011", "error", r"(?i)createHash\(\s*['\"](?:md5|sha1)", "weak hash"),
    Rule("SEC-012", "error", r"(?i)createCipher\w*\(\s*['\"](?:des|rc4)", "weak cipher"),
    Rule("SEC-014", "error", r"(?i)['\"`].*[?&](?:session|sessionid|sid|jsessionid|token)\s*=|[?&](?:session|sessionid|sid|jsessionid|token)\s*=.*['\"`]", "session in an address"),
    Rule("SEC-016", "error", r"Access-Control-Allow-Origin.*\*", "cors wildcard"),
    Rule("SEC-017", "error", r"postMessage\(.*,\s*['\"]\*['\"]", "message to any origin"),
    Rule("SEC-018", "error", r"(?i)console\.\w+\(.*(?:password|token|secret)", "secret logged"),
    Rule("SEC-019", "error", r"\.(?:send|json|end)\s*\(\s*[^)]*\.stack", "stack in a response"),
    Rule("SEC-020", "error", r"http://[a-z]", "plain http"),
    Rule("SEC-021", "error", r"(?i)localStorage\.setItem\(.*(?:token|password)", "secret in local storage"),
    Rule("SEC-022", "warning", r"^\s*debugger\b|console\.debug\s*\(", "debugging left"),
    Rule("SEC-023", "warning", r"\b(?:10\.\d+|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d+\.\d+", "internal address"),
    Rule("SEC-024", "critical", r"(?i)(?:findOne|find|get|delete|update)\s*\(\s*\{[^}]*\b_?id\s*:\s*req\.params", "object reference from a request"),
    Rule("SEC-025", "critical", r"\b(?:app|router)\.(?:get|post|put|patch|delete)\(\s*['\"`][^'\"`]*/(?:api|admin|v\d+)[^,]*,\s*(?:async\s*)?(?:\(|function\b|\w+\s*\))", "route without middleware"),
    Rule("CMX-010", "warning", r"\?[^?:]*\?[^?:]*\?", "ternary in ternary"),
    Rule("CMX-013", "info", r"^.{121,}", "long line"),
    Rule("CMX-015", "info", r"[=<>(]\s*\d{3,}\b", "magic number"),
    Rule("AIP-006", "warning", r"function\s+(?:deepClone|deepCopy|debounce|throttle|flattenArray|flattenDeep|chunkArray|mergeDeep|deepMerge|isEqual|deepEqual|uniqueArray|groupBy|sortBy|capitalize)\b", "own form of a library function"),
    Rule("AIP-010", "critical", r"\.(?:toSorted|toReversed|groupBy|flattern|trimLeft|trimRight|replaceAll)\(", "call that may not exist"),
    Rule("AIP-011", "info", r"^\s*var\s|\brequire\(|\barguments\b", "old pattern"),
    Rule("PRF-003", "warning", r"JSON\.parse\(\s*JSON\.stringify", "deep copy by json"),
    Rule("PRF-010", "warning", r"useSelector\s*\(\s*\(?\s*\w+\s*\)?\s*=>\s*\w+\s*\)|getState\(\)", "whole state"),
    Rule("CFG-001", "error", r"\"strict\"\s*:\s*false", "strict off"),
    Rule("CFG-002", "warning", r"\"noUnusedLocals\"\s*:\s*false", "unused locals allowed"),
    Rule("CFG-003", "warning", r"\"skipLibCheck\"\s*:\s*true", "lib check off"),
    Rule("CFG-004", "warning", r"\"target\"\s*:\s*\"(?i:es3|es5)\"", "old target"),
    Rule("CFG-010", "critical", r"['\"]\.env(?:\.local|\.production)?['\"]", "environment file"),
    Rule("TST-004", "error", r"\.\s*(?:resolves|rejects)\s*(?:;|$)", "no assertion"),
    Rule("TST-009", "info", r"expect\s*\(\s*(?:true\s*\)\s*\.\s*(?:toBe\s*\(\s*true|toBeTruthy\s*\()|false\s*\)\s*\.\s*(?:toBe\s*\(\s*false|toBeFalsy\s*\()|1\s*\)\s*\.\s*toBe\s*\(\s*1|0\s*\)\s*\.\s*toBe\s*\(\s*0|null\s*\)\s*\.\s*toBe\s*\(\s*null|undefined\s*\)\s*\.\s*toBe\s*\(\s*undefined)\s*\)", "assertion of nothing"),
    Rule("STL-001", "warning", r"(?:const|let|var)\s+[lOI]\b", "confusing name"),
    Rule("STL-002", "info", rf"function\s+(?i:{unless(*VERBS.split())})\w*\(", "function name without a verb"),
    Rule("STL-003", "info", rf"\b(?:const|let|var)\s+(?i:{unless(*TRUTHS.split())})\w*\s*(?::\s*boolean|=\s*(?:true|false)\b)", "truth value without is or has"),
    Rule("STL-004", "info", r"^const\s+[a-z]\w+\s*=\s*(?:\d+|'[^']*'|\"[^\"]*\"|true|false)\s*;?\s*$", "constant in small letters"),
    Rule("STL-010", "info", r"\b(?:TODO|FIXME|HACK)\b", "open todo"),
]


class Pair(NamedTuple):
    """A rule of two patterns."""

    rule_id: str
    severity: str
    first: str
    second: str


#: A line that matches the first, in a file where no line matches the second.
FILE_RULES = [
    Pair("ASY-009", "error", r"\.addEventListener\(", r"removeEventListener"),
    Pair("SEC-013", "critical", r"\bjwt\.decode\b", r"\bjwt\.verify\s*\("),
    Pair("SEC-015", "error", r"res\.cookie\(", r"httpOnly\s*:"),
    Pair("SEC-027", "error", r"\b(?:app|router)\.(?:post|put|patch|delete)\(\s*['\"`][^'\"`]*/(?:api|auth|account|admin)", r"(?i)csrf|csurf|sameSite|double.?submit"),
    Pair("RES-001", "error", r"createReadStream|createWriteStream", r"\.close\(|\.end\(|\.destroy\(|closeSync|\.pipe\("),
    Pair("RES-002", "error", r"getConnection|createConnection", r"\.release\(|\.end\(|\.close\(|\.destroy\("),
    Pair("RES-003", "warning", r"\bsetInterval\s*\(", r"clearInterval"),
    Pair("RES-004", "warning", r"\bfetch\s*\(", r"AbortController|signal"),
    Pair("RES-005", "error", r"new\s+Worker\b", r"\.terminate\(|worker\.close|\.close\(\)"),
    Pair("RES-006", "error", r"\.on\s*\(|\.addListener\s*\(", r"removeListener|removeAllListeners|\.off\(|setMaxListeners"),
    Pair("RES-007", "warning", r"^(?:export\s+)?(?:const|let)\s+\w+\s*=\s*(?:new\s+Map\b|\{\})", r"\.delete\(|\bdelete\s|\.size\b|Object\.keys\("),
    Pair("RES-008", "info", r"new\s+(?:Map|Set)\s*\(", r"WeakRef|WeakMap|WeakSet"),
    Pair("CFG-005", "warning", r"\"compilerOptions\"", r"\"moduleResolution\""),
    Pair("TYP-012", "error", r"\"compilerOptions\"", r"\"strict\"\s*:\s*true"),
]

#: A line that matches the first, with a next line that matches the second.
NEXT_RULES = [
    Pair("ERR-001", "error", r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*$", r"^\s*\}"),
    Pair("ERR-002", "error", r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*$", r"^\s*console\.\w+\("),
    Pair("RTE-019", "warning", r"^\s*(?:return|throw|break|continue)\b.*;\s*$", r"^\s*(?:const|let|var|await|return|throw)\s|^\s*[\w.]+\("),
    Pair("VAR-009", "error", r"\bfor\s*\(\s*var\s", r"setTimeout|=>|function\b"),
]


def rule_catalog(spark: SparkSession) -> DataFrame:
    """rule_id, family, category, quality, engine, action, source, has_rule (a pattern or count here finds it)."""
    built = {r.rule_id for pack in (LINE_RULES, FILE_RULES, NEXT_RULES, span_rules.INSIDE, span_rules.ABOUT) for r in pack} | {*span_rules.OTHERS} | {r[0] for r in scopes.RULES} | {"CMX-004", "STL-009", "TYP-011"}
    engine = {i: e for e, ids in ENGINES.items() for i in ids.split()}
    action = {i: a for a, ids in ACTIONS.items() for i in ids.split()}
    model = set(FOR_MODELS.split())
    ids = [(f"{f}-{k:03}", f, c, q) for f, n, c, q in FAMILIES for k in range(1, n + 1)]
    rows = [(i, f, c, q, engine.get(i, "ast"), action.get(i, "review"), "ai" if i in model else "both", i in built) for i, f, c, q in ids]
    return spark.createDataFrame(rows, "rule_id string, family string, category string, quality string, engine string, action string, source string, has_rule boolean")


def scan_files(lines: DataFrame) -> DataFrame:
    """Lines of FILE_RULES. Only lines with a hit and (file, rule) pairs that are ruled out are shuffled, never all lines."""
    opened = scan_rules(lines, [Rule(r.rule_id, r.severity, r.first, "") for r in FILE_RULES], COMMENT)
    closed = scan_rules(lines, [Rule(r.rule_id, r.severity, r.second, "") for r in FILE_RULES]).select("repo", "path", "rule_id").distinct()
    return opened.join(closed, ["repo", "path", "rule_id"], "left_anti").select("repo", "path", "line", "rule_id", "severity")


def scan_next(lines: DataFrame) -> DataFrame:
    """Lines of NEXT_RULES: both sides are found in one pass, and the few that match meet on the number of the first line."""
    first = scan_rules(lines, [Rule(r.rule_id, r.severity, r.first, "") for r in NEXT_RULES], COMMENT).select("repo", "path", "line", "rule_id", "severity")
    second = scan_rules(lines, [Rule(r.rule_id, r.severity, r.second, "") for r in NEXT_RULES]).select("repo", "path", (F.col("line") - 1).alias("line"), "rule_id")
    return first.join(second, ["repo", "path", "line", "rule_id"]).select("repo", "path", "line", "rule_id", "severity")


def scan_totals(lines: DataFrame, longest: int = 1000) -> DataFrame:
    """Rules about counts of a whole file: repo, path, rule_id, amount.

    Brackets that do not balance outside of strings and comments, more than 1,000 lines, both kinds of quotes, interfaces beside type
    aliases. Counts are summed before the shuffle.
    """
    of = lambda letter: F.sum(F.length("text") - F.length(F.replace("text", F.lit(letter))))
    has = lambda pattern: F.sum(F.col("text").rlike(pattern).cast("int"))
    n = lines.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n"), of("'").alias("single"), of('"').alias("double"), has(r"^\s*(?:export\s+)?interface\s+\w").alias("interfaces"), has(r"^\s*(?:export\s+)?type\s+\w+\s*=").alias("types")
    )
    each = [("CMX-004", F.col("n") > longest, F.col("n")), ("STL-009", F.least("single", "double") > 0, F.least("single", "double")), ("TYP-011", F.least("interfaces", "types") > 0, F.least("interfaces", "types"))]
    found = F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule_id"), amount.cast("long").alias("amount"))) for rule, test, amount in each])
    return n.select("repo", "path", F.inline(F.filter(found, lambda x: x.isNotNull()))).unionByName(span_rules.bracket_totals(syntax.lex(lines)))


def scan_catalog(lines: DataFrame, families: list[str] | None = None, most: int = 80) -> DataFrame:
    """Line rules of some families (all by default), comment lines skipped; at most 80 findings a file."""
    rules = [r for r in LINE_RULES if families is None or r.rule_id[:3] in families]
    return cap(scan_rules(lines, rules, COMMENT), ["repo", "path"], ["line", "place"], most).drop("place", "message")


def select_rules(catalog: DataFrame, **wanted: str) -> DataFrame:
    out = catalog
    for column, value in wanted.items():
        out = out.where(F.col(column) == value)
    return out


def catalog_stats(catalog: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules and findings by category, by engine, by action, and in all. What a row is grouped by is not null in it."""
    n = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    per = catalog.join(n, "rule_id", "left").fillna(0, ["findings"])
    sets = [[F.col(c)] for c in ("category", "engine", "action")] + [[]]
    return per.groupingSets(sets, "category", "engine", "action").agg(F.count(F.lit(1)).alias("rules"), F.sum("findings").alias("findings"))
