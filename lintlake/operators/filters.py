"""The false-positive filter chain, good patterns, and flow checks between lines of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import family, js_round
from lintlake.operators.findings import merge_duplicates, with_context

FILE = ["repo", "path"]

#: Good pattern, quality dimension, pattern in a line, rules that it suppresses (fixed values).
GOOD = [
    ("GQ-NL-010", "Reliability", r"!==\s*(null|undefined)|typeof\s+\w+\s*[!=]==", "RTE-001,RTE-002,RTE-003"),
    ("GQ-AS-002", "Performance", r"Promise\.all\s*\(", "ASY-002,PRF-004"),
    ("GQ-AS-003", "Reliability", r"Promise\.allSettled", "ASY-002"),
    ("GQ-AS-007", "Reliability", r"removeEventListener|\.off\(", "ASY-009,PRF-006"),
    ("GQ-AS-008", "Reliability", r"clearTimeout|clearInterval", "RES-003"),
    ("GQ-EH-001", "Reliability", r"extends\s+Error", "ERR-005"),
    ("GQ-EH-010", "Reliability", r":\s*never\b|assertNever", "CMX-012"),
    ("GQ-FN-004", "Maintainability", r"^\s*if\s*\([^)]*\)\s*(return|throw)\b", "CMX-007"),
    ("GQ-FN-010", "Reliability", r"\{\s*\.\.\.", "LOG-014,LOG-020"),
    ("GQ-FN-012", "Reliability", r"\.slice\(|\.concat\(|\.map\(|\.filter\(", "LOG-014"),
    ("GQ-NL-001", "Reliability", r"\?\.\w", "RTE-003"),
    ("GQ-NL-002", "Reliability", r"\?\?", "RTE-004"),
    ("GQ-PF-002", "Performance", r"new\s+Map\(|new\s+Set\(|\.has\(", "PRF-002"),
    ("GQ-PF-005", "Performance", r"debounce|throttle", "PRF-009"),
    ("GQ-PF-010", "Performance", r"const\s+\w+\s*=\s*/", "PRF-008"),
    ("GQ-RS-001", "Reliability", r"finally\s*\{", "RES-001,RES-002"),
    ("GQ-SC-007", "Security", r"bcrypt|argon2|scrypt", "SEC-011,SEC-012"),
    ("GQ-SC-009", "Security", r"zod|Joi|z\.object|z\.string", "SEC-001,SEC-002"),
    ("GQ-SL-006", "Maintainability", r"Record<.*,.*>\s*=\s*\{", "CMX-012"),
    ("GQ-CF-007", "Maintainability", r"\.env\.example|process\.env", "CFG-010"),
    ("GQ-LG-001", "Maintainability", r"const\s+t\s*=", "API-006"),
]
#: Rule family -> quality dimension (fixed values).
QUALITY = {"RTE": "Reliability", "TYP": "Reliability", "ASY": "Reliability", "ERR": "Reliability", "RES": "Reliability", "CFG": "Reliability", "TST": "Reliability", "CMX": "Maintainability", "LOG": "Maintainability", "VAR": "Maintainability", "STL": "Maintainability", "AIP": "Maintainability", "SEC": "Security", "PRF": "Performance"}


def detect_good_patterns(lines: DataFrame) -> DataFrame:
    """(repo, path, good_id) of each file."""
    each = F.array(*[F.when(F.col("text").rlike(p), F.lit(g)) for g, _, p, _ in GOOD])
    return lines.select(*FILE, F.explode(F.filter(each, lambda g: g.isNotNull())).alias("good_id")).distinct()


def apply_good_suppress(f: DataFrame, good: DataFrame) -> DataFrame:
    """Findings whose rule no good pattern of their file suppresses."""
    rules = F.create_map(*[F.lit(x) for g, _, _, r in GOOD for x in (g, r)])
    off = good.select(*FILE, F.explode(F.split(rules[F.col("good_id")], ",")).alias("rule_id")).distinct()
    return f.join(off, [*FILE, "rule_id"], "left_anti")


def apply_boost(f: DataFrame, good: DataFrame) -> DataFrame:
    """Confidence one step down where a file shows two good patterns of the rule's quality dimension."""
    dims = F.create_map(*[F.lit(x) for g, q, _, _ in GOOD for x in (g, q)])
    own = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])
    sound = good.groupBy(*FILE, dims[F.col("good_id")].alias("quality")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*FILE, "quality", F.lit(True).alias("sound"))
    j = f.withColumn("quality", own[family(F.col("rule_id"))]).join(sound, [*FILE, "quality"], "left")
    lower = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    return j.withColumn("confidence", F.when(F.col("sound"), lower).otherwise(F.col("confidence"))).drop("sound", "quality")


def dismissals(text: Column, near: Column, message: Column, cli: Column, test: Column, rule_file: Column) -> Column:
    """The first reason to dismiss a finding, in the order of the stages, as (reason, stage); null if there is none.

    text is the finding's line, near the lines round it.
    """
    t = text
    checks = [
        ("ENV-001", 1, cli & message.rlike(r"console")),
        ("ENV-002", 1, message.rlike(r"process\.exit")),
        ("ENV-003", 1, message.rlike(r"require\(") & ~message.rlike("eval|Function")),
        ("ENV-004", 1, message.rlike("__dirname|__filename")),
        ("ENV-005", 1, cli & message.rlike(r"process\.(stdout|stderr)")),
        ("ENV-006", 1, message.rlike(r"import\.meta")),
        ("ENV-007", 1, cli & message.rlike(r"throw\s+new\s+Error")),
        ("SYN-001", 2, t.rlike(r"^\s*(\"|'|`)") | t.rlike(r":\s*(\"|'|`)")),
        ("SYN-002", 2, t.rlike(r"^\s*//") | t.rlike(r"^\s*\*")),
        ("SYN-003", 2, message.rlike("50%|translateX|gradient|linear-gradient")),
        ("SYN-004", 2, t.rlike(r"regex\s*:|new RegExp|/.*/[gimsuy]")),
        ("CTX-001", 3, t.rlike(r"\.catch\s*\(") & near.rlike(r"console\.(warn|error|log)|logger\.|log\.|fallback|default|return\s|setState|dispatch|retry|throw\s")),
        ("CTX-002", 3, near.contains("createContext")),
        ("CTX-003", 3, test),
        ("CTX-004", 3, t.rlike(r"useRef\s*[<(]")),
        ("CTX-005", 3, t.rlike(r"onChunk\s*:\s*\(\s*\)\s*=>")),
        ("CTX-006", 3, t.rlike(r"import\(") & ~t.contains("eval")),
        ("CTX-007", 3, message.rlike(r"Promise\.(resolve|reject)")),
        ("CTX-008", 3, t.rlike(r"=>\s*\{\s*\}") & t.rlike(r"\.then|\.catch|callback|handler|on[A-Z]")),
        ("CTX-009", 3, t.rlike("dispose|destroy|cleanup|teardown")),
        ("CTX-010", 3, t.rlike(r"loading\s*:\s*\(\s*\)\s*=>\s*null")),
        ("CTX-011", 3, t.contains("compensate")),
        ("SELF-001", 4, rule_file & (message.rlike("(?i)eval|security|xss|injection|secret|credential|password") | t.rlike(r"\.test\(|RegExp|ruleId"))),
        ("SELF-002", 4, t.rlike(r"severity\s*:|confidence\s*:")),
    ]
    return F.coalesce(*[F.when(test_, F.struct(F.lit(r).alias("reason"), F.lit(s).alias("stage"))) for r, s, test_ in checks])


def first_match_dismissal(f: DataFrame, lines: DataFrame) -> DataFrame:
    """f with reason and stage (null: kept)."""
    own = lines.select(*FILE, F.col("line_no").alias("line"), F.col("text").alias("own_text"))
    j = with_context(f, lines, 3).join(own, [*FILE, "line"], "left").fillna("", ["own_text", "context"])
    why = dismissals(F.col("own_text"), F.col("context"), F.col("message"), F.col("path").rlike("(?:^|/)(cli|bin)/"), F.col("path").rlike(r"\.(test|spec)\."), F.col("path").rlike("rule|detector|pattern"))
    return j.withColumn("why", why).select(*f.columns, F.col("why.reason").alias("reason"), F.col("why.stage").alias("stage"))


def filter_report(dismissed: DataFrame) -> DataFrame:
    """Findings of each rule by the reason of their dismissal (null: kept), with the part of the rule's findings in per cent."""
    n = dismissed.groupBy("rule_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", js_round(F.col("n") * 1000 / F.sum("n").over(W.partitionBy("rule_id"))) / 10)


def fp_filter(f: DataFrame, lines: DataFrame, hints: list[str]) -> DataFrame:
    """The whole chain: good-pattern suppression, first dismissal, hint rules to low confidence, boosts, merging of duplicates."""
    good = detect_good_patterns(lines)
    kept = first_match_dismissal(apply_good_suppress(f, good), lines).where("reason IS NULL").drop("reason", "stage")
    kept = kept.withColumn("confidence", F.when(F.col("rule_id").isin(hints), "low").otherwise(F.col("confidence")))
    boosted = apply_boost(kept, good)
    return merge_duplicates(boosted.withColumn("file", F.col("path"))).withColumnRenamed("file", "path")


def _words(text: str = "text") -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)"), 1))


def taint_flow(lines: DataFrame) -> DataFrame:
    """Variables that take outside input and reach a risky call on a later line of the file."""
    source = r"(?:const|let|var)\s+(\w+)\s*=.*(?:value|input|req\.|x \?)"
    sources = lines.select(*FILE, F.col("line_no").alias("source_line"), F.regexp_extract("text", source, 1).alias("name")).where("name <> ''")
    sinks = lines.where(F.col("text").rlike(r"eval\(|exec\(|innerHTML\s*=|document\.write\(|print\(|use\(")).select(*FILE, F.col("line_no").alias("sink_line"), F.explode(_words()).alias("name"))
    return sources.join(sinks, [*FILE, "name"]).where("sink_line > source_line")


def null_flow(lines: DataFrame) -> DataFrame:
    """Uses of a member of a variable that may be null, on a later line, without a guard between."""
    declared = lines.select(*FILE, F.col("line_no").alias("decl"), F.regexp_extract("text", r"(?:const|let|var)\s+(\w+)\s*=.*(?:find\(|match\(|null|as any|parseInt)", 1).alias("name")).where("name <> ''")
    used = lines.select(*FILE, F.col("line_no").alias("use"), F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)[.=]"), 1)).alias("name")).distinct()
    guards = lines.select(*FILE, F.col("line_no").alias("guard"), F.regexp_extract("text", r"if\s*\(\s*!?(\w+)", 1).alias("name")).where("name <> ''")
    later = declared.join(used, [*FILE, "name"]).where("use > decl")
    return later.join(guards, (later["repo"] == guards["repo"]) & (later["path"] == guards["path"]) & (later["name"] == guards["name"]) & (guards["guard"] > later["decl"]) & (guards["guard"] <= later["use"]), "left_anti")


def marker_blocks(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Blocks between marker lines: number, first and last line and the lines inside."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    opened = lines.withColumn("block", F.sum(F.col("text").rlike(start).cast("int")).over(order))
    ended = opened.where("block > 0").withColumn("closed", F.sum(F.col("text").rlike(end).cast("int")).over(W.partitionBy(*FILE, "block").orderBy("line_no")))
    inside = ended.withColumn("is_end", F.col("text").rlike(end) & (F.col("closed") == 1)).where((F.col("closed") == 0) | F.col("is_end"))
    return inside.groupBy(*FILE, "block").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.bool_or("is_end").alias("complete"), F.count(F.lit(1)).alias("length")).where("complete").drop("complete")


def conflict_blocks(lines: DataFrame) -> DataFrame:
    """(repo, path, first_line, last_line, ours, theirs, both) of each merge conflict, its texts without the markers, lines joined by newlines.

    An opening marker begins a block, even inside one that has not ended; blocks without a closing marker are left out. A part without
    lines is an empty text. Lines between conflicts belong to none and are dropped before any is gathered.
    """
    order = W.partitionBy(*FILE).orderBy("line_no")
    until = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    mark = F.when(F.col("text").startswith("<<<<<<<"), 1).when(F.col("text").startswith("======="), 2).when(F.col("text").startswith(">>>>>>>"), 3)
    seen = lines.select(*FILE, "line_no", "text", mark.alias("mark")).withColumn("block", F.sum(F.when(F.col("mark") == 1, 1).otherwise(0)).over(until))
    inner = W.partitionBy(*FILE, "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    phase = seen.where("block > 0").withColumn("phase", F.max("mark").over(inner)).withColumn("closed", F.sum(F.when(F.col("mark") == 3, 1).otherwise(0)).over(inner))
    held = phase.where("closed = 0 OR (closed = 1 AND mark = 3)")
    # a line that looks like the middle marker is one only once
    part = held.withColumn("nth", F.sum(F.when(F.col("mark") == 2, 1).otherwise(0)).over(inner)).withColumn("marker", (F.col("mark") == 1) | (F.col("mark") == 3) | ((F.col("mark") == 2) & (F.col("nth") == 1)))
    row = F.when(~F.coalesce("marker", F.lit(False)), F.struct("line_no", "text", (F.col("phase") >= 2).alias("theirs")))
    blocks = part.groupBy(*FILE, "block").agg(F.min("line_no").alias("first_line"), F.max(F.when(F.col("mark") == 3, F.col("line_no"))).alias("last_line"), F.sort_array(F.collect_list(row)).alias("rows"))
    text = lambda keep: F.array_join(F.transform(F.filter("rows", keep), lambda r: r["text"]), "\n")
    return blocks.where("last_line IS NOT NULL").select(*FILE, "first_line", "last_line", text(lambda r: ~r["theirs"]).alias("ours"), text(lambda r: r["theirs"]).alias("theirs"), text(lambda r: F.lit(True)).alias("both"))


def extract_functions(lines: DataFrame) -> DataFrame:
    """Functions with their span, parameters and a cyclomatic estimate.

    A function ends at the first later line on which the brace depth is back at what it was before its header: the next closing
    line in the order of a file's headers and closing lines at that depth.
    """
    from lintlake.operators.scan import brace_depth

    deep = brace_depth(lines).withColumn("before", F.col("depth") - F.col("delta"))
    heads = deep.select(*FILE, F.col("line_no").alias("start"), F.regexp_extract("text", r"function\s+(\w+)\s*\(", 1).alias("name"), F.size(F.filter(F.split(F.regexp_extract("text", r"function\s+\w+\s*\(([^)]*)\)", 1), ","), lambda p: p != "")).alias("parameters"), F.col("before").alias("depth"), (F.col("delta") > 0).alias("opens")).where("name <> '' AND opens")
    closes = deep.where("delta < 0").select(*FILE, "depth", F.col("line_no").alias("start"), F.col("line_no").alias("at"))
    later = W.partitionBy(*FILE, "depth").orderBy("start").rowsBetween(1, W.unboundedFollowing)
    both = heads.drop("opens").unionByName(closes, allowMissingColumns=True)
    spans = both.withColumn("end", F.first("at", ignorenulls=True).over(later)).where("name IS NOT NULL AND end IS NOT NULL").drop("depth", "at")
    branch = F.regexp_count("text", F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\|")).cast("long")
    upto = W.partitionBy(*FILE).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    running = lines.withColumn("branches", F.sum(branch).over(upto)).select(*FILE, "line_no", "branches")
    first, last = running.withColumnRenamed("line_no", "start").withColumnRenamed("branches", "b0"), running.withColumnRenamed("line_no", "end").withColumnRenamed("branches", "b1")
    return spans.join(first, [*FILE, "start"]).join(last, [*FILE, "end"]).select(*FILE, "name", "start", "end", "parameters", (F.col("b1") - F.col("b0") + 1).alias("complexity"))


def duplicate_bodies(lines: DataFrame, functions: DataFrame, least: int = 3, least_lines: int = 3) -> DataFrame:
    """(repo, path, start, copies, lines): bodies of at least so many lines that occur at least so often, by their first place; runs of white space are one space.

    A body is told by two sums of 64-bit hashes of its lines and their places, and by its length, so bodies of any length are summed where
    their lines lie and none is gathered in one row.
    """
    body = functions.where(F.col("end") - F.col("start") >= least_lines).select(*FILE, "start", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("line_no"))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    each = body.join(lines.select(*FILE, "line_no", text.alias("t")), [*FILE, "line_no"]).withColumn("at", F.col("line_no") - F.col("start"))
    sums = [F.sum(F.xxhash64(*c).cast("decimal(38,0)")).alias(n) for n, c in (("h1", ("at", "t")), ("h2", ("t", "at")))]
    told = each.groupBy(*FILE, "start").agg(*sums, F.count(F.lit(1)).alias("lines"))
    classes = told.groupBy("h1", "h2", "lines").agg(F.min(F.struct(*FILE, "start")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return classes.where(F.col("copies") >= least).select("first.repo", "first.path", "first.start", "copies", "lines")


def check_async(lines: DataFrame) -> DataFrame:
    """Awaits within ten lines after a loop header, and busy waits."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    ahead = F.array_join(F.collect_list("text").over(order.rowsBetween(0, 10)), "\n")
    marked = lines.withColumn("ahead", ahead)
    tests = {"await-in-loop": F.col("text").rlike(r"\b(?:for|while|forEach)\b") & F.col("ahead").rlike(r"\bawait\b"), "busy-wait": F.col("text").rlike(r"while\s*\((?:true|k)\)\s*\{")}
    each = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    return marked.select(*FILE, F.col("line_no").alias("line"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("rule_id"))


#: Keyword sets of the patent and crypto check: id, blocks, words (fixed values, the first of them).
PATENTS = [("lzw", False, ["lzw", "lempel-ziv-welch", "gif compression"]), ("rsa-pkcs1", False, ["pkcs1", "rsa padding", "pkcs#1 v1.5"]), ("gif-lzw", False, ["gif encoder", "gif creator", "create gif"]), ("mp3-fraunhofer", False, ["mp3 encoder", "lame encoder", "mp3 encoding"]), ("h264-core", False, ["h264 encoder", "h.264", "avc encoder", "x264"]), ("exfat", False, ["exfat", "extended fat"]), ("double-click", False, ["one-click purchase", "one click buy", "1-click"]), ("slide-unlock", False, ["slide to unlock", "swipe unlock"])]


def check_patents(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Keyword sets that a text touches, and whether it is safe to use (none that blocks)."""
    low = F.lower(F.col(text))
    each = F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.struct(F.lit(i).alias("id"), F.lit(b).alias("block"))) for i, b, words in PATENTS])
    hit = df.select(key, F.filter(each, lambda x: x.isNotNull()).alias("hits"))
    return hit.select(key, F.size("hits").cast("long").alias("n"), F.array_join("hits.id", ",").alias("ids"), (~F.exists("hits", lambda h: h["block"])).alias("safe"))


def deep_summary(f: DataFrame) -> DataFrame:
    """Score of each file from its deep findings, one for each line and category: 100 - 30 P0 - 15 P1 - 5 P2."""
    once = f.dropDuplicates([*FILE, "line", "category"])
    n = once.groupBy(*FILE).agg(*[F.count_if(F.col("severity") == p).alias(p.lower()) for p in ("P0", "P1", "P2")])
    return n.withColumn("score", F.greatest(F.lit(0), 100 - 30 * F.col("p0") - 15 * F.col("p1") - 5 * F.col("p2")))
