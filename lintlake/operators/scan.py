"""Line and file scans. A pack of patterns is evaluated in one pass over the lines; rules never meet lines in a join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import entropy, mask
from lintlake.operators import rules as R

FILE = ["repo", "path"]


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Numbered lines from 1, carriage returns stripped."""
    parts = F.split(F.regexp_replace(F.col(content), "\r(\n|$)", "$1"), "\n", -1)
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(parts).alias("pos", "text")).select(*keep, (F.col("pos") + 1).alias("line_no"), "text")


def hits(text: Column, rules: Iterable[R.Rule]) -> Column:
    """Array of the rules that a text matches, with their place in the pack."""
    each = [F.when(text.rlike(r.pattern), F.struct(F.lit(k).alias("place"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for k, r in enumerate(rules)]
    return F.filter(F.array(*each), lambda h: h.isNotNull())


def scan_rules(lines: DataFrame, rules: Iterable[R.Rule], skip: str | None = None) -> DataFrame:
    """One row for each line and rule that match: repo, path, line, place, rule_id, severity, message."""
    kept = lines if skip is None else lines.where(~F.col("text").rlike(skip))
    return kept.select(*FILE, F.col("line_no").alias("line"), F.inline(hits(F.col("text"), rules)))


def cap(found: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group."""
    w = W.partitionBy(*keys).orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def scan_surface(lines: DataFrame) -> DataFrame:
    """Surface patterns; 3 hits a message and file, and no further line once a file has 20."""
    few = cap(scan_rules(lines, R.SURFACE, R.RULE_LINE), [*FILE, "message"], ["line"], 3)
    before = W.partitionBy(*FILE).orderBy("line").rangeBetween(W.unboundedPreceding, -1)
    return few.withColumn("__b", F.count(F.lit(1)).over(before)).where("__b < 20").drop("__b", "place")


def _capped(lines: DataFrame, rules, most: int, skip: str | None = None) -> DataFrame:
    return cap(scan_rules(lines, rules, skip), FILE, ["line", "place"], most).drop("place")


def scan_bugs(lines: DataFrame) -> DataFrame:
    return _capped(lines, R.BUGS, 15)


def scan_security(lines: DataFrame) -> DataFrame:
    return _capped(lines, R.SECURITY, 15, R.RULE_LINE)


def brace_depth(lines: DataFrame) -> DataFrame:
    """Lines with opening minus closing braces so far, and the file's deepest."""
    opened = F.length("text") - F.length(F.replace("text", F.lit("{")))
    closed = F.length("text") - F.length(F.replace("text", F.lit("}")))
    upto = W.partitionBy(*FILE).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("delta", (opened - closed).cast("long")).withColumn("depth", F.sum("delta").over(upto)).withColumn("max_depth", F.max("depth").over(W.partitionBy(*FILE)))


def scan_structure(lines: DataFrame) -> DataFrame:
    """Functions over 50 lines, entries into blocks deeper than 5, functions with over 5 parameters; 15 a file."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    deep = brace_depth(lines)
    header = F.col("text").rlike(r"function\s|=>|class\s")
    entered = deep.withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0))).where("depth > 5 AND before <= 5")
    closes = deep.withColumn("start", F.last(F.when(header, F.col("line_no")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).where((F.col("depth") == 0) & (F.col("line_no") - F.col("start") > 50))
    first_close = closes.groupBy(*FILE, "start").agg(F.min("line_no").alias("end"))
    parameters = F.filter(F.split(F.regexp_extract("text", r"function\s+\w+\(([^)]*)\)", 1), ","), lambda p: p != "")
    out = [
        first_close.select(*FILE, F.col("start").alias("line"), F.lit("long-function").alias("rule_id"), (F.col("end") - F.col("start")).cast("long").alias("amount"), F.lit(0).alias("kind")),
        entered.select(*FILE, F.col("line_no").alias("line"), F.lit("deep-nesting").alias("rule_id"), F.col("depth").alias("amount"), F.lit(1).alias("kind")),
        lines.where(F.size(parameters) > 5).select(*FILE, F.col("line_no").alias("line"), F.lit("many-parameters").alias("rule_id"), F.size(parameters).cast("long").alias("amount"), F.lit(2).alias("kind")),
    ]
    return cap(out[0].unionByName(out[1]).unionByName(out[2]), FILE, ["kind", "line"], 15).drop("kind")


def adjacent_match(lines: DataFrame, current: str, following: str) -> DataFrame:
    """Lines that match one pattern and whose next line matches another."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    return lines.withColumn("next_text", F.lead("text").over(order)).where(F.col("text").rlike(current) & F.col("next_text").rlike(following))


def scan_hollow(lines: DataFrame) -> DataFrame:
    """Empty functions, "not implemented" errors and stub returns."""
    empty = adjacent_match(lines, r"function\s+\w+|=>\s*\{", r"^\s*\}\s*$").select(*FILE, F.col("line_no").alias("line"), F.lit("empty-function").alias("rule_id"), F.lit("error").alias("severity"))
    stubs = [
        R.Rule("not-implemented", "error", r"throw\s+new\s+Error\(\s*['\"`]Not\s+implemented", ""),
        R.Rule("stub-return", "warning", r"(?i)return\s+(null|undefined|void\s+0)\s*;?\s*//\s*(TODO|FIXME|stub)", ""),
    ]
    return empty.unionByName(scan_rules(lines, stubs).select(*FILE, "line", "rule_id", "severity"))


def scan_dead_code(lines: DataFrame) -> DataFrame:
    """Lines after a return, and commented-out code; 10 a file, in line order of the checks."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    with_next = lines.withColumn("next_text", F.lead("text").over(order))
    after = (F.col("text").rlike(r"^\s*return\b")) & F.col("next_text").isNotNull() & ~F.col("next_text").rlike(r"^\s*[})\]]") & (F.trim("next_text") != "")
    commented = F.col("text").rlike(r"^\s*//\s*(const|let|var|function|if|for|while|return|import)\s")
    found = with_next.select(
        *FILE,
        F.col("line_no").alias("at"),
        F.inline(
            F.filter(
                F.array(
                    F.when(after, F.struct((F.col("line_no") + 1).alias("line"), F.lit("unreachable").alias("rule_id"), F.lit("warning").alias("severity"))),
                    F.when(commented, F.struct(F.col("line_no").alias("line"), F.lit("commented-code").alias("rule_id"), F.lit("info").alias("severity"))),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    return cap(found, FILE, ["at", F.col("rule_id").desc()], 10).drop("at")


def scan_design(lines: DataFrame) -> DataFrame:
    """Each hard-coded z-index, and files with over five hex colours."""
    found = lines.groupBy(*FILE).agg(F.sum(F.regexp_count("text", F.lit(r"z-index:\s*\d+|z-\[\d+\]"))).cast("long").alias("z_index"), F.sum(F.regexp_count("text", F.lit(r"(?i)#[0-9a-f]{6}"))).cast("long").alias("colours"))
    return found.where("z_index > 0 OR colours > 5").withColumn("score", F.greatest(F.lit(0), 100 - 10 * (F.col("z_index") + (F.col("colours") > 5).cast("long"))))


def scan_cognitive(lines: DataFrame) -> DataFrame:
    """Long lines (3 a file), nested ternaries, and files over 300 lines; 10 a file."""
    long_line = cap(lines.where(F.length("text") > 120), FILE, ["line_no"], 3).select(*FILE, F.col("line_no").alias("line"), F.lit("long-line").alias("rule_id"), F.lit(0).alias("kind"))
    ternary = lines.where(F.length("text") - F.length(F.replace("text", F.lit("?"))) >= 2).select(*FILE, F.col("line_no").alias("line"), F.lit("nested-ternary").alias("rule_id"), F.lit(1).alias("kind"))
    large = lines.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n")).where("n > 300").select(*FILE, F.lit(0).alias("line"), F.lit("large-file").alias("rule_id"), F.lit(2).alias("kind"))
    return cap(long_line.unionByName(ternary).unionByName(large), FILE, ["kind", "line"], 10).drop("kind")


def scan_vulns(lines: DataFrame) -> DataFrame:
    """Vulnerability patterns with their CWE; comment lines are skipped, 50 a file."""
    found = _capped(lines, [r for r, _ in R.VULNS], 50, r"^\s*(//|\*|/\*)")
    cwe = F.create_map(*[F.lit(x) for r, c in R.VULNS for x in (r.rule_id, c)])
    return found.withColumn("cwe", cwe[F.col("rule_id")])


def scan_secrets(lines: DataFrame, least_entropy: float = 3.0) -> DataFrame:
    """The first secret of each line, with a preview; generic ones need enough entropy; 50 a file."""

    def hit(place: int, rule: R.Rule, gated: bool) -> Column:
        found = F.regexp_extract("text", rule.pattern, 0)
        ok = F.col("text").rlike(rule.pattern)
        if gated:
            value = F.regexp_replace(F.regexp_extract(found, r"^.*?[=:]\s*['\"]?(.*)$", 1), r"['\"]$", "")
            ok = ok & (F.length(value) >= 8) & (entropy(value) >= least_entropy)
        return F.when(ok, F.struct(F.lit(place).alias("place"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), found.alias("secret")))

    kept = lines.where(~F.col("text").rlike(r"^\s*(//|#|\*)") & ~F.col("text").rlike(R.PLACEHOLDER))
    kept = kept.where(~F.col("path").rlike(r"\.(test|spec|mock|fixture)\.(ts|js|tsx|jsx)$|node_modules|\.git/|dist/"))
    first = kept.select(*FILE, F.col("line_no").alias("line"), F.coalesce(*[hit(k, r, g) for k, (r, g) in enumerate(R.SECRETS)]).alias("hit")).where("hit IS NOT NULL")
    shown = F.when(F.length("secret") > 12, mask(F.col("secret"), 6, 4)).otherwise(F.concat(F.left("secret", F.lit(4)), F.lit("***")))
    return cap(first.select(*FILE, "line", "hit.rule_id", "hit.severity", "hit.secret"), FILE, ["line"], 50).select(*FILE, "line", "rule_id", "severity", shown.alias("preview"))


def scan_secrets_generic(lines: DataFrame) -> DataFrame:
    """Every pattern of the second list that a line matches, masked to its ends."""
    each = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.regexp_extract("text", r.pattern, 0).alias("secret")) for r in R.SECRETS_GENERIC])
    found = lines.select(*FILE, F.col("line_no").alias("line"), F.inline(F.filter(each, lambda h: h["secret"] != "")))  # no pattern matches nothing
    return found.select(*FILE, "line", "rule_id", mask(F.col("secret"), 8, 4).alias("masked"))


def scan_ip_markers(lines: DataFrame) -> DataFrame:
    """Licence and provenance markers; a copyright line that names a known licence is none."""
    known = F.col("known") & (F.col("rule_id") == "copyright")
    found = lines.select(*FILE, F.col("line_no").alias("line"), F.col("text").rlike(R.KNOWN_LICENSE).alias("known"), F.inline(hits(F.col("text"), R.IP_MARKERS)))
    return found.where(~known).drop("known", "place", "message")


def classify_license(df: DataFrame, text: str = "text") -> DataFrame:
    """df with spdx_id and risk_tier: an exact id, else the first pattern that matches, else null. Most texts fail one cheap test."""
    tier = {spdx.lower(): (spdx, t) for spdx, t, _ in reversed(R.LICENSES)}
    exact = F.create_map(*[F.lit(x) for key, (spdx, _) in tier.items() for x in (key, spdx)])
    first = F.coalesce(exact[F.lower(F.col(text))], *[F.when(F.col(text).rlike(p), F.lit(s)) for s, _, p in R.LICENSES])
    first = F.when(F.col(text).rlike(R.LICENSE_WORD), first)
    tiers = F.create_map(*[F.lit(x) for spdx, t in tier.values() for x in (spdx, t)])
    return df.withColumn("spdx_id", first).withColumn("risk_tier", tiers[F.col("spdx_id")])


def scan_language_pack(lines: DataFrame) -> DataFrame:
    """Each language's own pack; 50 a file."""
    each = [F.when((F.col("language") == lang) & F.col("text").rlike(r.pattern), F.struct(F.lit(k).alias("place"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for k, (lang, r) in enumerate(R.LANGUAGE_PACKS)]
    found = lines.select(*FILE, F.col("line_no").alias("line"), F.inline(F.filter(F.array(*each), lambda h: h.isNotNull())))
    return cap(found, FILE, ["place", "line"], 50).drop("place")


def scan_deprecated(lines: DataFrame, majors: DataFrame) -> DataFrame:
    """Uses of what a repo's framework versions have dropped. majors: repo, framework, major."""
    each = [F.when(F.col("text").rlike(p), F.struct(F.lit(fw).alias("framework"), F.lit(least).alias("least"), F.lit(p).alias("pattern"), F.lit(s).alias("severity"))) for fw, least, p, s in R.DEPRECATED]
    found = lines.select(*FILE, F.col("line_no").alias("line"), F.inline(F.filter(F.array(*each), lambda h: h.isNotNull())))
    return found.join(majors, ["repo", "framework"]).where("major >= least").select(*FILE, "line", "framework", "pattern", "severity")


def risky_api_inventory(lines: DataFrame) -> DataFrame:
    """Files with the risky APIs that they use."""
    return scan_rules(lines, R.RISKY).select(*FILE, "rule_id", "severity").distinct()


def check_casts(lines: DataFrame) -> DataFrame:
    rules = [
        R.Rule("as-never", "P1", r"as\s+never", ""),
        R.Rule("as-any", "P2", r"as\s+any\b", ""),
        R.Rule("ts-suppress", "P2", r"@ts-ignore|@ts-expect-error", ""),
        R.Rule("non-null-call", "P1", r"\w+\([^)]*\)!\.", ""),
    ]
    found = lines.select(*FILE, F.col("line_no").alias("line"), F.col("text").rlike(r"//.*as any").alias("noted"), F.inline(hits(F.col("text"), rules)))
    return found.where(~(F.col("noted") & (F.col("rule_id") == "as-any"))).select(*FILE, "line", "rule_id", "severity")


def check_math(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    name = F.regexp_extract(t, r"(\w+)\.sort\(", 1)
    tests = {
        ("score-times-100", "P1"): t.rlike(r"Score.*Math\.round\(\w+\s*\*\s*100\)|score.*\*\s*100"),
        ("divide-by-count", "P1"): t.rlike(r"/\s*(?:\w+\.length|scores\.length|total|count)") & ~t.rlike(r"Math\.max\s*\(\s*1") & ~t.contains(" 1"),
        ("sort-in-place", "P2"): t.rlike(r"\w+\.sort\(") & ~t.contains("[...") & ~t.contains("Array.from") & ~t.rlike(r"[\])]\s*\.sort") & ~name.rlike("^(?:_|temp|sorted|copy)"),
    }
    each = [F.when(test, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for (r, s), test in tests.items()]
    return lines.select(*FILE, F.col("line_no").alias("line"), F.inline(F.filter(F.array(*each), lambda h: h.isNotNull())))


def check_brace_balance(lines: DataFrame) -> DataFrame:
    """Files whose braces close too early (first such line) or do not add up at the end."""
    deep = brace_depth(lines)
    return deep.groupBy(*FILE).agg(F.min(F.when(F.col("depth") < 0, F.col("line_no"))).alias("early_line"), F.sum("delta").alias("left_open")).where("early_line IS NOT NULL OR left_open <> 0")


def check_declaration_order(lines: DataFrame) -> DataFrame:
    """Names used on an earlier line than the one that declares them."""
    declared = lines.select(*FILE, F.col("line_no"), F.regexp_extract("text", r"^\s*(?:export\s+)?(?:const|let|class)\s+(\w+)", 1).alias("name")).where("name <> ''").groupBy(*FILE, "name").agg(F.min("line_no").alias("declared"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), 1))
    used = lines.select(*FILE, "line_no", F.explode(words).alias("name")).groupBy(*FILE, "name").agg(F.min("line_no").alias("used"))
    return declared.join(used, [*FILE, "name"]).where("used < declared")


def check_leaks(lines: DataFrame) -> DataFrame:
    """Resources that a file acquires and never releases. One row for each kind."""
    pairs = [("interval", r"setInterval\(", r"clearInterval\("), ("listener", r"addEventListener\(", r"removeEventListener\("), ("stream", r"createReadStream\(|createWriteStream\(", r"\.close\(|\.destroy\(|\.end\("), ("push", r"\.push\(", r"\.pop\(|\.splice\(|\.shift\(")]
    each = [F.struct(F.lit(k).alias("kind"), F.col("text").rlike(a).cast("long").alias("a"), F.col("text").rlike(r).cast("long").alias("r")) for k, a, r in pairs]
    seen = lines.select(*FILE, F.inline(F.array(*each))).groupBy(*FILE, "kind").agg(F.sum("a").alias("acquired"), F.sum("r").alias("released"))
    return seen.where("acquired > 0 AND released = 0").drop("released")


def load_risk(lines: DataFrame) -> DataFrame:
    """Static load risks of each file and its score."""
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p))).cast("long")
    c = lines.groupBy(*FILE).agg(count(r"(?:for|while)\s*\(.*\{.*(?:for|while)\s*\(").alias("nested"), count("readFileSync|writeFileSync|execSync").alias("sync_io"), count(r"\.push\(").alias("pushes"), count(r"let\s+\w+\s*[:=]").alias("lets"))
    lost = (F.col("nested") > 0).cast("int") * 25 + (F.col("sync_io") > 3).cast("int") * 10 + (F.col("pushes") > 5).cast("int") * 10 + (F.col("lets") > 10).cast("int") * 5
    return c.withColumn("score", F.greatest(F.lit(0), 100 - lost))


def extract_symbols(lines: DataFrame) -> DataFrame:
    """Declared functions, classes, variables, types and interfaces."""
    kinds = {"function": r"(?:^|\s)function\s+(\w+)", "class": r"(?:^|\s)class\s+(\w+)", "variable": r"(?:^|\s)(?:const|let|var)\s+(\w+)", "type": r"(?:^|\s)type\s+(\w+)\s*=", "interface": r"(?:^|\s)interface\s+(\w+)"}
    each = [F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name"))) for k, p in kinds.items()]
    return lines.select(*FILE, F.col("line_no").alias("line"), F.inline(F.filter(F.array(*each), lambda h: h.isNotNull()))).distinct()


def extract_imports(lines: DataFrame) -> DataFrame:
    """Import specifiers with their kind."""
    found = F.concat(F.regexp_extract_all("text", F.lit(r"(?:from|import)\s+['\"]([^'\"]+)['\"]"), 1), F.regexp_extract_all("text", F.lit(r"require\(['\"]([^'\"]+)['\"]\)"), 1))
    out = lines.select(*FILE, F.col("line_no").alias("line"), F.explode(found).alias("specifier"))
    return out.withColumn("kind", F.when(F.col("specifier").startswith("."), "local").when(F.col("specifier").startswith("@"), "scoped").otherwise("external"))


def embedded_languages(pages: DataFrame) -> DataFrame:
    """Blocks of other languages inside html, with their risk."""
    kinds = {"javascript": r"(?i)<script[\s>]", "css": r"(?i)<style[\s>]", "svg": r"(?i)<svg[\s>]", "sql": r"(?i)\bSELECT\s+.+\s+FROM\s"}
    each = [F.struct(F.lit(k).alias("embedded"), F.regexp_count("html", F.lit(p)).cast("long").alias("n")) for k, p in kinds.items()]
    found = pages.select("page_id", F.inline(F.array(*each))).where("n > 0")
    return found.withColumn("risk", F.when(F.col("n") > 10, "high").when(F.col("n") > 3, "medium").otherwise("low"))


def accessibility(pages: DataFrame) -> DataFrame:
    """Images without alt, inputs without label, empty buttons and links without text, and a score."""
    lacking = lambda tag, attribute: F.size(F.filter(F.regexp_extract_all("html", F.lit(rf"(?i)(<{tag}(?:\s[^>]*)?>)"), 1), lambda t: ~t.rlike(rf"(?i)\s{attribute}\s*=")))
    c = pages.select(
        "page_id",
        lacking("img", "alt").cast("long").alias("img_no_alt"),
        lacking("input", "aria-label").cast("long").alias("input_no_label"),
        F.regexp_count("html", F.lit(r"(?i)<button[^>]*>\s*</button>")).cast("long").alias("empty_button"),
        lacking("html", "lang").cast("long").alias("no_lang"),
    )
    return c.withColumn("score", F.greatest(F.lit(0), 100 - 10 * (F.col("img_no_alt") + F.col("input_no_label") + F.col("empty_button") + F.col("no_lang"))))


def blank_runs(lines: DataFrame) -> DataFrame:
    """The third line of every run of blank lines."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    blank = lines.withColumn("nth", F.row_number().over(order)).where(F.trim("text") == "")
    islands = blank.withColumn("island", F.col("nth") - F.row_number().over(order))
    return islands.withColumn("place", F.row_number().over(W.partitionBy(*FILE, "island").orderBy("line_no"))).where("place = 3").select(*FILE, F.col("line_no").alias("line"))


def comment_streaks(lines: DataFrame, least: int = 2) -> DataFrame:
    """Runs of comment lines, and the file's share of comments."""
    order = W.partitionBy(*FILE).orderBy("line_no")
    whole = W.partitionBy(*FILE)
    comment = F.col("text").rlike(r"^\s*(//|#|\*|/\*)")
    marked = lines.withColumn("comment", comment).withColumn("nth", F.row_number().over(order)).withColumn("comments", F.sum(comment.cast("long")).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    runs = marked.where("comment").withColumn("island", F.col("nth") - F.row_number().over(order))
    return runs.groupBy(*FILE, "island", "comments", "n").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).select(*FILE, "first_line", "length", (F.floor(F.col("comments") * 1000 / F.col("n") + 0.5) / 1000).alias("comment_share"))


def repeated_literals(lines: DataFrame, least: int = 3) -> DataFrame:
    """String literals that a file repeats."""
    found = lines.select(*FILE, F.explode(F.regexp_extract_all("text", F.lit(r"'([^']{3,})'"), 1)).alias("value"))
    return found.groupBy(*FILE, "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
