"""Findings: validation, enrichment, suppression, deduplication, merging and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import family, js_round, snippet_hash
from lintlake.operators import rules as R

#: Order of severities and confidences (fixed values).
SEVERITIES = ["critical", "error", "warning", "info"]
CONFIDENCES = ["high", "medium", "low"]


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a list, after its end for anything else."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("int")


def validate_findings(f: DataFrame) -> DataFrame:
    """Complete findings with a known severity, the first of each rule and line, with evidence."""
    ok = f.where(F.col("rule_id").isNotNull() & (F.col("line") >= 1) & F.col("severity").isin(SEVERITIES) & (F.trim("message") != ""))
    w = W.partitionBy("repo", "file", "rule_id", "line").orderBy("finding_id")
    return ok.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").withColumn("evidence", F.concat(F.lit("regex:"), F.col("rule_id")))


def normalize_severity(f: DataFrame) -> DataFrame:
    """Criticals stay so in security and runtime families only."""
    kind = family(F.col("rule_id"))
    critical = F.when(kind.isin("SEC", "RTE"), "critical").when(kind.isin("ERR", "TYP", "ASY"), "error").otherwise("warning")
    return f.withColumn("severity", F.when(F.col("severity") == "critical", critical).when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("info"))


#: Keywords of each team's messages, in order (fixed values).
ROUTES = [
    ("release-ip", "eval|security|xss|injection|secret|credential|password"),
    ("simulation", "loop|recursive|infinite|stack overflow"),
    ("stability", "try.?catch|exception|reject|await.*without|unhandled"),
    ("size-density", "nest|depth|complex|cognitive"),
    ("asset-trace", "unused|dead|unreachable|orphan|@ts-ignore"),
    ("validation", r"null|undefined|===|!==|==\s|!=\s|nullable|optional"),
    ("generation", r"empty function|todo|fixme|hack|console\.|stub"),
    ("governance", "import|dependency|circular|architecture"),
    ("stability", "error"),
]


def route_team(message: Column) -> Column:
    """The first team whose keywords a message has, else governance."""
    return reduce(lambda out, r: F.when(message.rlike(f"(?i){r[1]}"), r[0]).otherwise(out), reversed(ROUTES), F.lit("governance"))


def classify_level(severity: Column, rule_id: Column, confidence: Column) -> Column:
    hard = family(rule_id).isin("SEC", "RTE") & (confidence != "low")
    heavy = F.coalesce(F.create_map(*[F.lit(x) for kv in R.TEAM_WEIGHTS.items() for x in kv])[F.lower(F.substring_index(rule_id, "-", 1))], F.lit(1.0)) >= 1.5
    return (
        F.when(severity == "critical", F.when(hard, "hard-fail").when(confidence == "high", "review-required").otherwise("style-note"))
        .when(severity == "error", F.when(confidence == "low", "style-note").otherwise("review-required"))
        .when((severity == "warning") & ((confidence != "low") | heavy), "review-required")
        .otherwise("style-note")
    )


def corroborate(f: DataFrame) -> DataFrame:
    """Teams that agree on a line and rule lift its confidence one step."""
    teams = F.size(F.collect_set("team").over(W.partitionBy("repo", "file", "line", "rule_id")))
    lifted = F.when(F.col("confidence") == "low", "medium").otherwise("high")
    return f.withColumn("teams", teams).withColumn("confidence", F.when(F.col("teams") > 1, lifted).otherwise(F.col("confidence")))


def correlate(f: DataFrame) -> DataFrame:
    """Root causes of a file: both rules of a pair are present."""
    present = f.select("repo", "file", "rule_id").distinct()
    pairs = F.array(*[F.struct(F.lit(c).alias("root_cause"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, c in R.CORRELATED])
    wanted = present.select("repo", "file", "rule_id", F.inline(pairs)).where("rule_id = a OR rule_id = b")
    return wanted.groupBy("repo", "file", "root_cause").agg(F.countDistinct("rule_id").alias("n")).where("n = 2").drop("n")


def keep_best(f: DataFrame) -> DataFrame:
    """One finding for each team, line and message start: the most confident, then the earliest."""
    w = W.partitionBy("repo", "file", "team", "line", F.left("message", F.lit(40))).orderBy(rank_of(F.col("confidence"), CONFIDENCES), "finding_id")
    return f.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def merge_duplicates(f: DataFrame) -> DataFrame:
    """One finding for each line and message: highest severity and confidence, all rules as evidence."""
    return f.groupBy("repo", "file", "line", "message").agg(
        F.min_by("severity", rank_of(F.col("severity"), SEVERITIES)).alias("severity"),
        F.min_by("confidence", rank_of(F.col("confidence"), CONFIDENCES)).alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("evidence"),
        F.count(F.lit(1)).alias("merged"),
    )


def merge_engines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of two engines by rule and line; what both see gets medium lifted to high."""
    both = a.withColumn("engine", F.lit("a")).unionByName(b.withColumn("engine", F.lit("b")), allowMissingColumns=True)
    out = both.groupBy("repo", "file", "rule_id", "line").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.min_by("confidence", rank_of(F.col("confidence"), CONFIDENCES)).alias("confidence"))
    return out.withColumn("confidence", F.when((F.col("engines") == "a,b") & (F.col("confidence") == "medium"), "high").otherwise(F.col("confidence")))


def compare_scans(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two scans: fixed, persisting or new."""
    keys = ["repo", "file", "rule_id", "line"]
    a, b = before.select(*keys).distinct().withColumn("was", F.lit(True)), after.select(*keys).distinct().withColumn("is", F.lit(True))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "fixed").otherwise("persisting")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def snippet_hashes(f: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """f with the hash of the lines round each finding. Only the lines near a finding are joined."""
    near = f.select("repo", "path", "line").distinct().withColumn("line_no", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)))
    texts = near.join(lines.select("repo", "path", "line_no", "text"), ["repo", "path", "line_no"]).groupBy("repo", "path", "line").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("t"))
    return f.join(texts, ["repo", "path", "line"], "left").withColumn("snippet_hash", F.coalesce(snippet_hash(F.array_join("t.text", "\n")), F.lit(""))).drop("t")


def apply_baseline(f: DataFrame, base: DataFrame) -> DataFrame:
    return f.join(base.select("repo", "path", "snippet_hash", "rule_id").distinct(), ["repo", "path", "snippet_hash", "rule_id"], "left_anti")


def parse_suppressions(lines: DataFrame, word: str = "quality") -> DataFrame:
    """Suppression comments: the next line's rule, or the whole file's."""
    rule_next = F.regexp_extract("text", rf"//\s*{word}-disable-next-line\s+(\S+)", 1)
    rule_file = F.regexp_extract("text", rf"//\s*{word}-disable-file\s+(\S+)", 1)
    each = F.array(
        F.struct(F.lit("next-line").alias("kind"), rule_next.alias("rule_id"), (F.col("line_no") + 1).alias("line")),
        F.struct(F.lit("file").alias("kind"), rule_file.alias("rule_id"), F.lit(0).alias("line")),
    )
    return lines.select("repo", "path", F.inline(F.filter(each, lambda s: s["rule_id"] != "")))


def apply_suppressions(f: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings that no comment suppresses; `*` stands for every rule."""
    s = parse_suppressions(lines).distinct()
    line, file = s.where("kind = 'next-line'"), s.where("kind = 'file'")
    out = f.join(line.where("rule_id <> '*'").select("repo", "path", "line", "rule_id"), ["repo", "path", "line", "rule_id"], "left_anti")
    out = out.join(line.where("rule_id = '*'").select("repo", "path", "line"), ["repo", "path", "line"], "left_anti")
    out = out.join(file.where("rule_id <> '*'").select("repo", "path", "rule_id"), ["repo", "path", "rule_id"], "left_anti")
    return out.join(file.where("rule_id = '*'").select("repo", "path"), ["repo", "path"], "left_anti")


def with_context(f: DataFrame, lines: DataFrame, k: int = 3) -> DataFrame:
    """f with the texts from k lines before to k lines after."""
    near = f.select("repo", "path", "line").distinct().withColumn("line_no", F.explode(F.sequence(F.col("line") - k, F.col("line") + k)))
    texts = near.join(lines.select("repo", "path", "line_no", "text"), ["repo", "path", "line_no"]).groupBy("repo", "path", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("context"))
    return f.join(texts, ["repo", "path", "line"], "left")


def counts(f: DataFrame, *keys: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    sec = family(F.col("rule_id")).isin("SEC", "RTE") & (F.col("severity") == "critical")
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(sec).alias("sec_critical"), count("critical").alias("critical"), count("error").alias("error"), count("warning").alias("warning"), count("info").alias("info"))


def team_scores(f: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("team")], F.lit(1.0))
    raw = 15 * F.col("sec_critical") + 10 * F.col("error") + 3 * (F.col("critical") - F.col("sec_critical")) + 2 * F.col("warning")
    return counts(f, "repo", "team").select("repo", "team", F.greatest(F.lit(0), 100 - js_round(raw * weight)).alias("score"))


def run_verdict(f: DataFrame) -> DataFrame:
    """Verdict and score of each repo from its findings' levels."""
    level = classify_level(F.col("severity"), F.col("rule_id"), F.col("confidence"))
    n = f.groupBy("repo").agg(*[F.count_if(level == v).alias(k) for k, v in (("hard_fail", "hard-fail"), ("review", "review-required"), ("note", "style-note"))])
    penalty = F.least(F.lit(35), js_round(F.log2(F.col("review") + 1.0) * 5))
    verdict = F.when(F.col("hard_fail") > 0, "fail").when(F.col("review") > 0, "review").otherwise("pass")
    score = F.when(F.col("hard_fail") > 0, F.greatest(F.lit(0), 50 - F.col("hard_fail") * 10)).when(F.col("review") > 0, F.greatest(F.lit(60), 100 - penalty)).otherwise(100)
    return n.select("*", verdict.alias("verdict"), score.cast("long").alias("score"))


def team_verdicts(f: DataFrame, most: int = 30) -> DataFrame:
    """Verdict of each team from its first findings; teams with more are capped."""
    w = W.partitionBy("repo", "team")
    few = f.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("n", F.row_number().over(w.orderBy("finding_id"))).where(F.col("n") <= most)
    out = few.groupBy("repo", "team", "total").agg(F.count_if(F.col("severity") == "critical").alias("hard_fail"), F.count_if(F.col("severity").isin("error", "warning")).alias("review"), F.count_if(~F.col("severity").isin("critical", "error", "warning")).alias("note"))
    verdict = F.when(F.col("total") > most, "bail-out").when(F.col("hard_fail") > 0, "fail").when(F.col("review") > 0, "review").otherwise("pass")
    return out.select("repo", "team", "hard_fail", "review", "note", F.least("total", F.lit(most)).alias("total"), verdict.alias("verdict"))


def composite_verdict(verdicts: DataFrame) -> DataFrame:
    """Verdict of a repo over its teams; a capped team counts as review, with score 40 at half weight."""
    score = F.when(F.col("verdict") == "bail-out", 40.0).otherwise(F.greatest(F.lit(0), 100 - 10 * F.col("hard_fail") - 2 * F.col("review")).cast("double"))
    weight = F.when(F.col("verdict") == "bail-out", 0.5).otherwise(1.0)
    out = verdicts.groupBy("repo").agg(F.bool_or(F.col("verdict") == "fail").alias("failed"), F.bool_or(F.col("verdict").isin("review", "bail-out")).alias("reviewed"), (F.sum(score * weight) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("teams"))
    return out.select("repo", F.when(F.col("failed"), "fail").when(F.col("reviewed"), "review").otherwise("pass").alias("verdict"), js_round(F.col("mean")).alias("score"), "teams")


def volume_anomalies(f: DataFrame, sigmas: int = 2) -> DataFrame:
    """Files whose number of findings stands out in their repo.

    Mean and deviation are taken from whole sums of counts and of their squares, so the last digits do not depend on the order of rows.
    """
    n = f.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("findings"))
    w = W.partitionBy("repo")
    files, total = F.count(F.lit(1)).over(w), F.sum("findings").over(w)
    squares = F.sum(F.col("findings").cast("decimal(19,0)") * F.col("findings")).over(w)
    spread = F.col("files") * F.col("squares") - F.col("total").cast("decimal(19,0)") * F.col("total")
    sums = n.withColumns({"files": files, "total": total, "squares": squares})
    z = sums.select("repo", "file", "findings", (F.col("total") / F.col("files")).alias("mean"), (F.sqrt(spread.cast("double")) / F.col("files")).alias("dev"))
    z = z.withColumn("z", F.when(F.col("dev") > 0, (F.col("findings") - F.col("mean")) / F.col("dev")).otherwise(0.0))
    status = F.when(F.col("findings") > F.greatest(F.col("mean") + sigmas * F.col("dev"), F.lit(20.0)), "anomaly").when(F.col("z") > 1.5, "elevated").otherwise("normal")
    return z.select("repo", "file", "findings", (js_round(F.col("z") * 100) / 100).alias("z_score"), status.alias("status"))


def adjust_for_anomalies(f: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Totals of each repo with and without its anomalous files."""
    bad = anomalies.where("status = 'anomaly'").select("repo", "file", F.lit(True).alias("bad"))
    return f.join(bad, ["repo", "file"], "left").groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("bad").isNull()).alias("adjusted"))


def severity_report(f: DataFrame) -> DataFrame:
    """Counts of each repo in all, by rule and by file."""
    both = f.groupingSets([["repo"], ["repo", "rule_id"], ["repo", "file"]], "repo", "rule_id", "file")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity").isin("critical", "error")).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def capped_score(f: DataFrame) -> DataFrame:
    """Score of a file with each severity's penalty capped, never under 50."""
    c = counts(f, "repo", "file")
    lost = F.least("critical", F.lit(3)) * 8 + F.least("error", F.lit(5)) * 3 + F.least("warning", F.lit(10))
    return c.select("repo", "file", F.greatest(F.lit(50), 100 - lost).cast("long").alias("score"))


def filter_stats(f: DataFrame, dismissed: Column) -> DataFrame:
    """Dismissals of each rule, and rules that lose over half."""
    out = f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(dismissed).alias("dismissed"))
    return out.withColumn("over_suppressed", F.col("dismissed") * 2 > F.col("total"))


def apply_dismissals(f: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Scores of each repo without what either judge dismisses."""
    gone = first.select("finding_id").union(second.select("finding_id")).distinct()
    left = f.join(gone, "finding_id", "left_anti")
    c = counts(left, "repo")
    return c.select("repo", "total", F.greatest(F.lit(0), 100 - F.least(F.lit(30), F.col("error") * 5) - F.least(F.lit(20), F.col("warning") * 2)).cast("long").alias("score"))


def review_metrics(f: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Of each repo: findings, dismissals of either judge and how often they agree."""
    a, b = first.select("finding_id", F.lit(1).alias("a")), second.select("finding_id", F.lit(1).alias("b"))
    j = f.join(a, "finding_id", "left").join(b, "finding_id", "left")
    return j.groupBy("repo").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("after"), F.count_if(F.col("a").isNull() == F.col("b").isNull()).alias("agreed"))


def resolve_policy(targets: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy that holds for each repo, path and rule: global, else the longest workspace prefix, else module."""
    hit = targets.join(policies, "rule_id").where((F.col("scope") == "global") | F.expr("startswith(path, prefix)"))
    order = W.partitionBy("repo", "path", "rule_id").orderBy(F.when(F.col("scope") == "global", 0).when(F.col("scope") == "workspace", 1).otherwise(2), F.length("prefix").desc(), "action")
    return hit.withColumn("n", F.row_number().over(order)).where("n = 1").select("repo", "path", "rule_id", "scope", "action")


def policy_conflicts(policies: DataFrame) -> DataFrame:
    """Rules with more than one action, and the one of the widest scope."""
    scope = F.when(F.col("scope") == "global", 0).when(F.col("scope") == "workspace", 1).otherwise(2)
    return policies.groupBy("rule_id").agg(F.countDistinct("action").alias("actions"), F.min_by("action", F.struct(scope, F.col("action"))).alias("winner")).where("actions > 1")


def cross_file_null(lines: DataFrame, reach: int = 10) -> DataFrame:
    """Results of functions that may return nothing, used unguarded in other files: repo, path, line, variable, name, definitions.

    Such a function is exported and says null or undefined in its declaration, or returns either before the next declared function. A
    call is told of if a variable takes its result, a member of that is read within the next lines, and none of these tests it (`!x`, `x?.`, or
    `x` compared with null or undefined by ==). definitions counts the files of the repo that define such a function, the caller's own left out.

    Definitions are counted by repo and name first, so a popular name meets each call once; lines are met by their numbers.
    """
    text = F.col("text")
    declared = F.nullif(F.regexp_extract(text, r"(?:^|\s)function\s+(\w+)", 1), F.lit(""))
    said = F.coalesce(text.rlike(r"\breturn\s+(?:null|undefined)\b") | (declared.isNotNull() & text.rlike(r"\b(?:null|undefined)\b")), F.lit(False))
    above = W.partitionBy("repo", "path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    exported = F.when(declared.isNotNull(), F.struct(declared.alias("name"), text.rlike(r"^\s*export\s").alias("exported")))
    bound = lines.select("repo", "path", said.alias("said"), F.last(exported, ignorenulls=True).over(above).alias("f")).where("said AND f.exported")
    own = bound.select("repo", "path", F.col("f.name").alias("name")).distinct()
    total = own.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("files"))

    taken = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:await\s+)?(\w+)\("
    calls = lines.where(text.rlike(taken)).select("repo", "path", F.col("line_no").alias("line"), F.regexp_extract(text, taken, 1).alias("variable"), F.regexp_extract(text, taken, 2).alias("name")).distinct()
    met = calls.join(total, ["repo", "name"]).join(own.withColumn("own", F.lit(1)), ["repo", "path", "name"], "left")
    asked = met.withColumn("definitions", F.col("files") - F.coalesce("own", F.lit(0))).where("definitions > 0")
    near = asked.select("repo", "path", "line", "variable", "name", "definitions", F.explode(F.sequence(F.col("line") + 1, F.col("line") + reach)).alias("line_no")).join(lines.select("repo", "path", "line_no", "text"), ["repo", "path", "line_no"])
    x = F.col("variable")
    tests = F.array(F.concat(F.lit("!"), x), F.concat(x, F.lit("?.")), F.concat(x, F.lit(" == null")), F.concat(x, F.lit(" === null")), F.concat(x, F.lit(" === undefined")))
    flags = near.groupBy("repo", "path", "line", "variable", "name", "definitions").agg(
        F.bool_or(F.exists(tests, lambda t: F.contains(F.col("text"), t))).alias("guarded"), F.bool_or(F.regexp_like("text", F.concat(F.lit(r"\b"), x, F.lit(r"\.\w")))).alias("read"),
    )
    return flags.where("read AND NOT guarded").select("repo", "path", "line", "variable", "name", "definitions")
