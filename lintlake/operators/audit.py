"""The project audit: sixteen areas of a repo, each with a score and a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import js_round

#: Patterns of secrets, each counted once a file (fixed values).
SECRETS = [r"(?i)api[_-]?key\s*[:=]\s*['\"`]\w{10,}", r"(?i)password\s*[:=]\s*['\"`]", r"BEGIN\s+(?:RSA|DSA|EC)\s+PRIVATE"]

#: Areas that read the lines, and areas that read a table of the caller's: name, category (fixed values).
OWN = [("structure", "structure"), ("tests", "quality"), ("security", "security"), ("dependencies", "performance"), ("types", "quality"), ("errors", "quality"), ("documents", "structure"), ("style", "quality")]
GIVEN = [("lint", "quality"), ("unused", "performance"), ("deep", "quality"), ("advisories", "security"), ("accessibility", "quality"), ("syntax", "quality"), ("deprecated", "quality"), ("bundle", "performance")]


def _steps(value: Column, *steps: tuple[int, int], last: int) -> Column:
    """The score of the first limit that a value stays under."""
    out = F.lit(last)
    for limit, score in reversed(steps):
        out = F.when(value < limit, score).otherwise(out)
    return out


def _less(start: int, value: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(start) - value)


def project_audit(lines: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """repo, area, category, score for every repo with a line.

    Eight areas come from the lines (repo, path, line_no, text) and from tables["dependencies"] (repo, amount); the others from
    tables by their names with repo and amount, the score itself for lint, unused, accessibility and bundle, a count for deep
    (worst findings), syntax and deprecated; advisories has repo, critical, high. Without their table lint is 70 and unused 80,
    and the other areas are left out, as they are for a repo that its table does not name. Lines are counted by file before
    the shuffle.
    """
    text, flag = F.col("text"), lambda test: F.coalesce(F.max(F.when(test, 1)), F.lit(0))
    count = lambda pattern: F.sum(F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)))
    files = lines.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("lines"),
        sum((flag(text.rlike(p)) for p in SECRETS), F.lit(0)).alias("secrets"),
        count(r":\s*any\b").alias("anys"),
        count(r"catch\s*\(\s*\)\s*\{").alias("empty"),
        F.count_if(text.rlike(r";\s*$")).alias("closed"),
        F.count_if(text.rlike(r"[^;{}\s]\s*$")).alias("open"),
    )
    path = F.col("path")
    facts = files.groupBy("repo").agg(
        js_round(F.avg("lines")).alias("lines"),
        F.bool_or(path.rlike(r"(?i)test|spec|__tests__")).alias("tests"),
        F.sum("secrets").alias("secrets"),
        F.sum("anys").alias("anys"),
        F.sum("empty").alias("empty"),
        F.bool_or(path.rlike(r"(?:^|/)README\.md$")).alias("readme"),
        F.bool_or(path.rlike(r"(?:^|/)LICENSE$")).alias("license"),
        F.count_if((F.col("closed") > 5) & (F.col("open") > 5)).alias("mixed"),
    )
    for name in ("dependencies", *(n for n, _ in GIVEN)):
        if name in tables:
            facts = facts.join(tables[name].select("repo", F.struct(*[c for c in tables[name].columns if c != "repo"]).alias(name)), "repo", "left")
    c = F.col
    used = F.coalesce(c("dependencies.amount"), F.lit(0)) if "dependencies" in tables else F.lit(0)
    document = F.when(c("readme"), 40).otherwise(0) + F.when(c("license"), 30).otherwise(0) + F.when(used > 0, 20).otherwise(0) + 10
    scores = {
        "structure": _steps(c("lines"), (300, 90), (500, 70), last=50),
        "tests": F.when(c("tests"), 70).otherwise(20),
        "security": F.when(c("secrets") == 0, 95).otherwise(_less(70, 15 * c("secrets"))),
        "dependencies": _steps(used, (30, 90), (60, 70), last=50),
        "types": F.when(c("anys") == 0, 95).otherwise(_less(85, 3 * c("anys"))),
        "errors": F.when(c("empty") < 3, 85).otherwise(_less(75, 5 * c("empty"))),
        "documents": F.least(F.lit(100), document),
        "style": F.when(c("mixed") < 2, 90).otherwise(60),
        "lint": F.coalesce(c("lint.amount"), F.lit(70)) if "lint" in tables else F.lit(70),
        "unused": F.coalesce(c("unused.amount"), F.lit(80)) if "unused" in tables else F.lit(80),
    }
    for name, start, per in (("deep", 100, 25), ("syntax", 100, 10), ("deprecated", 100, 15)):
        if name in tables:
            scores[name] = F.when(c(name).isNotNull(), _less(start, per * c(f"{name}.amount")))
    if "advisories" in tables:
        scores["advisories"] = F.when(c("advisories").isNotNull(), _less(100, 30 * c("advisories.critical") + 15 * c("advisories.high")))
    for name in ("accessibility", "bundle"):
        if name in tables:
            scores[name] = c(f"{name}.amount")
    areas = [F.struct(F.lit(n).alias("area"), F.lit(k).alias("category"), scores[n].cast("long").alias("score")) for n, k in OWN + GIVEN if n in scores]
    return facts.select("repo", F.inline(F.array(*areas))).where("score IS NOT NULL")


def audit_summary(areas: DataFrame) -> DataFrame:
    """Of each repo: rounded mean of its areas, and whether a security area under 50 stops it."""
    gate = F.bool_or((F.col("category") == "security") & (F.col("score") < 50))
    return areas.groupBy("repo").agg(js_round(F.avg("score")).cast("long").alias("score"), gate.alias("stopped"))
