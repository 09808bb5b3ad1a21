"""Names bound to their declarations by scope.

A declaration is visible in a span: that of its block (const, let, class, function), of its function (var), of its own body
(parameters, catch) or in the whole file (imports). A use belongs to the innermost span that declares its name. No use meets
all declarations of its name: for each file and name the starts and ends of scopes and the uses stand in one order, a running count
says how many scopes are open, and the last scope opened at that count is the one.

Names are those of `code`, so strings and comments hold none; names behind a dot and keys of object literals are no uses. Of several names
that one statement declares with commas the first counts. Parameters of a head over several lines are visible from its brace's line on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.operators.scratch import deal, settle
from lintlake.operators.syntax import FILE, spans

NAME = r"[A-Za-z_$][\w$]*"
USE = rf"(?:^|[^.\w$])({NAME})"
BEFORE_ALL, PAST_ALL = -1, 1 << 62
#: Order of what happens at one place: a head's own scope opens, names are used, a scope closes, a block's scope opens.
OPEN_HEAD, USED, CLOSED, OPEN_BLOCK = 0, 1, 2, 3


def place(line: str = "line_no", part: str = "part") -> Column:
    return F.col(line).cast("long") * (1 << 20) + F.col(part)


def _innermost(nodes: DataFrame, depth: str, opens: str, out: str) -> DataFrame:
    """nodes with `out`: place and kind of the innermost open span for which `opens` holds; `depth` counts such spans."""
    kept = nodes.columns
    # a brace that opens such a span stands a second time, one deeper, for what lies inside
    ranks = F.when(F.expr(f"brace = '{{' AND ({opens})"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = nodes.select("*", F.explode(ranks).alias("rank")).withColumn("key", F.col(depth) + F.col("rank")).withColumn("opened", F.when(F.col("rank") == 1, F.struct(place().alias("at"), "kind")))
    w = W.partitionBy(*FILE, "key").orderBy("line_no", "part", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(out, F.last("opened", ignorenulls=True).over(w)).where("rank = 0").select(*kept, out)


def placed(nodes: DataFrame) -> DataFrame:
    """The pieces of tree() with the innermost span and the innermost function of each (null at the top of a file), without counts."""
    narrow = nodes.select(*FILE, "line_no", "part", "code", "brace", "head", "kind", "name", "parameters", "level", "functions")
    named = "kind IN ('function', 'method', 'arrow')"
    inner = _innermost(deal(narrow, nodes.count(), *FILE, each=1 << 17), "level", "true", "block")
    written = settle(_innermost(inner, "functions", named, "body").withColumn("block", F.when(F.col("level") > 0, F.col("block"))).withColumn("body", F.when(F.col("functions") > 0, F.col("body"))))
    return deal(written, nodes.count(), *FILE, each=1 << 17)


def _names(text: Column, pattern: str, group: int = 1) -> Column:
    return F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def declarations(pieces: DataFrame, tree_spans: DataFrame) -> DataFrame:
    """(repo, path, name, sort, line, exported, opens, opens_at, closes): every declared name with the places between which it is visible."""
    ends = tree_spans.select(*FILE, place("start", "start_part").alias("opens"), F.coalesce(place("end", "end_part"), F.lit(PAST_ALL)).alias("closes"))
    exported = F.col("code").rlike(r"\bexport\b")
    words = pieces.select(*FILE, "line_no", "block", "body", exported.alias("exported"), _names(F.col("code"), rf"\b((?:const|let|var|class)\s+{NAME})").alias("found"))
    said = words.select(*FILE, "line_no", "exported", F.regexp_extract("found", r"^(\w+)", 1).alias("sort"), F.regexp_extract("found", rf"({NAME})$", 1).alias("name"), "block", "body")
    by_span = said.select(*FILE, "name", "sort", F.col("line_no").alias("line"), "exported", F.when(F.col("sort") == "var", F.col("body.at")).otherwise(F.col("block.at")).alias("opens"), F.lit(OPEN_BLOCK).alias("opens_at"))
    made = pieces.where(rf"brace = '{{' AND kind = 'function' AND name <> '' AND rlike(head, '^(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?function\\b')")
    by_span = by_span.unionByName(made.select(*FILE, "name", F.lit("function").alias("sort"), F.col("line_no").alias("line"), F.col("head").rlike(r"\bexport\b").alias("exported"), F.col("block.at").alias("opens"), F.lit(OPEN_BLOCK).alias("opens_at")))
    own = pieces.where("brace = '{' AND kind IN ('function', 'method', 'arrow')").select(*FILE, "line_no", place().alias("opens"), F.explode("parameters").alias("p"), F.concat(F.lit("parameter of "), F.col("kind")).alias("sort"))
    own = own.select(*FILE, F.regexp_extract("p", rf"^(?:\.\.\.\s*|(?:public|private|protected|readonly)\s+)*({NAME})", 1).alias("name"), "sort", F.col("line_no").alias("line"), "opens")
    caught = pieces.where("brace = '{' AND kind = 'catch'").select(*FILE, F.regexp_extract("head", rf"^catch\s*\(\s*({NAME})", 1).alias("name"), F.lit("catch").alias("sort"), F.col("line_no").alias("line"), place().alias("opens"))
    by_span = by_span.unionByName(own.unionByName(caught).where("name <> ''").select("*", F.lit(False).alias("exported"), F.lit(OPEN_HEAD).alias("opens_at")))
    # names in braces: const { a, b: c } = and import { a as b }
    lists = pieces.where("brace = '{' AND kind = 'names'").select(*FILE, place().alias("at"), F.col("head").rlike(r"\bexport\b").alias("exported"), F.regexp_extract("head", r"\b(const|let|var|import|export)\b", 1).alias("sort"), F.col("block.at").alias("outer"))
    inside = pieces.where("block.kind = 'names'").select(*FILE, F.col("block.at").alias("at"), "line_no", _names(F.regexp_replace("code", rf"{NAME}\s*:\s*|\btype\s+|{NAME}\s+as\s+|=[^,]*", ""), rf"({NAME})").alias("name"))
    listed = inside.join(lists.hint("merge"), [*FILE, "at"]).where("sort <> 'export' AND name NOT IN ('from')").select(*FILE, "name", "sort", F.col("line_no").alias("line"), "exported", F.when(F.col("sort") != "import", F.col("outer")).alias("opens"), F.lit(OPEN_BLOCK).alias("opens_at"))
    whole = pieces.where("rlike(code, '^\\\\s*import\\\\s')").select(*FILE, "line_no", _names(F.col("code"), rf"^\s*import\s+(?:type\s+)?(?:\*\s+as\s+)?({NAME})\s*(?:,|\bfrom\b)").alias("name"))
    imported = whole.select(*FILE, "name", F.lit("import").alias("sort"), F.col("line_no").alias("line"), F.lit(False).alias("exported"), F.lit(None).cast("long").alias("opens"), F.lit(OPEN_BLOCK).alias("opens_at"))
    every = by_span.unionByName(listed).unionByName(imported)
    return every.join(ends.hint("merge"), [*FILE, "opens"], "left").select(*FILE, "name", "sort", "line", "exported", F.coalesce("opens", F.lit(BEFORE_ALL)).alias("opens"), "opens_at", F.coalesce("closes", F.lit(PAST_ALL)).alias("closes"))


def uses(pieces: DataFrame) -> DataFrame:
    """(repo, path, name, line, at): every name that stands in the code, declarations too."""
    code = F.regexp_replace(F.when(F.col("block.kind") == "object", F.regexp_replace("code", rf"(^|,)\s*{NAME}\s*:", "$1 ")).otherwise(F.col("code")), r"\.\.\.", " ")
    return pieces.select(*FILE, F.col("line_no").alias("line"), place().alias("at"), _names(code, USE).alias("name"))


def bindings(nodes: DataFrame) -> DataFrame:
    """One row for each name of each scope: repo, path, name, sort, line (first declaration), last_line, exported, top (of the file), declared, references (declarations too), first_use, shadows (an outer scope declares it).

    Only names that a file declares are bound. No side of a join is sent to every task: all grow with the files.
    """
    pieces = placed(nodes)
    once = declarations(pieces, spans(nodes, counts=False)).groupBy(*FILE, "name", "opens", "opens_at", "closes").agg(
        F.min(F.struct("line", "sort", "exported")).alias("first"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("declared")
    )
    known = settle(once)
    scope = F.struct(*[F.col(c) for c in ("opens", "opens_at", "first", "last_line", "declared")])
    opened = known.select(*FILE, "name", F.col("opens").alias("at"), F.col("opens_at").alias("rank"), F.lit(1).alias("step"), scope.alias("scope"), F.lit(None).cast("int").alias("line"))
    closed = known.select(*FILE, "name", F.col("closes").alias("at"), F.lit(CLOSED).alias("rank"), F.lit(-1).alias("step"), F.lit(None).cast(opened.schema["scope"].dataType).alias("scope"), F.lit(None).cast("int").alias("line"))
    used = uses(pieces).select(*FILE, "name", "at", F.lit(USED).alias("rank"), F.lit(0).alias("step"), F.lit(None).cast(opened.schema["scope"].dataType).alias("scope"), "line")
    events = deal(opened.unionByName(closed).unionByName(used), nodes.count(), *FILE, "name", each=1 << 17)
    w = W.partitionBy(*FILE, "name").orderBy("at", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = events.withColumn("depth", F.sum("step").over(w)).where("step >= 0")
    inner = W.partitionBy(*FILE, "name", "depth").orderBy("at", "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    bound = counted.withColumn("to", F.last("scope", ignorenulls=True).over(inner)).where("depth > 0")
    return bound.groupBy(*FILE, "name", "to.opens", "to.opens_at").agg(
        F.first("to.first.sort").alias("sort"), F.first("to.first.line").alias("line"), F.first("to.last_line").alias("last_line"), F.first("to.first.exported").alias("exported"), F.first("to.declared").alias("declared"),
        F.count_if(F.col("step") == 0).alias("references"), F.min("line").alias("first_use"), (F.max(F.when(F.col("step") == 1, F.col("depth"))) > 1).alias("shadows"),
    ).select(*FILE, "name", "sort", "line", "last_line", "exported", (F.col("opens") == BEFORE_ALL).alias("top"), "declared", "references", "first_use", "shadows")


#: rule, severity, condition on a binding, column of the line (fixed values).
RULES = [
    ("VAR-001", "error", "top AND sort IN ('const', 'let') AND first_use < line", "first_use"),
    ("VAR-005", "warning", "top AND sort IN ('const', 'let', 'var') AND references <= 1 AND NOT startswith(name, '_')", "line"),
    ("VAR-006", "warning", "sort = 'parameter of function' AND references <= 1 AND NOT startswith(name, '_')", "line"),
    ("VAR-007", "warning", "sort = 'import' AND references <= 1 AND NOT startswith(name, '_')", "line"),
    ("VAR-008", "info", "top AND sort = 'let' AND references <= 2", "line"),
    ("VAR-010", "error", "top AND sort IN ('const', 'let', 'var') AND declared > 1", "last_line"),
    ("VAR-012", "info", "top AND sort IN ('const', 'let', 'var', 'function') AND NOT exported AND references <= 1 AND NOT startswith(name, '_')", "line"),
]


def scan_scopes(bound: DataFrame) -> DataFrame:
    """(repo, path, line, rule_id, severity, name): rules about names and their uses."""
    hits = [F.when(F.expr(where), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(line).alias("line"))) for rule, severity, where, line in RULES]
    return bound.select(*FILE, "name", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull()))).select(*FILE, "line", "rule_id", "severity", "name")
