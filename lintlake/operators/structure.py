"""Structure of files from their spans and names: coupling, cohesion, long functions, nesting and a grade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import grade, js_round
from lintlake.operators import scopes
from lintlake.operators.syntax import FILE, spans

#: A function is long over so many lines; what a function too long and a level of nesting cost (fixed values).
LONG, LONG_COSTS, LEVEL_COSTS, IMPORT_COSTS = 40, 15, 10, 20
CUTS = [(85, "A"), (70, "B"), (55, "C"), (40, "D")]
SPECIFIER = r"^\s*import\b[^'\"]*['\"]([^'\"]+)['\"]"


def structure_grade(lexed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, path, functions, external, nesting, long_functions, coupling, cohesion, composite, grade) of each file.

    coupling is 100 less 20 for each import from outside per function; cohesion the share of declared names (imports aside) that the
    file uses beyond their declarations; composite weighs coupling and cohesion 0.3 each, long functions (10 at most) and nesting 0.2 each.
    """
    files = lexed.select(*FILE, F.regexp_extract("text", SPECIFIER, 1).alias("from")).groupBy(*FILE).agg(F.count_if((F.col("from") != "") & ~F.col("from").startswith(".")).alias("external"), F.count_if(F.col("from") != "").alias("imports"))
    found = spans(nodes, counts=False)
    length = F.when(F.col("kind").isin("function", "method", "arrow") & F.col("end").isNotNull(), F.col("end") - F.col("start") + 1)
    depth = F.when(F.col("kind").isin("if", "loop", "switch", "try"), F.col("at_nested") + 1)
    shape = found.groupBy(*FILE).agg(F.count(length).alias("functions"), F.count_if(length > LONG).alias("long_functions"), F.max(depth).alias("nesting"))
    pieces = scopes.placed(nodes)
    declared = scopes.declarations(pieces, found).where("sort <> 'import'").groupBy(*FILE, "name").agg(F.count(F.lit(1)).alias("declared"))
    used = scopes.uses(pieces).groupBy(*FILE, "name").agg(F.count(F.lit(1)).alias("used"))
    names = declared.join(used.hint("merge"), [*FILE, "name"], "left").groupBy(*FILE).agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("used") > F.col("declared")).alias("shared"))
    met = files.join(shape.hint("merge"), FILE, "left").join(names.hint("merge"), FILE, "left").fillna(0, ["functions", "long_functions", "nesting", "names", "shared"])
    coupling = F.greatest(F.lit(0), F.least(F.lit(100), js_round(100 - IMPORT_COSTS * F.col("external") / F.greatest("functions", F.lit(1)))))
    cohesion = F.when(F.col("names") > 0, js_round(100 * F.col("shared") / F.col("names"))).otherwise(100)
    scored = met.withColumn("coupling", coupling.cast("long")).withColumn("cohesion", cohesion.cast("long"))
    composite = F.col("coupling") * 3 + F.col("cohesion") * 3 + F.greatest(F.lit(0), 100 - LONG_COSTS * F.least("long_functions", F.lit(10))) * 2 + F.greatest(F.lit(0), 100 - LEVEL_COSTS * F.col("nesting")) * 2
    graded = scored.withColumn("composite", composite.cast("long") / 10)
    return graded.select(*FILE, "functions", "external", F.col("nesting").cast("long").alias("nesting"), "long_functions", "coupling", "cohesion", "composite", grade(F.col("composite"), CUTS, "F").alias("grade"))
