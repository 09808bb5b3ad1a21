"""Dependency graphs and iterative operators. Frontiers are written to the shared folder each round, so lineage stays short."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lintlake.functions import normalize_path
from lintlake.operators.scratch import deal, settle, shared_path


def module_coupling(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every module."""
    out = edges.groupBy(F.col("src").alias("module")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("module")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = out.join(into, "module", "full").fillna(0, ["out_degree", "in_degree"])
    return both.withColumn("coupling", F.col("in_degree") + F.col("out_degree"))


def _links(steps: DataFrame, rows: int, key: str) -> DataFrame:
    """steps held by key on the executors, in order, so that a round's join moves and sorts its frontier only; rows: how many there are."""
    return deal(steps, rows, key, each=1 << 18).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


def _trim(live: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """live (src, dst) without edges from modules that nothing leads to and to modules that lead nowhere, which are on no cycle, and how many are left.

    Repeated while it takes an eighth of the edges; what is left after that is left to the colours.
    """
    while rows:
        counted, path = Observation(), shared_path(live.sparkSession)
        ends = [live.select(F.col(c)).distinct().hint("merge") for c in ("dst", "src")]
        kept = live.join(ends[0].withColumnRenamed("dst", "src"), "src", "left_semi").join(ends[1].withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
        kept.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
        live, before, rows = live.sparkSession.read.schema(live.schema).parquet(path), rows, counted.get["n"]
        if rows * 8 > before * 7:
            break
    return live, rows


def _colours(live: DataFrame, rows: int, rounds: int) -> DataFrame:
    """(module, above, below): the largest module that reaches each one and the largest that it reaches, itself included."""
    spark = live.sparkSession
    both = live.select(F.col("src").alias("module"), F.col("dst").alias("next"), F.lit(True).alias("down")).union(live.select(F.col("dst").alias("module"), F.col("src").alias("next"), F.lit(False).alias("down")))
    links = _links(both, 2 * rows, "module")
    try:
        labels = settle(links.select("module").distinct().select("module", F.col("module").alias("above"), F.col("module").alias("below"), F.lit(True).alias("above_new"), F.lit(True).alias("below_new")))
        none = F.lit(None).cast(live.schema["src"].dataType)
        for _ in range(rounds):
            # a colour goes on only to a module that is smaller than it: others have one of their own that is larger
            sent = labels.where("above_new OR below_new").join(links.hint("merge"), "module").where("next < IF(down, above, below) AND IF(down, above_new, below_new)")
            handed = sent.select(F.col("next").alias("module"), F.when(F.col("down"), F.col("above")).alias("above"), F.when(~F.col("down"), F.col("below")).alias("below"), none.alias("old_above"), none.alias("old_below"))
            known = labels.select("module", "above", "below", F.col("above").alias("old_above"), F.col("below").alias("old_below"))
            met = known.union(handed).groupBy("module").agg(*[F.max(c).alias(c) for c in ("above", "below", "old_above", "old_below")])
            fresh = met.select("module", "above", "below", (F.col("above") > F.col("old_above")).alias("above_new"), (F.col("below") > F.col("old_below")).alias("below_new"))
            counted, path = Observation(), shared_path(spark)
            fresh.observe(counted, F.count_if(F.col("above_new") | F.col("below_new")).alias("n")).write.parquet(path)
            labels = spark.read.schema(fresh.schema).parquet(path)
            if not counted.get["n"]:
                return labels.select("module", "above", "below")
    finally:
        links.unpersist()
    raise RuntimeError("deeper than the rounds allowed")


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(module, component): modules that import each other, directly or not, with the largest of them as name; single modules are left out.

    Every module takes the largest one that reaches it and the largest one that it reaches as its two colours; both spread in the same
    rounds, and only what changed is handed on. Modules of one component have both in common, so edges between others go. Where both
    colours are one module, that module reaches the others and they reach it, so the component is whole; the rest is coloured again
    until no edge is left. The largest module always ends its component, so every round takes some.
    """
    live = settle(edges.where("src <> dst").select("src", "dst").distinct())
    left, found = live.count(), []
    for _ in range(rounds):
        live, left = _trim(live, left)
        if not left:
            break
        colours = _colours(live, left, rounds)
        ends = [colours.select(F.col("module").alias(c), F.struct("above", "below").alias(f"{c}_colours")).hint("merge") for c in ("src", "dst")]
        kept = settle(live.join(ends[0], "src").join(ends[1], "dst").where("src_colours = dst_colours").select("src", "dst", "src_colours.above", "src_colours.below"))
        found.append(settle(kept.where("above = below").select(F.col("src").alias("module"), F.col("above").alias("component")).distinct()))
        live = kept.where("above <> below").select("src", "dst")
        left = live.count()
    else:
        raise RuntimeError("deeper than the rounds allowed")
    none = live.select(F.col("src").alias("module"), F.col("src").alias("component")).limit(0)
    return reduce(DataFrame.union, found, none)


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """Node sets of the elementary cycles of up to `most` nodes, each once, as a sorted list.

    Only edges inside a strong component can be on a cycle; paths grow from their smallest node only.
    """
    named = strong_components(edges)
    ends = [named.select(F.col("module").alias(c), F.col("component").alias(f"{c}_component")).hint("merge") for c in ("src", "dst")]
    inside = edges.where("src <> dst").select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst")
    live = settle(inside.where("src_component = dst_component").select("src", "dst"))
    loops = edges.where("src = dst").select(F.array("src").alias("nodes"))
    paths = live.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    for k in range(2, most + 1):
        step = paths.join(live.select(F.col("src").alias("end"), F.col("dst").alias("next")).hint("merge"), "end")
        loops = loops.unionByName(step.where("next = start").select(F.array_sort("path").alias("nodes")))
        if k < most:
            paths = settle(step.where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path")))
    return loops.distinct()


def circular_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """CFG-007: (repo, path, component, size) of files whose resolved imports lead back to them, by any number of steps."""
    resolved = resolve_imports(imports, files)
    edges = resolved.select(F.concat_ws("\n", "repo", "path").alias("src"), F.concat_ws("\n", "repo", "target").alias("dst"))
    alone = edges.where("src = dst").select(F.col("src").alias("module"), F.col("src").alias("component")).distinct()
    named = settle(strong_components(edges))
    every = named.unionByName(alone.join(named, "module", "left_anti"))
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return every.join(sizes, "component").select(F.substring_index("module", "\n", 1).alias("repo"), F.substring_index("module", "\n", -1).alias("path"), F.substring_index("component", "\n", -1).alias("component"), "size")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that nothing imports."""
    return nodes.join(edges.select(F.col("dst").alias("module")).distinct(), "module", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(module, distance, route): everything that depends on a seed, directly or not, and the way down to the nearest. edges: src imports dst; seeds: module.

    Of several shortest ways the one over the smallest module at each step is taken.
    """
    back = settle(edges.select(F.col("dst").alias("module"), F.col("src").alias("next")).distinct())
    found = _spread(back, seeds.select("module").distinct(), rounds)
    return _routes(found).select("module", "distance", "route")


def _spread(steps: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """start, and what a walk along steps (module, next) reaches from each of its rows, with the distance and the module it came by (via, the smallest).

    A round writes what it adds to a folder of its own and counts it while it writes; nothing that is known is written again.
    """
    spark, path, keys = start.sparkSession, shared_path(start.sparkSession), start.columns
    first = start.withColumn("via", F.lit(None).cast(start.schema["module"].dataType))
    first.write.parquet(f"{path}/distance=0")
    others = [k for k in keys if k != "module"]
    read = lambda *k: spark.read.schema(first.schema).parquet(*[f"{path}/distance={i}" for i in k])
    for distance in range(1, rounds + 2):
        frontier, seen = read(distance - 1), read(*range(distance))
        fresh = frontier.join(steps, "module").groupBy(*others, F.col("next").alias("module")).agg(F.min("module").alias("via"))
        counted = Observation()
        fresh.join(seen, keys, "left_anti").select(*first.columns).observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/distance={distance}")
        if not counted.get["n"]:
            return spark.read.schema(first.withColumn("distance", F.lit(0)).schema).parquet(path).select(*keys, "via", "distance")
    raise RuntimeError("deeper than the rounds allowed")


def _routes(found: DataFrame) -> DataFrame:
    """found of _spread() with route: the modules from each row's own down to where its walk began.

    Pointers double: a row knows the next 2^k modules of its way, and takes on what the last of them knows.
    """
    keys = [c for c in found.columns if c not in ("via", "distance")]
    ways = settle(found.select("*", F.when(F.col("via").isNull(), F.array("module")).otherwise(F.array("module", "via")).alias("route"), F.col("via").alias("end")))
    longest = found.agg(F.max("distance")).first()[0] or 0
    known = 1
    while known < longest:
        others = [F.col(k).alias("end") if k == "module" else F.col(k) for k in keys]
        ahead = ways.select(*others, F.col("route").alias("rest"), F.col("end").alias("further"))
        met = ways.join(ahead, [*[k for k in keys if k != "module"], "end"], "left")
        grown = F.when(F.col("rest").isNull(), F.col("route")).otherwise(F.concat("route", F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))))
        ways = settle(met.select(*keys, "via", "distance", grown.alias("route"), F.col("further").alias("end")))
        known *= 2
    return ways.drop("via", "end")


def waves(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(task, wave): wave 0 waits for nothing, each other task for its latest dependency; tasks of a deadlock have a null wave.

    A task counts the dependencies that it has met until it has met all it needs. A wave is written once, to a folder of its own, with
    the tasks that are ready in it and the counts of those that still wait for another one; no other task is looked at.
    """
    spark, path = edges.sparkSession, shared_path(edges.sparkSession)
    pairs = settle(edges.select("task", "depends_on").distinct())
    tasks = settle(pairs.select("task").union(pairs.select(F.col("depends_on").alias("task"))).distinct())
    degree = settle(pairs.groupBy("task").agg(F.count(F.lit(1)).alias("needed")))
    needs = _links(pairs.join(degree.hint("merge"), "task"), pairs.count(), "depends_on")
    zero = F.lit(0).cast("long")
    ready = tasks.join(degree.hint("merge"), "task", "left_anti").select("task", zero.alias("needed"), zero.alias("met"))
    read = lambda k: spark.read.schema(ready.schema).parquet(f"{path}/wave={k}")
    try:
        for wave in range(rounds + 1):
            if wave == 0:
                now = ready
            else:
                done = read(wave - 1).where("met = needed").select(F.col("task").alias("depends_on"))
                hits = done.join(needs.hint("merge"), "depends_on").select("task", "needed", F.lit(1).cast("long").alias("met"))
                now = read(wave - 1).where("met < needed").union(hits).groupBy("task").agg(F.max("needed").alias("needed"), F.sum("met").alias("met"))
            counted = Observation()
            now.observe(counted, F.count_if(F.col("met") == F.col("needed")).alias("n")).write.parquet(f"{path}/wave={wave}")
            if not counted.get["n"]:  # what is left waits for itself
                found = spark.read.schema(ready.withColumn("wave", F.lit(0)).schema).parquet(path).where("met = needed").select("task", "wave")
                return found.unionByName(tasks.join(found.hint("merge"), "task", "left_anti").withColumn("wave", F.lit(None).cast("int")))
    finally:
        needs.unpersist()
    raise RuntimeError("deeper than the rounds allowed")


def transitive_exposure(edges: DataFrame, licenses: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """(root, package, distance, license, path) of packages with a copyleft licence below each root. edges: src needs dst; path leads from the root to the package.

    The walk goes up from the copyleft packages, which are few, and not down from every root.
    """
    up = settle(edges.select(F.col("dst").alias("module"), F.col("src").alias("next")).distinct())
    targets = licenses.where("copyleft").select("package").distinct().withColumn("module", F.col("package"))
    found = _routes(_spread(up, targets, rounds)).withColumnRenamed("module", "root")
    named = licenses.where("copyleft").select("package", "license")
    return found.join(roots.select(F.col("module").alias("root")).distinct(), "root", "left_semi").join(named, "package").select("root", "package", "distance", "license", F.col("route").alias("path"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """File of each local specifier: the first of six candidate names that exists. imports: repo, path, specifier."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    base = normalize_path(F.concat(folder, F.col("specifier")))
    names = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.js"]
    tried = imports.where(F.col("specifier").startswith(".")).withColumn("base", base)
    each = tried.select("repo", "path", "specifier", F.posexplode(F.array(*[F.concat("base", F.lit(n)) for n in names])).alias("place", "target"))
    found = each.join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"])
    return found.groupBy("repo", "path", "specifier").agg(F.min_by("target", "place").alias("target"))
