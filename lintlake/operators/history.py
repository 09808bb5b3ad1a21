"""Repository history and run logs: commits, changes, verification runs, provider calls, samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lintlake.functions import js_round
from lintlake.operators.scratch import settle


def since(df: DataFrame, day: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last days before as_of."""
    return df.where(F.col(day) > F.date_sub(F.lit(as_of).cast("date"), days))


def churn(changes: DataFrame, commits: DataFrame) -> DataFrame:
    j = changes.join(commits, "commit_id")
    return j.groupBy("file").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count(F.lit(1)).alias("commits")).withColumn("churn", F.col("added") + F.col("deleted"))


def churn_summary(changes: DataFrame, commits: DataFrame, high: int = 200) -> DataFrame:
    per_file = churn(changes, commits)
    n = commits.agg(F.count(F.lit(1)).alias("commits"))
    total = per_file.agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_if(F.col("churn") > high).alias("high_churn_files"))
    both = total.join(n)  # one row each
    return both.select("added", "deleted", "high_churn_files", (js_round(F.col("deleted") * 100 / F.col("added")) / 100).alias("churn_ratio"), js_round((F.col("added") + F.col("deleted")) / F.col("commits")).alias("churn_per_commit"))


def hotspots(changes: DataFrame, commits: DataFrame, k: int = 10) -> DataFrame:
    n = changes.join(commits, "commit_id").groupBy("file").agg(F.count(F.lit(1)).alias("commits"))
    return n.orderBy(F.col("commits").desc(), "file").limit(k)


def hot_files(changes: DataFrame, commits: DataFrame, k: int = 15) -> DataFrame:
    n = changes.join(commits, "commit_id").groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"), F.max("day").alias("last_changed"))
    return n.withColumn("churn_score", F.col("commits") * F.when(F.col("authors") > 1, 1.5).otherwise(1.0)).orderBy(F.col("churn_score").desc(), "file").limit(k)


def bug_prone(changes: DataFrame, commits: DataFrame, k: int = 10) -> DataFrame:
    fix = F.col("message").rlike("(?i)fix|bug|hotfix|patch")
    n = changes.join(commits, "commit_id").groupBy("file").agg(F.count_if(fix).alias("fixes"), F.count(F.lit(1)).alias("commits")).where("fixes > 0")
    ratio = n.withColumn("bug_ratio", js_round(F.col("fixes") * 100 / F.col("commits")))
    return ratio.withColumn("risk", F.least(F.lit(100), F.col("fixes") * 10 + F.col("bug_ratio"))).orderBy(F.col("fixes").desc(), "file").limit(k)


def contributors(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Per author: commits, lines, files and active days. Each side is summed before they meet."""
    by_commit = commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("day").alias("active_days"), F.min("day").alias("first_commit"), F.max("day").alias("last_commit"))
    by_change = changes.join(commits.select("commit_id", "author"), "commit_id").groupBy("author").agg(F.sum("added").alias("additions"), F.sum("deleted").alias("deletions"), F.countDistinct("file").alias("files"))
    return by_commit.join(by_change, "author", "left").fillna(0, ["additions", "deletions", "files"])


def commit_frequency(commits: DataFrame) -> DataFrame:
    return commits.groupBy("day").agg(F.count(F.lit(1)).alias("commits"))


def weekday_extremes(commits: DataFrame, days: int) -> DataFrame:
    n = commits.groupBy(F.dayofweek("day").alias("dow")).agg(F.count(F.lit(1)).alias("n"))
    key = F.struct("n", -F.col("dow"))
    return n.agg(F.max_by("dow", key).alias("busiest"), F.min_by("dow", F.struct("n", "dow")).alias("quietest"), F.sum("n").alias("commits"), (js_round(F.sum("n") / (days / 7.0) * 10) / 10).alias("weekly_mean"))


def top_authors(changes: DataFrame, commits: DataFrame, n: int = 3) -> DataFrame:
    c = changes.join(commits, "commit_id").groupBy("file", "author").agg(F.count(F.lit(1)).alias("commits"))
    w = W.partitionBy("file").orderBy(F.col("commits").desc(), "author")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ownership(changes: DataFrame, commits: DataFrame, as_of: str) -> DataFrame:
    """Share of each author in a file's added lines, by age."""
    age = F.datediff(F.lit(as_of).cast("date"), "day")
    c = changes.join(commits, "commit_id").groupBy("file", "author").agg(F.sum("added").alias("lines"), F.sum(F.when(age <= 365, F.col("added")).otherwise(0)).alias("recent"), F.sum(F.when(age > 1095, F.col("added")).otherwise(0)).alias("old"))
    return c.withColumn("share", js_round(F.col("lines") * 1000 / F.sum("lines").over(W.partitionBy("file"))) / 1000)


# ---------------------------------------------------------------- verification runs (newest first)


def newest() -> W:
    return W.partitionBy("repo").orderBy(F.col("ts").desc(), F.col("run_id").desc())


def run_report(runs: DataFrame) -> DataFrame:
    n = runs.groupBy("repo").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "pass").alias("passed"), F.sum("fixes").alias("fixes"), js_round(F.avg("score")).alias("mean_score"))
    return n.withColumn("pass_rate", js_round(F.col("passed") * 100 / F.col("runs")))


def weakest_team(runs: DataFrame) -> DataFrame:
    t = runs.groupBy("repo", "team").agg(js_round(F.avg("score")).alias("mean_score"))
    return t.groupBy("repo").agg(F.min_by("team", F.struct("mean_score", "team")).alias("team"), F.min("mean_score").alias("mean_score"))


def rolling_scores(runs: DataFrame, n: int = 3) -> DataFrame:
    """Mean of each run and the n - 1 before it, and the change to the window before; full windows only."""
    frame = newest().rowsBetween(0, n - 1)
    out = runs.withColumn("k", F.count(F.lit(1)).over(frame)).withColumn("rolling", js_round(F.avg("score").over(frame))).where(F.col("k") == n)
    return out.select("repo", "run_id", "rolling", (F.col("rolling") - F.lead("rolling").over(newest())).alias("change"))


def half_trend(runs: DataFrame) -> DataFrame:
    """Mean scores and pass rates of the newer and the older half."""
    w = W.partitionBy("repo")
    marked = runs.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(newest())).withColumn("recent", F.col("place") <= F.floor(F.col("n") / 2)).where("n >= 2")
    mean = lambda half: js_round(F.avg(F.when(F.col("recent") == half, F.col("score"))))
    rate = lambda half: js_round(F.avg(F.when(F.col("recent") == half, (F.col("status") == "pass").cast("double"))) * 100)
    out = marked.groupBy("repo").agg(mean(True).alias("recent"), mean(False).alias("older"), rate(True).alias("recent_pass"), rate(False).alias("older_pass"))
    return out.withColumn("difference", F.col("recent") - F.col("older"))


def pass_streak(runs: DataFrame) -> DataFrame:
    """Passes since the last run that did not pass."""
    p = runs.withColumn("place", F.row_number().over(newest()))
    return p.groupBy("repo").agg((F.coalesce(F.min(F.when(F.col("status") != "pass", F.col("place"))), F.count(F.lit(1)) + 1) - 1).alias("streak"))


def improvement(runs: DataFrame) -> DataFrame:
    n = runs.groupBy("repo").agg(F.min_by("score", F.struct("ts", "run_id")).alias("first"), F.max_by("score", F.struct("ts", "run_id")).alias("last"))
    return n.withColumn("improved", F.col("last") - F.col("first") >= 20)


def badges(runs: DataFrame) -> DataFrame:
    """Badges that each repo's runs satisfy."""
    facts = run_report(runs).join(pass_streak(runs), "repo").join(improvement(runs), "repo").join(runs.groupBy("repo").agg(F.max("score").alias("best")), "repo")
    tests = {
        "first-blood": F.col("runs") >= 1,
        "improver": F.col("improved") & (F.col("runs") >= 2),
        "streak-5": F.col("streak") >= 5,
        "streak-10": F.col("streak") >= 10,
        "centurion": F.col("runs") >= 100,
        "perfect": F.col("best") >= 95,
        "marathon": F.col("runs") >= 50,
        "iron-wall": (F.col("passed") / F.col("runs") >= 0.95) & (F.col("runs") >= 10),
    }
    each = F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()])
    return facts.select("repo", F.explode(F.filter(each, lambda b: b.isNotNull())).alias("badge"))


def append_snapshot(history: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """Both, of which the newest of each repo stay."""
    both = history.unionByName(new)
    return both.withColumn("__n", F.row_number().over(newest())).where(F.col("__n") <= keep).drop("__n")


def chain_hashes(runs: DataFrame, key: str) -> DataFrame:
    """Each run with a keyed hash of its content and of its predecessor's content."""
    content = F.concat_ws("|", "run_id", "repo", "score", "status")
    order = W.partitionBy("repo").orderBy("ts", "run_id")
    before = F.coalesce(F.lag(content).over(order), F.lit("root"))
    return runs.withColumn("hash", F.sha2(F.concat(F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), before, content), 256)), 256))


def verify_chain(runs: DataFrame, key: str) -> DataFrame:
    """Runs whose stored hash is not what their content and predecessor give."""
    return chain_hashes(runs.withColumnRenamed("hash", "stored"), key).where("stored <> hash").select("repo", "run_id")


def stop_reason(rounds: DataFrame, passing: int = 95, most: int = 12, least_gain: int = 5, budget: float = 60.0) -> DataFrame:
    """First round of each repo that ends a loop, and why. rounds: repo, round, score, fixes, cost."""
    w = W.partitionBy("repo").orderBy("round")
    r = rounds.withColumn("before", F.lag("score").over(w)).withColumn("spent", F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0)))
    why = (
        F.when(F.col("score") >= passing, "passed")
        .when(F.col("round") >= most, "max-iterations")
        .when((F.col("round") > 1) & (F.col("score") - F.col("before") < least_gain), "no-progress")
        .when((F.col("fixes") == 0) & (F.col("round") > 1), "no-fixes")
        .when(F.col("spent") >= budget, "budget-exceeded")
    )
    return r.withColumn("reason", why).where("reason IS NOT NULL").groupBy("repo").agg(F.min_by("reason", "round").alias("reason"), F.min("round").alias("round"))


# ---------------------------------------------------------------- provider calls, ordered folds

#: USD for a thousand tokens by provider (fixed values of the fixture).
PRICES = {0: 0.015, 1: 0.003, 2: 0.0008, 3: 0.01}
DEFAULT_PRICE = 0.001


def priced(calls: DataFrame, prices: dict[int, float] | None = None) -> DataFrame:
    price = F.create_map(*[F.lit(x) for kv in (PRICES if prices is None else prices).items() for x in kv])
    return calls.withColumn("micro_usd", js_round(F.col("tokens") * F.coalesce(price[F.col("provider")], F.lit(DEFAULT_PRICE)) * 1000))


def cost_report(calls: DataFrame) -> DataFrame:
    """Spending by day and provider, by day, and in all."""
    return priced(calls).withColumn("day", F.to_date("ts")).rollup("day", "provider").agg(F.sum("micro_usd").alias("micro_usd"), F.count(F.lit(1)).alias("calls"))


def ordered_sum(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, total, known, n): value summed as doubles one by one in the given order, so the last digits do not depend on how rows lie in tasks; rows with a value, all rows."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = df.select(*keys, F.sum(value).over(upto).alias("total"), F.col(value), F.row_number().over(w).alias("place"))
    return running.groupBy(*keys).agg(F.max_by("total", "place").alias("total"), F.count(value).alias("known"), F.count(F.lit(1)).alias("n"))


def clamped_sum(df: DataFrame, key: str, ts: str, order: list[str], delta: Column, start: int, low: int, high: int, slice_rows: int = 10_000) -> DataFrame:
    """(key, value): start plus the ordered deltas, kept within low and high after each one.

    Such steps compose: any run of them is again "add d, then keep within l and h". The rows are range-partitioned and sorted by key and
    time, so a busy key spreads over tasks, and pass by in batches; every run of up to slice_rows rows of a key leaves one such step,
    and only these steps of a key meet.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, own, step, n, place, part = ["key", "part", "place", "d", "l", "h"], None, None, 0, 0, 0
        for batch in batches:
            done = []
            for k, part, change in zip(batch["key"], batch["part"].tolist(), batch["delta"].tolist(), strict=True):
                if step is not None and (k != own or n == slice_rows):
                    done.append((own, part, place, *step))
                    step, place = None, place + 1
                if step is None:
                    own, step, n = k, (0, low, high), 0
                d, least, most = step
                step, n = (d + change, max(low, min(high, least + change)), max(low, min(high, most + change))), n + 1
            yield pd.DataFrame(done, columns=columns)
        if step is not None:
            yield pd.DataFrame([(own, part, place, *step)], columns=columns)

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("ts"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], delta.cast("int").alias("delta"))
    by = ["key", "ts", *[f"o{i}" for i in range(len(order))]]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("key", F.spark_partition_id().alias("part"), "delta")
    steps = ordered.mapInPandas(fold, f"key {kind}, part int, place int, d long, l long, h long")
    first = F.struct(F.lit(0).cast("long").alias("d"), F.lit(low).cast("long").alias("l"), F.lit(high).cast("long").alias("h"))
    keep = lambda x, least, most: F.greatest(least, F.least(most, x))
    met = steps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "place", "d", "l", "h"))).alias("each"))
    whole = F.aggregate("each", first, lambda a, x: F.struct((a["d"] + x["d"]).alias("d"), keep(a["l"] + x["d"], x["l"], x["h"]).alias("l"), keep(a["h"] + x["d"], x["l"], x["h"]).alias("h")))
    return met.select(F.col("key").alias(key), whole.alias("s")).select(key, keep(F.lit(start) + F.col("s.d"), F.col("s.l"), F.col("s.h")).cast("int").alias("value"))


def rule_weights(outcomes: DataFrame) -> DataFrame:
    """Learned weight of each rule: +0.02 for a success, -0.05 for a failure, kept in hundredths within 10 and 200."""
    out = clamped_sum(outcomes, "rule_id", "ts", ["call_id"], F.when(F.col("success"), 2).otherwise(-5), 100, 10, 200)
    return out.select("rule_id", F.col("value").alias("weight_hundredths"), (F.col("value") < 50).alias("suppressed"))


def aggressiveness(runs: DataFrame) -> DataFrame:
    """(repo, aggressiveness_hundredths): from 50, up 5 after a run up to which over 70 % of the repo's runs passed, down 5 under 30 %, within 10 and 100."""
    order = W.partitionBy("repo").orderBy("ts", "run_id").rowsBetween(W.unboundedPreceding, 0)
    rate = F.avg((F.col("status") == "pass").cast("double")).over(order)
    rated = runs.select("repo", "ts", "run_id", rate.alias("rate"))
    delta = F.when(F.col("rate") > 0.7, 5).when(F.col("rate") < 0.3, -5).otherwise(0)
    return clamped_sum(rated, "repo", "ts", ["run_id"], delta, 50, 10, 100).select("repo", F.col("value").alias("aggressiveness_hundredths"))


def pattern_confidence(events: DataFrame) -> DataFrame:
    """Confidence of each pattern in hundredths: +5 reuse, +10 accept, -15 reject, within 0 and 100, from 50."""
    delta = F.when(F.col("event") == "reuse", 5).when(F.col("event") == "accept", 10).otherwise(-15)
    return clamped_sum(events, "pattern", "ts", ["call_id"], delta, 50, 0, 100).select("pattern", F.col("value").alias("confidence"))


def reliability(calls: DataFrame) -> DataFrame:
    """Each provider's score and circuit after all its calls, in hundredths: a weight of 0.3 on +5 or -15, within 0 and 10000;
    under 3000 the circuit opens, for 60 seconds; then one success closes it and adds 1000, a failure opens it again.

    The circuit's steps depend on the order of all of a provider's calls: they are sorted on disk within a partition and pass by in
    batches, of which only the last state is kept, so a log of any length fits. A provider is one task's work.
    """
    ordered = calls.select("provider", "ts", "call_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "success").repartition("provider").sortWithinPartitions("provider", "ts", "call_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, own, state = ["provider", "score", "circuit", "successes", "errors"], None, None
        for batch in batches:
            done = []
            for provider, at, success in zip(batch["provider"], batch["at"].tolist(), batch["success"].tolist(), strict=True):
                if state is None or provider != own:
                    if state is not None:
                        done.append((own, state[0] / 100, state[1], state[3], state[4]))
                    own, state = provider, (10000, "closed", 0, 0, 0)
                score, circuit, opened = circuit_step(*state[:3], at, success)
                state = (score, circuit, opened, state[3] + success, state[4] + (not success))
            yield pd.DataFrame(done, columns=columns)
        if state is not None:
            yield pd.DataFrame([(own, state[0] / 100, state[1], state[3], state[4])], columns=columns)

    kind = calls.schema["provider"].dataType.simpleString()
    return ordered.select("provider", "at", "success").mapInPandas(fold, f"provider {kind}, score double, circuit string, successes long, errors long")


def circuit_step(score: int, circuit: str, opened: float, now: float, success: bool) -> tuple[int, str, float]:
    """Score, circuit and the time it opened after one more call."""
    score = min(10000, max(0, score + (150 if success else -450)))
    if circuit == "closed" and score < 3000:
        circuit, opened = "open", now
    if circuit == "open" and now - opened > 60:
        if success:
            circuit, score = "closed", min(10000, score + 1000)
        else:
            opened = now
    return score, circuit, opened


# ---------------------------------------------------------------- samples


def histogram(samples: DataFrame, n: int = 10) -> DataFrame:
    """Equal-width buckets of each op; the last one is closed."""
    ends = samples.groupBy("op").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    width = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) / n
    return samples.join(ends, "op").withColumn("bucket", F.least(F.floor((F.col("ms") - F.col("low")) / width), F.lit(n - 1))).groupBy("op", "bucket").agg(F.count(F.lit(1)).alias("n"))


def latency_summary(samples: DataFrame) -> DataFrame:
    """Percentiles at 0-based place floor(n * q) of each op's ascending samples.

    Equal samples are counted first, the values dealt by range over all tasks, and each range gets its start from the counts of those
    before it: no op is ever in one task.
    """
    counted = settle(samples.groupBy("op", "ms").agg(F.count(F.lit(1)).alias("k")).repartitionByRange("op", "ms").withColumn("part", F.spark_partition_id()))
    sums = counted.groupBy("op", "part").agg(F.sum("k").alias("k"))  # a row for each op and range
    before = W.partitionBy("op").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("op", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(W.partitionBy("op")).alias("n"))
    upto = W.partitionBy("op", "part").orderBy("ms").rowsBetween(W.unboundedPreceding, 0)
    r = counted.withColumn("upto", F.sum("k").over(upto)).join(starts, ["op", "part"]).withColumn("last", F.col("base") + F.col("upto"))
    inside = lambda q: (F.floor(F.col("n") * q) >= F.col("last") - F.col("k")) & (F.floor(F.col("n") * q) < F.col("last"))
    at = lambda q: F.max(F.when(inside(q), F.col("ms")))
    return r.groupBy("op").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def longest_rise(samples: DataFrame, least: float = 0.05) -> DataFrame:
    """Most steps in a row that rise by more than `least`, of series that rise at all. samples: series, step, mb."""
    w = W.partitionBy("series").orderBy("step")
    up = samples.withColumn("up", F.coalesce(F.col("mb") > F.lag("mb").over(w) + least, F.lit(False)))
    islands = up.withColumn("island", F.sum((~F.col("up")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.where("up").groupBy("series", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("series").agg(F.max("n").alias("longest_rise"))


def growth_trend(samples: DataFrame) -> DataFrame:
    """Slope, growth and longest rise of each series, and its leak class. samples: series, step, mb."""
    runs = longest_rise(samples)
    s = samples.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("mb", "step").alias("slope"), (F.max_by("mb", "step") - F.min_by("mb", "step")).alias("growth")).join(runs, "series", "left")
    slope = js_round(F.col("slope") * 10000) / 10000
    return s.select(
        "series",
        slope.alias("slope"),
        (js_round(F.col("growth") * 100) / 100).alias("growth"),
        F.coalesce("longest_rise", F.lit(0)).alias("longest_rise"),
        (((slope > 0.01) & (F.coalesce("longest_rise", F.lit(0)) >= F.floor(F.col("n") * 0.4))) | (F.col("growth") > 50)).alias("leak_suspected"),
        F.when(slope <= 0, "none").when(slope < 0.01, "low").when(slope < 0.05, "medium").otherwise("high").alias("leak_class"),
    )


def compare_metrics(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics of two runs, where smaller is better."""
    j = current.withColumnRenamed("value", "now").join(baseline.withColumnRenamed("value", "was"), ["op", "metric"])
    return j.withColumn("state", F.when(F.col("now") < F.col("was"), "IMPROVED").when(F.col("now") > F.col("was"), "REGRESSED").otherwise("SAME"))


#: Days after which a branch is told of, is stale and is old; commits behind after which it has drifted off (fixed values).
TOLD, STALE, OLD, DRIFTED = 14, 30, 90, 50


def branch_ages(branches: DataFrame, as_of: str) -> DataFrame:
    """Branches that nobody has touched for over two weeks: repo, branch, age in days, last_day, author, distance ('+ahead/-behind'), severity.

    branches: repo, branch, last_day, author, merged, ahead, behind, is_default; the default branch is left out, a null flag is false, null
    distances are 0. A branch without a day has no age and is left out.
    """
    age = F.datediff(F.lit(as_of).cast("date"), "last_day").cast("long")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    aged = branches.where(~F.coalesce("is_default", F.lit(False))).withColumn("age", age).where(F.col("age") > TOLD)
    severity = F.when(F.col("age") > OLD, "error").when(F.col("age") > STALE, "warning").otherwise("info")
    return aged.select("repo", "branch", "age", "last_day", "author", F.concat(F.lit("+"), n("ahead"), F.lit("/-"), n("behind")).alias("distance"), severity.alias("severity"))


def branch_summary(branches: DataFrame, as_of: str) -> DataFrame:
    """Each repo's branches beside the default one: total, active, stale, merged, unmerged, drifted, and what to do about them.

    advice lists 'delete-merged' over 3 merged, 'review-stale' over 5 stale ones and 'rebase' where an unmerged one is over 50 commits behind. A
    branch without a day counts as active. A repo with a default branch only has zeros.
    """
    other = ~F.coalesce("is_default", F.lit(False))
    merged = F.coalesce("merged", F.lit(False))
    stale = F.coalesce(F.datediff(F.lit(as_of).cast("date"), "last_day") > STALE, F.lit(False))
    count = lambda test: F.count_if(other & test)
    n = branches.groupBy("repo").agg(
        F.count_if(other).alias("total"), count(~stale).alias("active"), count(stale).alias("stale"), count(merged).alias("merged"), count(~merged).alias("unmerged"),
        count(~merged & (F.coalesce("behind", F.lit(0)) > DRIFTED)).alias("drifted"),
    )
    advice = F.array_compact(F.array(F.when(F.col("merged") > 3, "delete-merged"), F.when(F.col("stale") > 5, "review-stale"), F.when(F.col("drifted") > 0, "rebase")))
    return n.withColumn("advice", advice)


def repo_health(commits: DataFrame, changes: DataFrame, branches: DataFrame, as_of: str, high: int = 200) -> DataFrame:
    """Each repo's commits, contributors, stale branches, days since the last commit, and a score from risky and restless files.

    The score is the mean of two: 100 less 15 for each file whose risk (`bug_prone`) is over 50, not below 0; and 100, 80 over 2 or 60 over 5
    files with more than `high` changed lines. commits: repo, commit_id, author, day, message; changes: repo, commit_id, file, added, deleted;
    branches as in `branch_summary`. Each side is summed before they meet; repos without commits are left out.
    """
    by_repo = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("contributors"), F.datediff(F.lit(as_of).cast("date"), F.max("day")).cast("long").alias("last_commit_age"))
    fix = F.coalesce(F.col("message").rlike("(?i)fix|bug|hotfix|patch"), F.lit(False))
    by_file = changes.join(commits.select("repo", "commit_id", fix.alias("fix")), ["repo", "commit_id"]).groupBy("repo", "file").agg(F.count_if("fix").alias("fixes"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).alias("churn"))
    risk = F.col("fixes") * 10 + js_round(F.col("fixes") * 100 / F.col("n"))
    files = by_file.groupBy("repo").agg(F.count_if(risk > 50).alias("risky_files"), F.count_if(F.col("churn") > high).alias("restless_files"))
    stale = branch_summary(branches, as_of).select("repo", F.col("stale").alias("stale_branches"))
    j = by_repo.join(files, "repo", "left").join(stale, "repo", "left").fillna(0, ["risky_files", "restless_files", "stale_branches"])
    calm = F.when(F.col("restless_files") > 5, 60).when(F.col("restless_files") > 2, 80).otherwise(100)
    return j.withColumn("score", js_round((F.greatest(F.lit(0), 100 - F.col("risky_files") * 15) + calm) / 2))
