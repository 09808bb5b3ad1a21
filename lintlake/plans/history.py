"""Operators on history, runs, calls and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import history as H
from lintlake.plans.base import query, values

JOINED = "changes JOIN commits USING (commit_id)"
NEW = "PARTITION BY repo ORDER BY ts DESC, run_id DESC"


def cc(s):
    return s.view("changes"), s.view("commits")


@query("a23_churn", "changes commits", f"SELECT file, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS commits, CAST(sum(added) + sum(deleted) AS BIGINT) AS churn FROM {JOINED} GROUP BY file")
def _(s):
    return H.churn(*cc(s))


@query("a23_churn_summary", "changes commits", f"WITH f AS (SELECT file, sum(added) AS a, sum(deleted) AS d FROM {JOINED} GROUP BY file) SELECT CAST(sum(a) AS BIGINT) AS added, CAST(sum(d) AS BIGINT) AS deleted, count(*) FILTER (WHERE a + d > 200) AS high_churn_files, floor(sum(d) * 100 / sum(a) + 0.5) / 100 AS churn_ratio, CAST(floor((sum(a) + sum(d)) / (SELECT count(*) FROM commits) + 0.5) AS BIGINT) AS churn_per_commit FROM f")
def _(s):
    return H.churn_summary(*cc(s))


@query("a24_hotspots", "changes commits", f"SELECT file, count(*) AS commits FROM {JOINED} GROUP BY file ORDER BY commits DESC, file LIMIT 10")
def _(s):
    return H.hotspots(*cc(s))


@query("a25_hot_files", "changes commits", f"SELECT file, count(*) AS commits, count(DISTINCT author) AS authors, max(day) AS last_changed, count(*) * CASE WHEN count(DISTINCT author) > 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS churn_score FROM {JOINED} GROUP BY file ORDER BY churn_score DESC, file LIMIT 15")
def _(s):
    return H.hot_files(*cc(s))


@query("a26_bug_prone", "changes commits", f"WITH n AS (SELECT file, count(*) FILTER (WHERE message LIKE 'fix%') AS fixes, count(*) AS commits FROM {JOINED} GROUP BY file HAVING fixes > 0), r AS (SELECT *, CAST(floor(fixes * 100 / commits + 0.5) AS BIGINT) AS bug_ratio FROM n) SELECT *, least(100, fixes * 10 + bug_ratio) AS risk FROM r ORDER BY fixes DESC, file LIMIT 10")
def _(s):
    return H.bug_prone(*cc(s))


@query("a27_contributors", "changes commits", f"WITH a AS (SELECT author, count(*) AS commits, count(DISTINCT day) AS active_days, min(day) AS first_commit, max(day) AS last_commit FROM commits GROUP BY author), b AS (SELECT author, CAST(sum(added) AS BIGINT) AS additions, CAST(sum(deleted) AS BIGINT) AS deletions, count(DISTINCT file) AS files FROM {JOINED} GROUP BY author) SELECT a.*, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce(files, 0) AS files FROM a LEFT JOIN b USING (author)")
def _(s):
    return H.contributors(*cc(s))


@query("a28_commit_frequency", "commits", "SELECT day, count(*) AS commits FROM commits WHERE day > DATE '2001-08-02' - INTERVAL 90 DAY GROUP BY day")
def _(s):
    return H.commit_frequency(H.since(s.view("commits"), "day", "2001-08-02", 90))


@query("a28_weekday_extremes", "commits", "WITH n AS (SELECT dayofweek(day) + 1 AS dow, count(*) AS n FROM commits GROUP BY 1) SELECT CAST((SELECT dow FROM n ORDER BY n DESC, dow LIMIT 1) AS INT) AS busiest, CAST((SELECT dow FROM n ORDER BY n, dow LIMIT 1) AS INT) AS quietest, CAST(sum(n) AS BIGINT) AS commits, floor(sum(n) / (2400 / 7.0::DOUBLE) * 10 + 0.5) / 10 AS weekly_mean FROM n")
def _(s):
    return H.weekday_extremes(s.view("commits"), 2400)


@query("w17_top_authors", "changes commits", f"WITH c AS (SELECT file, author, count(*) AS commits FROM {JOINED} GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY commits DESC, author) AS INT) AS place FROM c QUALIFY place <= 3")
def _(s):
    return H.top_authors(*cc(s))


@query("a29_ownership", "changes commits", f"WITH c AS (SELECT file, author, CAST(sum(added) AS BIGINT) AS lines, CAST(sum(CASE WHEN date_diff('day', day, DATE '2001-08-02') <= 365 THEN added ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN date_diff('day', day, DATE '2001-08-02') > 1095 THEN added ELSE 0 END) AS BIGINT) AS old FROM {JOINED} GROUP BY ALL) SELECT *, floor(lines * 1000 / sum(lines) OVER (PARTITION BY file) + 0.5) / 1000 AS share FROM c")
def _(s):
    return H.ownership(*cc(s), "2001-08-02")


@query("a32_run_report", "runs", "SELECT repo, count(*) AS runs, count(*) FILTER (WHERE status = 'pass') AS passed, CAST(sum(fixes) AS BIGINT) AS fixes, CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_score, CAST(floor(count(*) FILTER (WHERE status = 'pass') * 100 / count(*) + 0.5) AS BIGINT) AS pass_rate FROM runs GROUP BY repo")
def _(s):
    return H.run_report(s.view("runs"))


@query("a32_weakest_team", "runs", "WITH t AS (SELECT repo, team, CAST(floor(avg(score) + 0.5) AS BIGINT) AS mean_score FROM runs GROUP BY ALL) SELECT repo, team, mean_score FROM t QUALIFY row_number() OVER (PARTITION BY repo ORDER BY mean_score, team) = 1")
def _(s):
    return H.weakest_team(s.view("runs"))


@query("w06_rolling_scores", "runs", f"WITH r AS (SELECT *, count(*) OVER w AS k, CAST(floor(avg(score) OVER w + 0.5) AS BIGINT) AS rolling FROM runs WINDOW w AS ({NEW} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT repo, run_id, rolling, rolling - lead(rolling) OVER ({NEW}) AS change FROM r WHERE k = 3")
def _(s):
    return H.rolling_scores(s.view("runs"))


@query("w07_half_trend", "runs", f"WITH m AS (SELECT *, count(*) OVER (PARTITION BY repo) AS n, row_number() OVER ({NEW}) AS place FROM runs), h AS (SELECT *, place <= n // 2 AS newer FROM m WHERE n >= 2), o AS (SELECT repo, CAST(floor(avg(score) FILTER (WHERE newer) + 0.5) AS BIGINT) AS recent, CAST(floor(avg(score) FILTER (WHERE NOT newer) + 0.5) AS BIGINT) AS older, CAST(floor(avg(CASE WHEN status = 'pass' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE newer) * 100 + 0.5) AS BIGINT) AS recent_pass, CAST(floor(avg(CASE WHEN status = 'pass' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE NOT newer) * 100 + 0.5) AS BIGINT) AS older_pass FROM h GROUP BY repo) SELECT *, recent - older AS difference FROM o")
def _(s):
    return H.half_trend(s.view("runs"))


STREAK = f"(SELECT repo, coalesce(min(place) FILTER (WHERE status <> 'pass'), count(*) + 1) - 1 AS streak FROM (SELECT *, row_number() OVER ({NEW}) AS place FROM runs) GROUP BY repo)"


@query("w08_pass_streak", "runs", f"SELECT * FROM {STREAK}")
def _(s):
    return H.pass_streak(s.view("runs"))


IMPROVED = "(SELECT repo, arg_min(score, (ts, run_id)) AS first, arg_max(score, (ts, run_id)) AS last FROM runs GROUP BY repo)"


@query("w10_improvement", "runs", f"SELECT *, last - first >= 20 AS improved FROM {IMPROVED}")
def _(s):
    return H.improvement(s.view("runs"))


BADGES = f"""WITH f AS (SELECT r.repo, count(*) AS runs, count(*) FILTER (WHERE status = 'pass') AS passed, max(score) AS best, max(streak) AS streak, max(last - first) AS gain FROM runs r JOIN {STREAK} k ON k.repo = r.repo JOIN {IMPROVED} i ON i.repo = r.repo GROUP BY r.repo)
    SELECT repo, unnest(list_filter([CASE WHEN runs >= 1 THEN 'first-blood' END, CASE WHEN gain >= 20 AND runs >= 2 THEN 'improver' END, CASE WHEN streak >= 5 THEN 'streak-5' END, CASE WHEN streak >= 10 THEN 'streak-10' END, CASE WHEN runs >= 100 THEN 'centurion' END,
      CASE WHEN best >= 95 THEN 'perfect' END, CASE WHEN runs >= 50 THEN 'marathon' END, CASE WHEN passed / runs >= 0.95 AND runs >= 10 THEN 'iron-wall' END], lambda b: b IS NOT NULL)) AS badge FROM f"""


@query("a48_badges", "runs", BADGES)
def _(s):
    return H.badges(s.view("runs"))


@query("u04_newly_earned", "runs", BADGES + " WHERE true EXCEPT SELECT repo, 'first-blood' FROM runs WHERE repo % 2 = 0")
def _(s):
    earned = s.view("runs").where("repo % 2 = 0").select("repo", F.lit("first-blood").alias("badge"))
    return H.badges(s.view("runs")).join(earned, ["repo", "badge"], "left_anti")


@query("s17_append_snapshot", "runs", f"SELECT repo, run_id, score FROM runs QUALIFY row_number() OVER ({NEW}) <= 50")
def _(s):
    r = s.view("runs").select("repo", "run_id", "ts", "score")
    return H.append_snapshot(r.where("run_id % 3 <> 0"), r.where("run_id % 3 = 0")).select("repo", "run_id", "score")


@query("s05_read_receipts", "runs", "SELECT repo, run_id, score FROM runs WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def _(s):
    return s.view("runs").where(F.col("ts") >= F.lit("2024-01-31").cast("timestamp") - F.expr("INTERVAL 7 DAYS")).select("repo", "run_id", "score")


@query("w15_verify_chain", "runs", "SELECT repo, run_id FROM runs WHERE run_id % 50 = 0")
def _(s):
    chained = H.chain_hashes(s.view("runs"), "key")
    tampered = chained.withColumn("hash", F.when(F.col("run_id") % 50 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    return H.verify_chain(tampered, "key")


ROUNDS = "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ts, run_id) AS round, score, fixes, CAST(run_id % 10 AS INT) AS cost FROM runs"


@query("w21_stop_reason", "runs", f"WITH r AS ({ROUNDS}), b AS (SELECT *, lag(score) OVER w AS before, sum(cost) OVER (PARTITION BY repo ORDER BY round ROWS UNBOUNDED PRECEDING) AS spent FROM r WINDOW w AS (PARTITION BY repo ORDER BY round)), y AS (SELECT *, CASE WHEN score >= 95 THEN 'passed' WHEN round >= 12 THEN 'max-iterations' WHEN round > 1 AND score - before < 5 THEN 'no-progress' WHEN fixes = 0 AND round > 1 THEN 'no-fixes' WHEN spent >= 60 THEN 'budget-exceeded' END AS reason FROM b) SELECT repo, reason, CAST(round AS INT) AS round FROM y WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY round) = 1")
def _(s):
    s.view("runs").createOrReplaceTempView("runs")
    return H.stop_reason(s.spark.sql(ROUNDS))


@query("a33_cost_report", "calls", "WITH p AS (SELECT *, CAST(ts AS DATE) AS day, CAST(floor(tokens * CASE provider WHEN 0 THEN 0.015::DOUBLE WHEN 1 THEN 0.003::DOUBLE WHEN 2 THEN 0.0008::DOUBLE ELSE 0.01::DOUBLE END * 1000 + 0.5) AS BIGINT) AS micro_usd FROM calls) SELECT day, provider, CAST(sum(micro_usd) AS BIGINT) AS micro_usd, count(*) AS calls FROM p GROUP BY ROLLUP (day, provider)")
def _(s):
    return H.cost_report(s.view("calls"))


@query("w18_rule_weights", "calls", "SELECT 'rule-' || task AS rule_id, list_reduce(list_prepend(100, list(CASE WHEN success AND provider <> 1 THEN 2 ELSE -5 END ORDER BY ts, call_id)), lambda a, x: greatest(10, least(200, a + x))) AS weight_hundredths, weight_hundredths < 50 AS suppressed FROM calls GROUP BY task")
def _(s):
    return H.rule_weights(s.view("calls").select(F.concat(F.lit("rule-"), "task").alias("rule_id"), "ts", "call_id", (F.col("success") & (F.col("provider") != 1)).alias("success")))


@query("w19_pattern_confidence", "calls", "SELECT CAST(call_id % 200 AS INT) AS pattern, list_reduce(list_prepend(50, list(CASE provider WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE -15 END ORDER BY ts, call_id)), lambda a, x: greatest(0, least(100, a + x))) AS confidence FROM calls GROUP BY 1")
def _(s):
    event = F.when(F.col("provider") == 0, "reuse").when(F.col("provider") == 1, "accept").otherwise("reject")
    return H.pattern_confidence(s.view("calls").select((F.col("call_id") % 200).cast("int").alias("pattern"), "ts", "call_id", event.alias("event")))


@query("w20_reliability", "calls", """WITH e AS (SELECT provider, ts, success, row_number() OVER (PARTITION BY provider ORDER BY ts, call_id) AS i, count(*) OVER (PARTITION BY provider) AS n FROM calls),
    r AS (SELECT provider, CAST(0 AS BIGINT) AS i, 10000 AS score, 'closed' AS circuit, CAST(0 AS BIGINT) AS opened FROM (SELECT DISTINCT provider FROM e)
          UNION ALL SELECT provider, i, CASE WHEN probe AND success THEN least(10000, moved + 1000) ELSE moved END,
                           CASE WHEN probe AND success THEN 'closed' WHEN circuit = 'open' OR opens THEN 'open' ELSE 'closed' END, CASE WHEN opens OR (probe AND NOT success) THEN now ELSE opened END
          FROM (SELECT *, circuit = 'closed' AND moved < 3000 AS opens, circuit = 'open' AND now - opened > 60 AS probe
                FROM (SELECT e.provider, e.i, CAST(floor(epoch(e.ts)) AS BIGINT) AS now, e.success, r.circuit, r.opened, greatest(0, least(10000, r.score + CASE WHEN e.success THEN 150 ELSE -450 END)) AS moved FROM r JOIN e ON e.provider = r.provider AND e.i = r.i + 1))),
    c AS (SELECT provider, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS errors, count(*) AS n FROM calls GROUP BY provider)
    SELECT r.provider, CAST(score / 100 AS DOUBLE) AS score, circuit, successes, errors FROM r JOIN c ON c.provider = r.provider AND c.n = r.i""")
def _(s):
    return H.reliability(s.view("calls"))


SAMPLES = "SELECT event_type AS op, value AS ms FROM events"


def samples(s):
    return s.table("events").select(F.col("event_type").alias("op"), F.col("value").alias("ms"))


@query("a37_histogram", "", f"WITH s AS ({SAMPLES}), e AS (SELECT op, min(ms) AS low, max(ms) AS high FROM s GROUP BY op) SELECT s.op, CAST(least(floor((ms - low) / (CASE WHEN high > low THEN high - low ELSE 1.0 END / 10)), 9) AS BIGINT) AS bucket, count(*) AS n FROM s JOIN e ON e.op = s.op GROUP BY ALL")
def _(s):
    return H.histogram(samples(s))


@query("a38_latency_summary", "", f"WITH s AS ({SAMPLES}), r AS (SELECT *, count(*) OVER (PARTITION BY op) AS n, row_number() OVER (PARTITION BY op ORDER BY ms) - 1 AS place FROM s) SELECT op, count(*) AS n, max(ms) FILTER (WHERE place = floor(n * 0.5)) AS p50, max(ms) FILTER (WHERE place = floor(n * 0.95)) AS p95, max(ms) FILTER (WHERE place = floor(n * 0.99)) AS p99 FROM r GROUP BY op")
def _(s):
    return H.latency_summary(samples(s))


SERIES = "SELECT CAST(user_id AS INT) AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS mb FROM events"


@query("a39_growth_trend", "", f"WITH s AS ({SERIES}), u AS (SELECT *, coalesce(mb > lag(mb) OVER (PARTITION BY series ORDER BY step) + 0.05, false) AS up FROM s), i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM u), l AS (SELECT series, max(n) AS longest FROM (SELECT series, island, count(*) AS n FROM i WHERE up GROUP BY ALL) GROUP BY series), g AS (SELECT series, count(*) AS n, floor(regr_slope(mb, step) * 10000 + 0.5) / 10000 AS slope, arg_max(mb, step) - arg_min(mb, step) AS grown FROM s GROUP BY series) SELECT g.series, slope, floor(grown * 100 + 0.5) / 100 AS growth, coalesce(longest, 0) AS longest_rise, (slope > 0.01 AND coalesce(longest, 0) >= floor(n * 0.4)) OR grown > 50 AS leak_suspected, CASE WHEN slope <= 0 THEN 'none' WHEN slope < 0.01 THEN 'low' WHEN slope < 0.05 THEN 'medium' ELSE 'high' END AS leak_class FROM g LEFT JOIN l ON l.series = g.series")
def _(s):
    s.view("events").createOrReplaceTempView("events")
    return H.growth_trend(s.spark.sql(SERIES))


@query("j28_compare_metrics", "", f"WITH s AS (SELECT event_id, event_type AS op, value FROM events), m AS (SELECT op, event_id % 2 AS half, min(value) AS low, max(value) AS high FROM s GROUP BY ALL), l AS (SELECT op, half, 'low' AS metric, low AS value FROM m UNION ALL SELECT op, half, 'high', high FROM m) SELECT a.op, a.metric, a.value AS now, b.value AS was, CASE WHEN a.value < b.value THEN 'IMPROVED' WHEN a.value > b.value THEN 'REGRESSED' ELSE 'SAME' END AS state FROM l a JOIN l b ON a.op = b.op AND a.metric = b.metric AND a.half = 1 AND b.half = 0")
def _(s):
    m = s.table("events").groupBy(F.col("event_type").alias("op"), (F.col("event_id") % 2).alias("half")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    long = m.unpivot(["op", "half"], ["low", "high"], "metric", "value")
    return H.compare_metrics(long.where("half = 1").drop("half"), long.where("half = 0").drop("half"))


@query("w11_longest_rise", "", f"WITH s AS ({SERIES}), u AS (SELECT *, coalesce(mb > lag(mb) OVER (PARTITION BY series ORDER BY step) + 0.05, false) AS up FROM s), i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM u), n AS (SELECT series, island, count(*) AS n FROM i WHERE up GROUP BY ALL) SELECT series, max(n) AS longest_rise FROM n GROUP BY series")
def _(s):
    s.view("events").createOrReplaceTempView("events")
    return H.longest_rise(s.spark.sql(SERIES))
