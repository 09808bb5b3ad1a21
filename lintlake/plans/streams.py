"""Streaming operators, run over the given tables as streams up to what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintlake.operators import history as H
from lintlake.operators import rules as R
from lintlake.operators.scratch import settle
from lintlake.plans.base import query
from lintlake.plans.scans import pack
from lintlake.streaming import operators as T


def events(s):
    return T.stream_of(s.spark, f"{s.sf_dir}/events.parquet")


def requests(s):
    return events(s).select(F.col("user_id").alias("client"), "ts", F.col("event_type").alias("route"), F.col("props").alias("body"), "event_id")


def runs(s):
    score = (F.floor(F.col("value") * 10).cast("int") % 101).cast("int")
    return events(s).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("repo"), F.col("event_type").alias("team"), "ts", score.alias("score"))


#: Windows whose end the last event, less the delay, has passed.
SEEN = "(SELECT max(ts) FROM events)"


@query("st01_stream_scan", "text_line", f"WITH {pack(R.IP_MARKERS, 'text_line')} SELECT repo, path, line, rule_id, severity FROM hit")
def _(s):
    docs = T.stream_of(s.spark, f"{s.sf_dir}/documents.parquet").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return T.run(T.stream_scan(docs), "append").select("repo", "path", "line", "rule_id", "severity")


SESSIONS = "g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL {gap} THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts) AS k FROM g)"


@query("st02_debounce", "", f"WITH {SESSIONS.format(gap='10 MINUTE', key='event_type')} SELECT event_type AS path, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS \"end\", arg_max(event_id, ts) AS version, count(*) AS changes FROM n GROUP BY event_type, k HAVING max(ts) + INTERVAL 10 MINUTE <= {SEEN} - INTERVAL 1 MINUTE")
def _(s):
    changes = events(s).select(F.col("event_type").alias("path"), "ts", F.col("event_id").alias("version"))
    return T.run(T.debounce(changes, "10 minutes"), "append")


@query("st03_rate_limit", "", f"SELECT user_id AS client, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, least(count(*), 2) AS allowed, greatest(0, 2 - count(*)) AS remaining FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {SEEN} - INTERVAL 1 MINUTE")
def _(s):
    return T.run(T.rate_limit(requests(s), 2, "1 hour"), "append")


@query("st03_rate_limit_exact", "", f"""WITH e AS (SELECT user_id AS client, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT client, i, event_id, ts, ts AS begun, 1 AS n FROM e WHERE i = 1
          UNION ALL SELECT e.client, e.i, e.event_id, e.ts, CASE WHEN e.ts >= begun + INTERVAL 6 HOUR THEN e.ts ELSE begun END, CASE WHEN e.ts >= begun + INTERVAL 6 HOUR THEN 1 ELSE n + 1 END FROM r JOIN e ON e.client = r.client AND e.i = r.i + 1)
    SELECT client, event_id, ts, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS INT) AS remaining FROM r WHERE ts <= {SEEN} - INTERVAL 1 MINUTE""")
def _(s):
    return T.run(T.rate_limit_exact(requests(s), 2, 6 * 3_600_000), "append")


@query("st04_client_sessions", "", f"WITH {SESSIONS.format(gap='3 HOUR', key='user_id')} SELECT user_id AS client, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS \"end\", count(*) AS requests FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 3 HOUR <= {SEEN} - INTERVAL 10 MINUTE")
def _(s):
    return T.run(T.client_sessions(requests(s), "3 hours"), "append")


@query("st05_dedupe_ttl", "", """WITH e AS (SELECT event_type AS route, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    k AS (SELECT route, i, event_id, ts, ts AS first FROM e WHERE i = 1 UNION ALL SELECT e.route, e.i, e.event_id, e.ts, CASE WHEN e.ts > first + INTERVAL 1 HOUR THEN e.ts ELSE first END FROM k JOIN e ON e.route = k.route AND e.i = k.i + 1)
    SELECT route, event_id, ts FROM k WHERE ts = first AND ts <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE""")
def _(s):
    """The first event of each kind, and the first after each hour that it opens."""
    return T.run(T.first_of_ttl(events(s).select(F.col("event_type").alias("route"), "ts", "event_id"), "route", 3_600_000), "append")


@query("st05_dedupe_whole", "", "SELECT count(DISTINCT (event_type, props)) AS n FROM events")
def _(s):
    kept = T.run(T.dedupe_ttl(requests(s), ["route", "body"], "60 days"), "append")
    return kept.agg(F.count(F.lit(1)).alias("n"))


@query("st06_reliability_stream", "", f"""WITH e AS (SELECT event_id % 300 AS provider, ts, event_id % 7 < 3 AS success, row_number() OVER (PARTITION BY event_id % 300 ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT e.*, count(*) OVER (PARTITION BY provider) AS calls FROM e),
    r AS (SELECT provider, CAST(0 AS BIGINT) AS i, 10000 AS score, 'closed' AS circuit, CAST('1970-01-01' AS TIMESTAMP) AS opened FROM (SELECT DISTINCT provider FROM e)
          UNION ALL SELECT provider, i, CASE WHEN probe AND success THEN least(10000, moved + 1000) ELSE moved END,
                           CASE WHEN probe AND success THEN 'closed' WHEN circuit = 'open' OR opens THEN 'open' ELSE 'closed' END, CASE WHEN opens OR (probe AND NOT success) THEN ts ELSE opened END
          FROM (SELECT *, circuit = 'closed' AND moved < 3000 AS opens, circuit = 'open' AND ts > opened + INTERVAL 60 SECOND AS probe
                FROM (SELECT f.provider, f.i, f.ts, f.success, r.circuit, r.opened, greatest(0, least(10000, r.score + CASE WHEN f.success THEN 150 ELSE -450 END)) AS moved FROM r JOIN f ON f.provider = r.provider AND f.i = r.i + 1)))
    SELECT r.provider, CAST(score / 100 AS DOUBLE) AS score, circuit, calls FROM r JOIN f ON f.provider = r.provider AND f.i = r.i AND f.i = f.calls""")
def _(s):
    calls = events(s).select((F.col("event_id") % 300).alias("provider"), "ts", F.col("event_id").alias("call_id"), (F.col("event_id") % 7 < 3).alias("success"))
    return T.run(T.reliability_stream(calls), "update", ["provider"])


@query("st07_sliding_scores", "runs", "WITH w AS (SELECT team, score, unnest(generate_series(CAST(CAST(ts AS DATE) - 6 AS TIMESTAMP), CAST(CAST(ts AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS start FROM runs) SELECT team, start, CAST(sum(score) AS BIGINT) AS total, count(*) AS runs FROM w GROUP BY ALL HAVING start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(s):
    return T.run(T.sliding_scores(runs(s)), "append")


@query("st08_spend_stream", "calls", f"WITH p AS (SELECT ts, CAST(floor(tokens * CASE provider WHEN 0 THEN 0.015::DOUBLE WHEN 1 THEN 0.003::DOUBLE WHEN 2 THEN 0.0008::DOUBLE ELSE 0.01::DOUBLE END * 1000 + 0.5) AS BIGINT) AS m FROM calls) SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(sum(m) AS BIGINT) AS micro_usd, count(*) AS calls, sum(m) > 40000 AS over_budget FROM p GROUP BY 1 HAVING start + INTERVAL 1 DAY <= {SEEN} - INTERVAL 1 HOUR")
def _(s):
    calls = events(s).select("ts", (F.col("user_id") % 4).cast("int").alias("provider"), F.floor("value").cast("long").alias("tokens"))
    return T.run(T.spend_stream(calls, 40000), "append")


@query("st09_batch_progress", "runs", f"SELECT repo AS request, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS done, CAST(sum(score) AS BIGINT) AS total FROM runs GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= {SEEN} - INTERVAL 1 HOUR")
def _(s):
    return T.run(T.batch_progress(runs(s).withColumnRenamed("repo", "request")), "append")


@query("st10_chain_check_stream", "runs", f"SELECT repo, run_id FROM runs WHERE run_id % 50 = 0 AND ts <= {SEEN} - INTERVAL 1 HOUR")
def _(s):
    chained = H.chain_hashes(s.view("runs"), "key").withColumn("hash", F.when(F.col("run_id") % 50 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    folder = settle(chained).inputFiles()[0].rpartition("/")[0]
    return T.run(T.chain_check_stream(T.stream_of(s.spark, folder), "key"), "append")


@query("st11_session_rollup", "runs", "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM runs WINDOW w AS (PARTITION BY repo ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY ts) AS k FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY repo, k ORDER BY ts DESC, run_id DESC) AS nth FROM n), f AS (SELECT repo, k, run_id % 3 AS file, min(nth) AS nth FROM o GROUP BY ALL), l AS (SELECT repo, k, list(file ORDER BY nth)[:2] AS files FROM f GROUP BY repo, k) SELECT repo, min(ts) AS start, count(*) AS runs, CAST(max(score) AS BIGINT) AS best, string_agg(DISTINCT team, ',' ORDER BY team) AS teams, list(run_id ORDER BY nth) FILTER (nth <= 5) AS receipts, any_value(l.files) AS files FROM o JOIN l USING (repo, k) GROUP BY repo, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(s):
    return T.run(T.session_rollup(runs(s).withColumn("file", F.col("run_id") % 3), 6 * 3_600_000, files=2, receipts=5), "append")
