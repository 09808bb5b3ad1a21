"""Folds in event-time order over several batches out of order, slices of a fold, bodies and clones of any length."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import filters, history, search
from lintlake.streaming import operators as T

START = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, size):
    """The rows as a stream that brings `size` of them in each batch."""
    folder = f"file://{tmp_path}/in"
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled(r, rows, reach):
    """Rows in an order in which none comes over `reach` seconds later than a newer one."""
    return sorted(rows, key=lambda row: (row[1] - START).total_seconds() + r.random() * reach)


def test_rate_limit_over_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(3), START + dt.timedelta(seconds=r.randrange(2000), milliseconds=k), k) for k in range(400)]
    flow = stream(spark, tmp_path, shuffled(r, rows, 100), "client long, ts timestamp, event_id long", 60)
    got = {(x.client, x.event_id): (x.allowed, x.remaining) for x in T.run(T.rate_limit_exact(flow, 5, 60_000, "2 minutes"), "append").collect()}
    want, held, newest = {}, {}, max(row[1] for row in rows)
    for client, ts, i in sorted(rows, key=lambda row: (row[1], row[2])):
        begun, n = held.get(client, (ts, 0))
        begun, n = (ts, 1) if ts - begun >= dt.timedelta(seconds=60) else (begun, n + 1)
        held[client] = begun, n
        if ts < newest - dt.timedelta(minutes=2):
            want[(client, i)] = (n <= 5, max(0, 5 - n))
    assert {k: got[k] for k in want} == want and len(got) <= len(want) + 1


def test_chain_and_circuit_over_batches(spark, tmp_path):
    r = random.Random(2)
    runs = [(k, START + dt.timedelta(seconds=7 * k), k % 3, r.randrange(100), "pass") for k in range(300)]
    table = history.chain_hashes(spark.createDataFrame(runs, "run_id long, ts timestamp, repo long, score int, status string"), "key")
    table = table.withColumn("hash", F.when(F.col("run_id") % 40 == 0, F.reverse("hash")).otherwise(F.col("hash")))
    rows = shuffled(r, [tuple(x) for x in table.select("run_id", "ts", "repo", "score", "status", "hash").collect()], 200)
    flow = stream(spark, tmp_path / "a", rows, "run_id long, ts timestamp, repo long, score int, status string, hash string", 50)
    got = {x.run_id for x in T.run(T.chain_check_stream(flow, "key", "5 minutes"), "append").collect()}
    newest = max(row[1] for row in rows)
    assert got == {k for k, ts, *_ in runs if k % 40 == 0 and ts < newest - dt.timedelta(minutes=5)}
    calls = [(k % 2, ts, k, r.random() < 0.4) for k, ts, *_ in runs]
    flow = stream(spark, tmp_path / "b", shuffled(r, calls, 200), "provider long, ts timestamp, call_id long, success boolean", 50)
    got = {x.provider: (x.score, x.circuit, x.calls) for x in T.run(T.reliability_stream(flow, "5 minutes"), "update", ["provider"]).collect()}
    want = {}
    for provider, ts, _, success in sorted(calls, key=lambda c: (c[1], c[2])):
        *held, n = want.get(provider, (10000, "closed", 0.0, 0))
        want[provider] = (*history.circuit_step(*held, ts.timestamp(), success), n + 1)
    assert got == {p: (score / 100, circuit, n) for p, (score, circuit, _, n) in want.items()}


def test_sessions_end_and_keep_the_newest(spark, tmp_path):
    rows = [(1, START + dt.timedelta(minutes=m), m, m % 4, m, "t") for m in range(30)] + [(1, START + dt.timedelta(hours=9), 100, 9, 1, "u"), (2, START + dt.timedelta(days=3), 101, 9, 1, "u")]
    flow = stream(spark, tmp_path, rows, "repo long, ts timestamp, run_id long, file long, score int, team string", 7)
    got = {(x.repo, x.runs): (x.best, x.teams, x.receipts, x.files) for x in T.run(T.session_rollup(flow, 3_600_000, "1 hour", files=2, receipts=3), "append").collect()}
    assert got == {(1, 30): (29, "t", [29, 28, 27], [1, 0]), (1, 1): (1, "u", [100], [9])}


@pytest.mark.parametrize("buckets", [1, 3, 256])
def test_keys_of_a_group_do_not_meet(spark, tmp_path, monkeypatch, buckets):
    """Many keys, one of them null, over batches out of order: each is folded as if alone, and Python is called for groups of keys only."""
    monkeypatch.setattr(T, "BUCKETS", buckets)
    r = random.Random(buckets)
    rows = [(r.choice([None, *range(40)]), START + dt.timedelta(seconds=r.randrange(3000)), k) for k in range(900)]
    flow = stream(spark, tmp_path, shuffled(r, rows, 100), "k long, ts timestamp, event_id long", 300)
    folded = T.first_of_ttl(flow, "k", 300_000, "2 minutes")
    got = {(x.k, x.event_id, x.ts) for x in T.run(folded, "append").collect()}
    want, opened, newest = set(), {}, max(row[1] for row in rows)
    for k, ts, i in sorted(rows, key=lambda row: (row[1], row[2])):
        if ts < newest - dt.timedelta(minutes=2) and (k not in opened or ts - opened[k] > dt.timedelta(minutes=5)):
            opened[k] = ts
            want.add((k, i, ts))
    assert got == want


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_clamped_sum_in_slices(spark, size):
    r = random.Random(size)
    rows = [("hot" if r.random() < 0.8 else r.choice("ab"), START + dt.timedelta(seconds=r.randrange(50)), k, r.choice([-5, 2, 9])) for k in range(600)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long, delta int").repartition(5)
    got = {x.k: x.value for x in history.clamped_sum(df, "k", "ts", ["i"], F.col("delta"), 10, 0, 30, slice_rows=size).collect()}
    want = {}
    for k, _, _, delta in sorted(rows, key=lambda row: (row[1], row[2])):
        want[k] = max(0, min(30, want.get(k, 10) + delta))
    assert got == want


def test_long_bodies_are_found(spark):
    body = [f"  step{k}( {k} );" for k in range(5000)]
    rows = [("r", f"f{c}", i + 1, t.replace("(", "( ") if c == 2 else t) for c in range(3) for i, t in enumerate([f"function g{c}() {{", *body, "}"])]
    rows += [("r", "other", i + 1, t) for i, t in enumerate(["function h() {", *body[:-1], "  last();", "}"])]
    lines = spark.createDataFrame(rows, "repo string, path string, line_no int, text string")
    functions = spark.createDataFrame([("r", f"f{c}", 1, 5002) for c in range(3)] + [("r", "other", 1, 5002)], "repo string, path string, start int, end int")
    assert [tuple(x) for x in filters.duplicate_bodies(lines, functions, least=3).collect()] == [("r", "f0", 1, 3, 5001)]


def test_clone_ranges_are_longest(spark):
    shared = [f"call{k}(a, b);" for k in range(12)]
    files = {"a": ["x1", *shared, "y1"], "b": ["z", "z2", "z3", *shared[:9], "end"], "c": shared[5:], "d": ["alone"]}
    lines = spark.createDataFrame([("r", p, i + 1, t) for p, rows in files.items() for i, t in enumerate(rows)], "repo string, path string, line_no int, text string")
    got = {(x.path_a, x.start_a, x.path, x.start, x.end, x.tokens) for x in search.clone_ranges(lines, 5, 50).collect()}
    assert got == {("a", 2, "b", 4, 12, 63)}
    assert {(x.path_a, x.path, x.start, x.end) for x in search.clone_ranges(lines, 5, 10).collect()} == {("a", "b", 4, 12), ("a", "c", 1, 7)}


def test_aggressiveness(spark):
    r = random.Random(12)
    runs = [(repo, START + dt.timedelta(minutes=k), k, "pass" if r.random() < (0.9, 0.5, 0.1)[repo] else "fail") for k in range(60) for repo in range(3)]
    got = {x.repo: x.aggressiveness_hundredths for x in history.aggressiveness(spark.createDataFrame(runs, "repo int, ts timestamp, run_id long, status string")).collect()}
    want = {}
    for repo in range(3):
        value, passed = 50, 0
        for n, (_, _, _, status) in enumerate([x for x in runs if x[0] == repo], 1):
            passed += status == "pass"
            value = max(10, min(100, value + (5 if passed / n > 0.7 else -5 if passed / n < 0.3 else 0)))
        want[repo] = value
    assert got == want and len(set(want.values())) > 1
