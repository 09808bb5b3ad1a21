"""Streaming operators over file arrivals, requests, runs and provider calls. Event time and watermarks are ours."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.types import LongType, StructField, StructType

from lintlake.operators import rules as R
from lintlake.operators import scan
from lintlake.operators.history import circuit_step, priced
from lintlake.operators.scratch import shared_path


#: Rows of a key that are records at a time.
SLICE = 10_000
#: Groups of keys whose state is kept together, so that a batch calls Python once for a group and not for each key.
BUCKETS = 256


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, in its own schema; time stamps without zone become event times."""
    table = spark.read.parquet(path)
    folder, _, name = table.inputFiles()[0].rpartition("/")
    reader = spark.readStream.schema(table.schema)
    one_file = not folder.endswith(path.rstrip("/").rpartition("/")[2])
    rows = reader.option("pathGlobFilter", name).parquet(folder) if one_file else reader.parquet(path)
    return rows.select(*[F.col(c).cast("timestamp") if kind == "timestamp_ntz" else F.col(c) for c, kind in table.dtypes])


def run(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Take what is there now to the end and give the result as a table in the shared folder.

    append keeps every batch, complete the last one, update (and whatever names keys) the last row of each key. A batch is written to a folder of its own
    number: one that is tried again replaces itself.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/out/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    out = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    if mode == "complete":
        out = out.join(out.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    elif keys:
        out = out.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch").desc()))).where("nth = 1")
    return out.select(*[F.col(f.name).cast("timestamp_ntz") if f.dataType.simpleString() == "timestamp" else F.col(f.name) for f in df.schema.fields])


def stream_scan(files: DataFrame) -> DataFrame:
    """Findings of arriving files: repo, path, content."""
    return scan.scan_rules(scan.explode_lines(files), R.IP_MARKERS).drop("place")


def debounce(events: DataFrame, gap: str = "500 milliseconds", delay: str = "1 minute") -> DataFrame:
    """The last change of every burst of a path: events closer than gap are one burst. events: path, ts, version."""
    w = events.withWatermark("ts", delay).groupBy("path", F.session_window("ts", gap))
    return w.agg(F.max_by("version", "ts").alias("version"), F.count(F.lit(1)).alias("changes")).select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "version", "changes")


def rate_limit(requests: DataFrame, most: int = 100, window: str = "60 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests of each client in each tumbling window, how many pass and how many are left."""
    w = requests.withWatermark("ts", delay).groupBy("client", F.window("ts", window))
    n = w.agg(F.count(F.lit(1)).alias("requests"))
    return n.select("client", F.col("window.start").alias("start"), "requests", F.least("requests", F.lit(most)).alias("allowed"), F.greatest(F.lit(0), most - F.col("requests")).alias("remaining"))


def in_order(rows: DataFrame, key: str, order: str, step: Callable[[Any, dict], tuple[Any, tuple | None]], start: Any, out: str, delay: str, idle_ms: int, update: bool = False, finish: Callable[[Any], tuple] | None = None) -> DataFrame:
    """A fold over each key's rows in order of ts and `order`, across batches, whatever order they arrive in within the delay.

    Rows wait in the key's state until the watermark has passed them, and a timer at the earliest of them wakes the key where no
    new rows do. step gets the fold's state and a row, and returns the new state and a row of `out` or None. After idle_ms of event
    time without a row the key's state ends and its fold begins anew; finish makes a row of what the fold held then. Rows that come
    behind the watermark are dropped. What a key holds are its rows of the last delay. With update a batch gives one row of each key,
    the last, and waiting rows count in it as if none came between them any more; what is kept is the fold of those that have passed.
    Waiting rows are kept as columns and become records by slices only; a record's ts are nanoseconds, and so are those of a row of `out`.
    """

    fields = T._parse_datatype_string(out).fields
    names = [f.name for f in fields]
    kinds = ["int64" if isinstance(f.dataType, (T.LongType, T.TimestampType)) else "int32" if isinstance(f.dataType, T.IntegerType) else None for f in fields]
    times = [isinstance(f.dataType, T.TimestampType) for f in fields]
    columns = rows.columns

    def table(done: list[tuple]) -> pd.DataFrame:
        made = {}
        for name, kind, is_time, each in zip(names, kinds, times, zip(*done, strict=True), strict=True):
            kind = None if kind and not is_time and None in each else kind
            made[name] = np.array(each, dtype=kind).view("datetime64[ns]") if is_time else np.array(each, dtype=kind) if kind else list(each)
        return pd.DataFrame(made)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, folds = pickle.loads(state.get[0]) if state.exists else ({}, {})  # columns of rows; key: its fold's state and last time
        named = lambda k: None if group[0] < 0 else k
        if not state.hasTimedOut:
            parts = {c: [waiting.pop(c)] if c in waiting else [] for c in columns}
            for batch in batches:
                for c in columns:
                    values = batch[c].to_numpy()
                    parts[c].append(values.astype("datetime64[ns]").view("int64") if c == "ts" else values)
            waiting = {c: each[0] if len(each) == 1 else np.concatenate(each) for c in columns if (each := parts.pop(c))}
            if waiting:
                by = np.lexsort((waiting[order], waiting["ts"], pd.factorize(waiting[key])[0]))
                for c in columns:
                    waiting[c] = waiting[c][by]
                del by
        passed = state.getCurrentWatermarkMs()

        def records(chosen: dict) -> Iterator[list[dict]]:
            for begin in range(0, len(chosen["ts"]) if chosen else 0, SLICE):
                each = [chosen[c][begin : begin + SLICE].tolist() for c in columns]
                yield [dict(zip(columns, row, strict=True)) for row in zip(*each, strict=True)]

        ready = {}
        if waiting:
            due = waiting["ts"] < (passed + 1) * 1_000_000
            if due.all():
                ready, waiting = waiting, {}
            elif due.any():
                ready, waiting = ({c: waiting[c][some] for c in columns} for some in (due, ~due))
        newest: dict[Any, tuple] = {}
        for each in records(ready):
            done = []
            for row in each:
                k, now = row[key], row["ts"] // 1_000_000
                held, last = folds.get(k, (start, None))
                if last is not None and now - last >= idle_ms:
                    done += [(named(k), *finish(held))] if finish else []
                    held = start
                held, said = step(held, row)
                folds[k] = held, now
                if said is not None:
                    done.append((named(k), *said))
                    if update:
                        newest[k] = done[-1]
            if done and not update:
                yield table(done)
        ended = [k for k, (_, last) in folds.items() if last + idle_ms <= passed]
        over = [(named(k), *finish(folds[k][0])) for k in ended] if finish else []
        if over and not update:
            yield table(over)
        for k in ended:
            del folds[k]
        if waiting or folds:
            state.update((pickle.dumps((waiting, folds), pickle.HIGHEST_PROTOCOL),))
            wake = ([int(waiting["ts"].min()) // 1_000_000] if waiting else []) + [last + idle_ms for _, last in folds.values()]
            state.setTimeoutTimestamp(max(min(wake), passed + 1))
        elif state.exists:
            state.remove()
        if update:
            ahead = {}
            for each in records(waiting):
                for row in each:
                    k = row[key]
                    ahead[k], said = step(ahead[k] if k in ahead else folds.get(k, (start, None))[0], row)
                    if said is not None:
                        newest[k] = (named(k), *said)
            if newest:
                yield table(list(newest.values()))

    # null keys are a group of their own and lie under a value that the type has
    kind = rows.schema[key].dataType.simpleString()
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")
    grouped = rows.withColumn("bucket", bucket).withColumn(key, F.coalesce(key, F.lit("" if kind == "string" else 0).cast(kind)))
    return grouped.withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(fold, out, "held binary", "update" if update else "append", "EventTimeTimeout")


def rate_limit_exact(requests: DataFrame, most: int = 100, window_ms: int = 60_000, delay: str = "1 minute") -> DataFrame:
    """(client, event_id, ts, allowed, remaining) of each request. A client's window begins with its first request, and the first one after its end begins the next.

    requests: client, ts, event_id. The state of a client ends a window after its last request.
    """

    def step(held: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], tuple]:
        now = row["ts"] // 1000
        begun, count = (now, 0) if held is None or now - held[0] >= window_ms * 1000 else held
        count += 1
        return (begun, count), (row["event_id"], row["ts"], count <= most, max(0, most - count))

    return in_order(requests.select("client", "ts", "event_id"), "client", "event_id", step, None, "client long, event_id long, ts timestamp, allowed boolean, remaining int", delay, window_ms)


def client_sessions(requests: DataFrame, idle: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each client that end after a pause."""
    w = requests.withWatermark("ts", delay).groupBy("client", F.session_window("ts", idle))
    return w.agg(F.count(F.lit(1)).alias("requests")).select("client", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests")


def dedupe_ttl(requests: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """The first of every key within the time to live."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def first_of_ttl(rows: DataFrame, key: str, ttl_ms: int, delay: str = "1 minute") -> DataFrame:
    """(key, event_id, ts): the first row of each key, and the first after each time to live that such a row opens. rows: key, ts, event_id."""

    def step(opened: int | None, row: dict) -> tuple[int, tuple | None]:
        now = row["ts"] // 1000
        if opened is not None and now - opened <= ttl_ms * 1000:
            return opened, None
        return now, (row["event_id"], row["ts"])

    kind = rows.schema[key].dataType.simpleString()
    return in_order(rows.select(key, "ts", "event_id"), key, "event_id", step, None, f"{key} {kind}, event_id long, ts timestamp", delay, ttl_ms + 1)


def sliding_scores(runs: DataFrame, window: str = "7 days", step: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Mean score of each team in sliding windows."""
    w = runs.withWatermark("ts", delay).groupBy("team", F.window("ts", window, step))
    return w.agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("runs")).select("team", F.col("window.start").alias("start"), "total", "runs")


def spend_stream(calls: DataFrame, budget: int, delay: str = "1 hour") -> DataFrame:
    """Spending of each day, and whether it breaks the budget."""
    w = priced(calls).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"))
    return w.agg(F.sum("micro_usd").alias("micro_usd"), F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("start"), "micro_usd", "calls", (F.col("micro_usd") > budget).alias("over_budget"))


def batch_progress(results: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Count and total of each request's results in each window; a window's state ends when the watermark passes it."""
    w = results.withWatermark("ts", delay).groupBy("request", F.window("ts", window))
    return w.agg(F.count(F.lit(1)).alias("done"), F.sum("score").alias("total")).select("request", F.col("window.start").alias("start"), "done", "total")


def session_rollup(events: DataFrame, idle_ms: int = 30 * 86_400_000, delay: str = "1 day", files: int = 20, receipts: int = 50) -> DataFrame:
    """Per session of a repo: start, number of runs, best score, distinct teams, and its newest files and receipts, newest first.

    events: repo, ts, run_id, file, score, team. A session ends after a pause and is given out when the watermark has passed it. Its
    state holds the newest `receipts` runs and `files` files, each file once, and never more.
    """

    def step(held: tuple | None, row: dict) -> tuple[tuple, None]:
        begun, runs, best, teams, newest, seen = held or (row["ts"], 0, row["score"], frozenset(), (), ())
        seen = (row["file"], *[f for f in seen if f != row["file"]])[:files]
        return (begun, runs + 1, max(best, row["score"]), teams | {row["team"]}, (row["run_id"], *newest)[:receipts], seen), None

    def finish(held: tuple) -> tuple:
        begun, runs, best, teams, newest, seen = held
        return begun, runs, best, ",".join(sorted(teams)), list(newest), list(seen)

    rows = events.select("repo", "ts", "run_id", "file", F.col("score").cast("long").alias("score"), "team")
    return in_order(rows, "repo", "run_id", step, None, "repo long, start timestamp, runs long, best long, teams string, receipts array<long>, files array<long>", delay, idle_ms, finish=finish)


def reliability_stream(calls: DataFrame, delay: str = "1 minute", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """A provider's score and circuit after the calls so far in order of their time, once a batch that has some; late ones within the delay mend it.

    Scores are hundredths: 150 up for a success, 450 down for a failure, within 0 and 10000. Under 3000 the circuit opens; 60
    seconds of event time later a success closes it and adds 1000, a failure opens it again. After 30 days without a call a provider
    begins anew. calls: provider, ts, call_id, success.
    """

    def step(held: tuple, row: dict) -> tuple[tuple, tuple]:
        score, circuit, opened = circuit_step(*held[:3], row["ts"] / 1_000_000_000, row["success"])
        seen = held[3] + 1
        return (score, circuit, opened, seen), (score / 100, circuit, seen)

    return in_order(calls, "provider", "call_id", step, (10000, "closed", 0.0, 0), "provider long, score double, circuit string, calls long", delay, idle_ms, update=True)


def chain_check_stream(runs: DataFrame, key: str, delay: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Runs whose stored hash does not follow from their content and the one before, per repo, across batches and in any order of arrival within the delay.

    A repo without a run for 30 days begins a new chain.
    """
    import hashlib

    def digest(before: str, content: str) -> str:
        inner = hashlib.sha256(f"{key}|{before}|{content}".encode()).hexdigest()
        return hashlib.sha256(f"{key}{inner}".encode()).hexdigest()

    def step(before: str, row: dict) -> tuple[str, tuple | None]:
        content = f"{row['run_id']}|{row['repo']}|{row['score']}|{row['status']}"
        return content, None if digest(before, content) == row["hash"] else (row["run_id"],)

    return in_order(runs, "repo", "run_id", step, "root", "repo long, run_id long", delay, idle_ms)
