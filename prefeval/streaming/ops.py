"""Structured Streaming operators (ST ops).

ST1 incremental evaluation: new result files are counted per micro-batch and
    merged into running totals; each batch writes its own partition of the
    totals table (overwrite of ``batch_id=N``), so a retried batch is
    idempotent.
ST2 streaming EMA: ``applyInPandasWithState`` folds each series in step order
    and holds rows that came early.
ST3 request ledger: state per request id, ended in event time by a terminal
    observation or a timeout, emitted once the watermark has passed it.
ST4 windowed throughput: tumbling windows with a watermark, append mode.

All queries run with ``trigger(availableNow=True)`` in tests and benches and
keep their checkpoints under the session's shared checkpoint folder.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prefeval.operators.ledger import TERMINAL
from prefeval.operators.logs import _step


# --------------------------------------------------------------------------- ST1
def incremental_eval(spark: SparkSession, results_dir: str, schema: T.StructType, totals_dir: str,
                     checkpoint: str, keys=("seed", "benchmark", "language")) -> None:
    """Count total / correct per group for every new file batch and store
    them under ``totals_dir/batch_id=<n>``. Re-running the same batch
    overwrites only its own partition (idempotent)."""
    keys = list(keys)
    stream = spark.readStream.schema(schema).parquet(results_dir)

    def merge(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"),
                                          F.count(F.when(F.col("correct"), 1)).alias("correct"))
        (counts.withColumn("batch_id", F.lit(int(batch_id)))
               .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("batch_id").parquet(totals_dir))

    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()


def totals(spark: SparkSession, totals_dir: str, keys=("seed", "benchmark", "language")) -> DataFrame:
    """Running totals = sum over all merged batches."""
    keys = list(keys)
    t = spark.read.parquet(totals_dir)
    return t.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))


# --------------------------------------------------------------------------- ST2
def stream_ema(stream: DataFrame, decay: float, keys=("run", "metric"), step: str = "step",
               value: str = "value", mode: str = "restart", first_step: int = 0) -> DataFrame:
    """G1 on a stream whose rows may come in any order and in any batches.

    Steps of a series are dense from ``first_step``. The state holds the next
    step to fold, the EMA before it, and the rows that came early; a row is
    folded (and emitted) as soon as all before it have been. What is held is
    as large as the disorder, not the series. A step that was folded already
    comes twice: the query fails rather than fold it silently."""
    keys = list(keys)
    out_schema = T.StructType([f for f in stream.schema.fields if f.name in keys] + [
        T.StructField(step, T.LongType()), T.StructField("ema", T.DoubleType()),
        T.StructField("ema_prev", T.DoubleType())])
    state_schema = T.StructType([
        T.StructField("next", T.LongType()), T.StructField("ema", T.DoubleType()), T.StructField("seen", T.BooleanType()),
        T.StructField("steps", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, cur, waiting = first_step, None, {}
        if state.exists:
            at, ema_, seen, steps, values = state.get
            cur = ema_ if seen else None
            waiting = dict(zip(steps, values))
        for pdf in pdfs:
            for s, v in zip(pdf[step].tolist(), pdf[value].tolist()):
                if s < at or s in waiting:
                    raise ValueError(f"step {s} of series {key} came twice")
                waiting[s] = v
        done = []
        while at in waiting:
            v = waiting.pop(at)
            v = None if pd.isna(v) and mode == "skip" else float("nan") if v is None else float(v)
            prev, cur = cur, _step(cur, v, decay, mode)
            done.append((at, cur, prev))
            at += 1
        left = sorted(waiting)
        state.update((at, cur, cur is not None, left, [waiting[s] for s in left]))
        if done:
            res = pd.DataFrame({k: [v] * len(done) for k, v in zip(keys, key)})
            res[step], res["ema"], res["ema_prev"] = zip(*done)
            yield res

    return stream.groupBy(*keys).applyInPandasWithState(
        fn, outputStructType=out_schema, stateStructType=state_schema, outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------- ST3
def stream_ledger(stream: DataFrame, watermark: str = "1 hour", timeout_ms: int = 2 * 86400 * 1000,
                  key: str = "id", ts: str = "ts") -> DataFrame:
    """How each request ended, decided in event time alone.

    A request opens at its earliest observation and ends at its earliest
    terminal one, or with ``timeout`` at opening + ``timeout_ms`` if none came
    by then. The ending is emitted once, when the watermark has passed it (no
    earlier row can come any more); the request stays closed. So the answer
    does not depend on how rows fall into batches, as long as they are not
    later than the watermark allows. The state is one small row per request."""
    out_schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("status", T.StringType()),
                               T.StructField("closed_at", T.TimestampType())])
    state_schema = T.StructType([T.StructField("first_us", T.LongType()), T.StructField("end_us", T.LongType()),
                                 T.StructField("status", T.StringType()), T.StructField("closed", T.BooleanType())])
    wait_us = timeout_ms * 1000

    def ending(first, end, status):
        return (first + wait_us, "timeout") if end is None or end > first + wait_us else (end, status)

    def fn(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, end, status, closed = state.get if state.exists else (None, None, None, False)
        if closed:
            return
        passed = state.getCurrentWatermarkMs()
        if first is not None and ending(first, end, status)[0] // 1000 < passed or state.hasTimedOut:
            at, how = ending(first, end, status)
            state.update((first, end, status, True))
            yield pd.DataFrame({key: [int(k[0])], "status": [how], "closed_at": [pd.Timestamp(at, unit="us")]})
            return
        for pdf in pdfs:
            for st, t in zip(pdf["status"], pdf[ts]):
                us = pd.Timestamp(t).value // 1000
                first = us if first is None else min(first, us)
                if st in TERMINAL and (end is None or (us, st) < (end, status)):
                    end, status = us, st
        state.update((first, end, status, False))
        state.setTimeoutTimestamp(max(ending(first, end, status)[0] // 1000, passed + 1))

    return (stream.withWatermark(ts, watermark).groupBy(key)
                  .applyInPandasWithState(fn, outputStructType=out_schema, stateStructType=state_schema,
                                          outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout))


# --------------------------------------------------------------------------- ST4
def stream_throughput(stream: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                      ts: str = "ts", tokens: str = "value") -> DataFrame:
    """G5 over tumbling windows; a window is emitted once the watermark
    passes its end (append mode)."""
    w = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("items"), F.sum(tokens).alias("tokens"),
        F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    dt = F.greatest(F.col("_t1").cast("double") - F.col("_t0").cast("double"), F.lit(1e-8))
    return w.select(F.unix_timestamp("w.start").alias("window_start"), "items", "tokens",
                    (F.col("items") / dt).alias("items_per_sec"), (F.col("tokens") / dt).alias("tokens_per_sec"))


def run_to_table(spark: SparkSession, df: DataFrame, out_dir: str, checkpoint: str,
                 mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to completion (availableNow) into parquet
    files under ``out_dir`` and read the result back as a batch table."""
    q = (df.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
           .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)


# --------------------------------------------------------------------------- M16 as a stream
def stream_last_n(stream: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """``metrics.last_n`` on a stream: whenever a batch changes a key's n most
    recent rows, they are emitted whole with the next ``version`` of that key;
    the largest version is the current set (``current_last_n``).

    ``order`` columns are whole numbers that tell the rows apart in time, the
    last one the tie-break. The state of a key is n rows at most, whatever the
    stream holds, and each task hands on its own n rows per key at most, so a
    hot key stays small. The result does not depend on batches or on the order
    of arrival. Rows with a null in ``order`` are never kept; a null key is a
    key; repeated rows count each by itself."""
    names = [key, *order]
    rows = stream.select(*[F.col(c).cast("long").alias(c) if c in order else F.col(c) for c in names]) \
        .dropna(subset=order)

    def trim(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in pdfs:
            both = pdf if kept is None else pd.concat([kept, pdf])
            kept = both.sort_values(order, ascending=False).groupby(key, dropna=False).head(n)
        if kept is not None:
            yield kept

    state_schema = T.StructType([T.StructField("version", T.LongType())] + [
        T.StructField(c, T.ArrayType(T.LongType())) for c in order])

    def fn(group, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, *held = state.get if state.exists else (0, *[[] for _ in order])
        before = sorted(zip(*held), reverse=True)
        now = before
        for pdf in pdfs:
            now = sorted([*now, *zip(*[pdf[c].tolist() for c in order])], reverse=True)[:n]
        if now != before:
            columns = [list(c) for c in zip(*now)]
            state.update((version + 1, *columns))
            yield pd.DataFrame({key: [group[0]] * len(now), **dict(zip(order, columns)), "version": version + 1})

    schema = T.StructType([*rows.schema.fields, T.StructField("version", T.LongType())])
    return rows.mapInPandas(trim, rows.schema).groupBy(key).applyInPandasWithState(
        fn, outputStructType=schema, stateStructType=state_schema, outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)


def current_last_n(out: DataFrame, key: str) -> DataFrame:
    """The rows of each key's largest version."""
    last = out.groupBy(F.col(key).alias("_key")).agg(F.max("version").alias("_version"))
    return out.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("version") == F.col("_version")), "left_semi") \
        .drop("version")
