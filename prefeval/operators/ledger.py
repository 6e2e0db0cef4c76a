"""Request ledger of hosted inference (R ops): batches, batch health, latest
status per request, resubmission, completions and pending requests.

A ledger row is one observation of one request: (id, attempt, status, ts,
output). All operators are per-id aggregates or joins, so a request with
many attempts is reduced by partial aggregation, never shipped whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.functions.keys import dense_index

# Terminal request states.
TERMINAL = ["succeeded", "failed", "canceled"]


def assign_batches(df: DataFrame, size: int, order: str = "row_id") -> DataFrame:
    """R1: consecutive chunks of ``size`` rows by row position (``order`` may
    have gaps); size <= 0 -> one chunk."""
    if size <= 0:
        return df.withColumn("batch", F.lit(0).cast("long"))
    return dense_index(df, [], [order], name="_at").withColumn("batch", F.floor(F.col("_at") / size).cast("long")).drop("_at")


def batch_health(df: DataFrame, failed: str = "failed", batch: str = "batch") -> DataFrame:
    """R2: submissions and failed submissions per batch; ``stop`` when a batch
    failed entirely (the run would stop there)."""
    g = df.groupBy(batch).agg(F.count(F.lit(1)).alias("submitted"),
                              F.count(F.when(F.col(failed), 1)).alias("failed"))
    return g.withColumn("stop", (F.col("submitted") > 0) & (F.col("failed") == F.col("submitted")))


def latest_status(ledger: DataFrame, max_wait_seconds: float | None = None, now=None,
                  key: str = "id", ts: str = "ts") -> DataFrame:
    """R3: status of each request from its latest observation (``max_by`` on
    (ts, attempt)); HTTP 404 is already ``expired``; a request still open
    after ``max_wait_seconds`` since its first observation (relative to
    ``now``, default the latest ts in the ledger) is ``timeout``. A later
    attempt replaces an expired one because the latest row wins."""
    t = F.col(ts).cast("timestamp")
    g = ledger.groupBy(key).agg(
        F.max_by(F.struct("status", "output", "attempt"), F.struct(t, F.col("attempt"))).alias("_last"),
        F.min(t).alias("first_ts"), F.max(t).alias("last_ts"),
        F.count(F.when(F.col("status") == "expired", 1)).alias("expired_rounds"),
        F.max("attempt").alias("attempts"))
    out = g.select(key, F.col("_last.status").alias("status"), F.col("_last.output").alias("output"),
                   "first_ts", "last_ts", "expired_rounds", "attempts")
    if max_wait_seconds is not None:
        ref = now if now is not None else ledger.agg(F.max(F.col(ts).cast("timestamp"))).scalar()
        waited = ref.cast("double") - F.col("first_ts").cast("double")
        open_ = ~F.col("status").isin(*TERMINAL, "expired")
        out = out.withColumn("status", F.when(open_ & (waited > max_wait_seconds), F.lit("timeout"))
                             .otherwise(F.col("status")))
    return out


def to_resubmit(latest: DataFrame, max_rounds: int, key: str = "id") -> DataFrame:
    """R4: expired requests that have not used up ``max_rounds`` resubmissions;
    other failures are not resubmitted."""
    return latest.filter((F.col("status") == "expired") & (F.col("expired_rounds") < max_rounds)).select(key)


def completions(requests: DataFrame, latest: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """R5: one row per request with the output of a succeeded request, else
    ''; plus a one-row count of requests that did not succeed."""
    j = requests.select(key).join(latest.select(key, "status", "output"), key, "left")
    ok = F.col("status") == "succeeded"
    rows = j.select(key, F.when(ok, F.coalesce(F.col("output"), F.lit(""))).otherwise(F.lit("")).alias("output"),
                    F.coalesce(F.col("status"), F.lit("missing")).alias("status"))
    failures = j.agg(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("failures"),
                     F.count(F.lit(1)).alias("requests"))
    return rows, failures


def pending(ledger: DataFrame, key: str = "id") -> DataFrame:
    """R6: requests with no terminal observation yet (``left_anti``)."""
    done = ledger.filter(F.col("status").isin(*TERMINAL)).select(key)
    return ledger.select(key).distinct().join(done, key, "left_anti")
