"""Metric logs (G ops): EMAs, spikes, epoch summaries, inverse-EMA weights,
throughput and piecewise-linear schedules.

The EMA is a sequential fold. It runs as a distributed prefix scan: rows are
cut into fixed-size blocks of consecutive steps per (run, metric); each block
is folded in its own task (``applyInPandas`` on a bounded group); a tiny
table with one transfer summary per block is scanned per series to get the
state entering each block; a second pass folds each block from that state.
No series is ever held by one task, however long the run.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefeval.functions.text import c

BLOCK = 4096


def _finite(x) -> bool:
    return x is not None and not (isinstance(x, float) and (math.isnan(x) or math.isinf(x)))


def _step(prev, v, decay, mode):
    """One EMA update. mode 'restart': a missing or non-finite previous value
    restarts at v. mode 'skip': non-finite values leave the state as is."""
    if mode == "skip":
        if not _finite(v):
            return prev
        return v if prev is None else decay * prev + (1.0 - decay) * v
    if prev is None or not _finite(prev):
        return v
    return decay * prev + (1.0 - decay) * v


RUN = 128


def _kernel(decay: float, n: int):
    """(decay**1..n, lower triangle of (1 - decay) * decay**(i - j))."""
    k = np.arange(n)
    gap = k[:, None] - k[None, :]
    return decay ** (k + 1.0), np.where(gap >= 0, (1.0 - decay) * decay ** np.maximum(gap, 0.0), 0.0)


def _fold(values: np.ndarray, state, decay, mode) -> list:
    """State after each value. Runs of finite values from a finite state are one
    matrix product; only runs with gaps, NaN or infinities go value by value."""
    out: list = []
    powers, kernel = _kernel(decay, min(RUN, len(values)))
    at = 0
    while at < len(values):
        v = values[at:at + RUN]
        if _finite(state) and np.isfinite(v).all():
            y = powers[:len(v)] * state + kernel[:len(v), :len(v)] @ v
            out += y.tolist()
            at += len(v)
        else:
            v = v if state is not None else v[:1]     # a first value seeds alone
            for x in v.tolist():
                state = _step(state, None if mode == "skip" and math.isnan(x) else x, decay, mode)
                out.append(state)
            at += len(v)
        state = out[-1]
    return out


def _summary(values: np.ndarray, decay, mode):
    """Transfer of one block as (a, b, c): with a finite incoming state x the
    block ends at a*x + b (a is 0 once a restart cut the dependence on x);
    with no / non-finite incoming state it ends at c."""
    if np.isfinite(values).all():
        n = len(values)
        return decay ** n, _fold(values, 0.0, decay, mode)[-1], _fold(values, None, decay, mode)[-1]
    a, b = 1.0, 0.0
    cst = None
    for v in values.tolist():
        v = None if mode == "skip" and math.isnan(v) else v
        cst = _step(cst, v, decay, mode)
        if mode == "skip":
            if _finite(v):
                a, b = decay * a, decay * b + (1.0 - decay) * v
        elif not _finite(b):
            a, b = 0.0, v                     # previous state non-finite: restart
        else:
            a, b = decay * a, decay * b + (1.0 - decay) * v
    return a, b, cst


def _apply(summary, x, mode):
    a, b, cst = summary
    if x is None or (mode == "restart" and not _finite(x)):
        return cst
    return a * x + b


def ema(df: DataFrame, value: str = "value", keys=("run", "metric"), step: str = "step",
        decay: float = 0.98, mode: str = "restart", block: int = BLOCK) -> DataFrame:
    """G1: per series (keys) ordered by ``step`` (dense 0-based): first value
    seeds, then decay*prev + (1-decay)*v; ``mode='restart'`` restarts after a
    non-finite state, ``mode='skip'`` ignores non-finite values. Adds ``ema``
    and ``ema_prev`` (the state before this row's update)."""
    keys = list(keys)
    x = df.withColumn("_blk", F.floor(F.col(step) / block).cast("long"))
    key_fields = [f for f in df.schema.fields if f.name in keys]
    sum_schema = T.StructType(key_fields + [
        T.StructField("_blk", T.LongType()), T.StructField("_a", T.DoubleType()),
        T.StructField("_b", T.DoubleType()), T.StructField("_c", T.DoubleType())])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        a, b, cst = _summary(pdf[value].to_numpy("float64", na_value=np.nan), decay, mode)
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update({"_blk": int(pdf["_blk"].iloc[0]), "_a": a, "_b": b, "_c": cst})
        return pd.DataFrame([row])

    summaries = x.select(*keys, "_blk", step, value).groupBy(*keys, "_blk").applyInPandas(summarise, sum_schema)

    carry_schema = T.StructType(key_fields + [T.StructField("_blk", T.LongType()),
                                              T.StructField("_in", T.DoubleType())])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per block of one series: a few hundred rows at most
        pdf = pdf.sort_values("_blk")
        state, out = None, []
        for a, b, cst in zip(pdf["_a"], pdf["_b"], pdf["_c"]):
            out.append(state)
            state = _apply((float(a), float(b), None if pd.isna(cst) else float(cst)), state, mode)
        res = pdf[keys + ["_blk"]].copy()
        res["_in"] = out
        return res

    carries = summaries.groupBy(*keys).applyInPandas(scan, carry_schema)
    fields = list(x.schema.fields) + [T.StructField("ema", T.DoubleType()),
                                      T.StructField("ema_prev", T.DoubleType())]
    out_schema = T.StructType([f for f in fields if f.name != "_in"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        state = None if pdf["_in"].isna().iloc[0] else float(pdf["_in"].iloc[0])
        emas = _fold(pdf[value].to_numpy("float64", na_value=np.nan), state, decay, mode)
        pdf = pdf.drop(columns=["_in"])
        pdf["ema"] = emas
        pdf["ema_prev"] = [state, *emas[:-1]]
        return pdf

    joined = x.join(carries, [*keys, "_blk"], "left")
    return joined.groupBy(*keys, "_blk").applyInPandas(fold, out_schema).drop("_blk")


# --------------------------------------------------------------------------- G2
def spikes(df: DataFrame, threshold: float, multiplier: float, value: str = "value",
           ref: str = "ema_prev") -> DataFrame:
    """Rows whose value >= threshold, or >= multiplier * EMA before this
    update (the first step compares with itself); either test is off at 0;
    the multiplier test needs a positive reference."""
    v = F.col(value)
    r = F.coalesce(F.col(ref), v)
    hit = F.lit(False)
    if threshold > 0:
        hit = hit | (v >= F.lit(float(threshold)))
    if multiplier > 0:
        hit = hit | ((r > 0) & (v >= F.lit(float(multiplier)) * r))
    return df.filter(hit)


def fewest_labels(df: DataFrame, k: int, keys=("run", "step"), labels: str = "label_tokens", key: str = "row_id") -> DataFrame:
    """The ``k`` rows with the fewest label tokens of each spiking step, ties
    by row key. The rank filter keeps k rows per task and step before the
    shuffle."""
    w = Window.partitionBy(*keys).orderBy(labels, key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --------------------------------------------------------------------------- G3
def epoch_summary(df: DataFrame, keys=("run", "epoch"), metric: str = "metric", value: str = "value",
                  drop: str = "dropped") -> DataFrame:
    """Mean of each metric per epoch, step count, and drop ratio = drops /
    seen when seen > 0 (else 0)."""
    keys = list(keys)
    means = df.groupBy(*keys, metric).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("steps"))
    drops = df.groupBy(*keys).agg(F.sum(F.col(drop).cast("long")).alias("drops"),
                                  F.count(F.lit(1)).alias("seen"))
    drops = drops.withColumn("drop_ratio", F.when(F.col("seen") > 0, F.col("drops") / F.col("seen"))
                             .otherwise(F.lit(0.0)))
    return means.join(drops, keys, "left")


# --------------------------------------------------------------------------- G4
def inverse_ema_weights(df: DataFrame, base: dict, keys=("run",), step: str = "step",
                        name: str = "metric", loss: str = "loss", count: str = "n",
                        decay: float = 0.9, warmup: int = 0, min_w: float = 0.0, max_w: float = 0.0,
                        eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Per (step, name): weight = base (0 when base <= 0 or no count); after
    warm-up base / max(ema, eps) when the EMA is positive; clamped by max then
    min (0 = off). The EMA (skip mode, no update for non-finite or empty
    steps) is read before this step's update. Returns (weights per row,
    weighted mean per step = sum(w*loss) / max(sum(w), eps))."""
    keys = list(keys)
    bmap = F.create_map(*[x for kv in base.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
    x = df.withColumn("_loss_for_ema", F.when(F.col(count) > 0, F.col(loss)))
    # steps are unique per series, so blocks of the step axis stay bounded
    e = ema(x, value="_loss_for_ema", keys=[*keys, name], step=step, decay=decay, mode="skip")
    b = F.greatest(F.coalesce(F.element_at(bmap, F.col(name)), F.lit(0.0)), F.lit(0.0))
    w = F.when((b <= 0) | (F.col(count) <= 0), F.lit(0.0)).otherwise(
        F.when((F.col(step) >= warmup) & (F.col("ema_prev") > 0), b / F.greatest(F.col("ema_prev"), F.lit(eps)))
         .otherwise(b))
    if max_w > 0:
        w = F.when(w > 0, F.least(w, F.lit(max_w))).otherwise(w)
    if min_w > 0:
        w = F.when(w > 0, F.greatest(w, F.lit(min_w))).otherwise(w)
    rows = e.withColumn("weight", w)
    per_step = rows.groupBy(*keys, step).agg(
        (F.sum(F.col("weight") * F.col(loss)) / F.greatest(F.sum("weight"), F.lit(eps))).alias("weighted_loss"),
        F.sum("weight").alias("weight_sum"))
    return rows.drop("_loss_for_ema"), per_step


# --------------------------------------------------------------------------- G5
def throughput(df: DataFrame, ts: str = "ts", keys=("run",), items: str | None = None,
               tokens: str = "value", window: str = "1 hour") -> DataFrame:
    """Items and tokens per second per tumbling window: counts / elapsed
    seconds between the first and last event (floor 1e-8)."""
    keys = list(keys)
    t = F.col(ts).cast("timestamp")
    g = df.groupBy(*keys, F.window(t, window).alias("w")).agg(
        (F.count(F.lit(1)) if items is None else F.sum(items)).alias("items"),
        F.sum(tokens).alias("tokens"),
        (F.max(t).cast("double") - F.min(t).cast("double")).alias("_dt"))
    dt = F.greatest(F.col("_dt"), F.lit(1e-8))
    return g.select(*keys, F.unix_timestamp(F.col("w.start")).alias("window_start"), "items", "tokens",
                    (F.col("items") / dt).alias("items_per_sec"), (F.col("tokens") / dt).alias("tokens_per_sec"))


def sliding_throughput(df: DataFrame, slide: str = "15 minutes", panes: int = 4, ts: str = "ts", keys=("run",),
                       tokens: str = "value") -> DataFrame:
    """``throughput`` over windows of ``panes`` slides, one beginning at every
    slide. Rows are aggregated once, per slide; a window combines its slides'
    aggregates, so the rows are not copied into each window they belong to.

    Edge cases: rows without a time belong to no window; null token counts add
    nothing (a window of nulls only has null tokens); a null key is a key;
    windows without a row are absent; an empty table gives no rows."""
    if panes < 1:
        raise ValueError(f"a window needs at least one slide, got {panes}")
    keys, t = list(keys), F.col(ts).cast("timestamp")
    pane = df.groupBy(*keys, F.window(t, slide).alias("_pane")).agg(
        F.count(F.lit(1)).alias("_items"), F.sum(tokens).alias("_tokens"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    start, length = F.unix_timestamp("_pane.start"), F.unix_timestamp("_pane.end") - F.unix_timestamp("_pane.start")
    begins = F.transform(F.sequence(F.lit(0), F.lit(panes - 1)), lambda k: start - k * length)
    joined = pane.withColumn("window_start", F.explode(begins)).groupBy(*keys, "window_start").agg(
        F.sum("_items").alias("items"), F.sum("_tokens").alias("tokens"),
        (F.max("_last").cast("double") - F.min("_first").cast("double")).alias("_dt"))
    dt = F.greatest(F.col("_dt"), F.lit(1e-8))
    return joined.select(*keys, "window_start", "items", "tokens",
                         (F.col("items") / dt).alias("items_per_sec"), (F.col("tokens") / dt).alias("tokens_per_sec"))


# --------------------------------------------------------------------------- G6
def _clamped(progress) -> Column:
    return F.least(F.greatest(c(progress).cast("double"), F.lit(0.0)), F.lit(1.0))


def interpolate_schedule(progress, points) -> Column:
    """Piecewise-linear value at progress (clamped to [0, 1]; null counts as 0)
    between (position, value) control points in any order.

    The position is searched among the sorted positions: with ``below`` of them
    under it, it lies between the last of those and the next one, so equal
    positions make a step that takes its right value past the position. Beyond
    either end the outer value holds. ``schedule_values`` takes schedules from
    a table."""
    if not points:
        raise ValueError("a schedule needs at least one (position, value) point")
    ordered = sorted(points, key=lambda point: point[0])
    at, value = (F.array(*[F.lit(float(point[k])) for point in ordered]) for k in (0, 1))
    p = _clamped(progress)
    below = F.size(F.filter(at, lambda x: x < p))
    x0, x1, y0, y1 = (F.get(a, i) for a in (at, value) for i in (below - 1, below))
    return F.coalesce(y0 + (y1 - y0) * ((p - x0) / (x1 - x0)), y1, y0)


def schedule_values(rows: DataFrame, schedules: DataFrame, progress: str, keys=("run",), position: str = "position",
                    value: str = "value", order: str = "point", name: str = "scheduled", cells: int = 64) -> DataFrame:
    """Rows with the value of their own schedule at ``progress``.

    ``schedules`` holds one control point a row: ``keys``, ``position``,
    ``value`` and ``order``, which ranks points of one position. Each pair of
    neighbours is an interval, open on its left; [0, 1] is cut into ``cells``
    equal cells, an interval is listed in every cell it reaches and rows meet
    it by key and cell, so the rows of one hot key are spread over the cells.
    Exactly one interval holds a row.

    Edge cases: progress as in ``interpolate_schedule``; rows without a
    schedule or with a null key get null; points with a null position or value
    are left out; repeated rows are kept; an empty table gives no rows."""
    keys = list(keys)
    if clash := {name, "_p", "_cell", "_lo", "_hi", "_from", "_to"} & set(rows.columns):
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    cell = lambda x: F.least(F.greatest(F.floor(x * cells), F.lit(0)), F.lit(cells - 1)).cast("int")
    points = schedules.select(*keys, F.col(position).cast("double").alias("_hi"), F.col(value).cast("double").alias("_to"),
                              F.col(order).alias("_order")).filter("_hi is not null and _to is not null")
    line = Window.partitionBy(*keys).orderBy("_hi", "_order")
    paired = points.select(*keys, F.lag("_hi").over(line).alias("_lo"), F.lag("_to").over(line).alias("_from"), "_hi", "_to",
                           F.lead("_hi").over(line).isNull().alias("_end"))
    # the end point also opens the interval that has no right end
    ends = paired.filter("_end").select(*keys, F.col("_hi").alias("_lo"), F.col("_to").alias("_from"),
                                        *[F.lit(None).cast("double").alias(x) for x in ("_hi", "_to")])
    pieces = paired.filter("_lo is null or _lo < _hi").drop("_end").unionByName(ends)
    reach = F.sequence(cell(F.coalesce("_lo", F.lit(0.0))), cell(F.coalesce("_hi", F.lit(1.0))))
    pieces = pieces.withColumn("_cell", F.explode(reach))
    placed = rows.withColumn("_p", _clamped(progress)).withColumn("_cell", cell(F.col("_p")))
    r, s = placed.alias("r"), pieces.alias("s")
    match = (F.col("r._cell") == F.col("s._cell")) & (F.col("s._lo").isNull() | (F.col("r._p") > F.col("s._lo"))) \
        & (F.col("s._hi").isNull() | (F.col("r._p") <= F.col("s._hi")))
    for k in keys:
        match = match & (F.col(f"r.{k}") == F.col(f"s.{k}"))
    between = F.col("_from") + (F.col("_to") - F.col("_from")) * ((F.col("_p") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return r.join(s, match, "left").select(*[F.col(f"r.{x}") for x in rows.columns],
                                           F.coalesce(between, "_to", "_from").alias(name))
