"""Verdicts, accuracy and statistics (E ops).

Seeds are a column, so every seed, benchmark and language is one job. All
statistics are two-level aggregates: a partial aggregate per task, a shuffle
of one row per group, then a handful of rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefeval.functions.keys import h32
from prefeval.functions.text import c
from prefeval.operators.tasks import VERDICT_A, VERDICT_B

OVERALL = "_overall"


# --------------------------------------------------------------------------- E1
def parse_verdict(text, pattern_a: str = VERDICT_A, pattern_b: str = VERDICT_B) -> Column:
    """Earliest pattern wins; exact case first, lower case only when neither
    matched; no match -> null; an empty pattern never matches."""
    t = c(text)

    def pos(hay, pat):
        return F.instr(hay, pat) if pat else F.lit(0)

    ia, ib = pos(t, pattern_a), pos(t, pattern_b)
    neither = (ia == 0) & (ib == 0)
    low = F.lower(t)
    la = F.when(neither, pos(low, pattern_a.lower()) if pattern_a else F.lit(0)).otherwise(ia)
    lb = F.when(neither, pos(low, pattern_b.lower()) if pattern_b else F.lit(0)).otherwise(ib)
    return (F.when(t.isNull(), F.lit(None).cast("string"))
             .when((la == 0) & (lb == 0), F.lit(None).cast("string"))
             .when((la > 0) & (lb > 0), F.when(la < lb, F.lit("A")).otherwise(F.lit("B")))
             .when(la > 0, F.lit("A"))
             .otherwise(F.lit("B")))


# --------------------------------------------------------------------------- E2
def build_records(tasks: DataFrame, completions: DataFrame | None, keys=("id", "seed"),
                  pattern_a: str = VERDICT_A, pattern_b: str = VERDICT_B,
                  check_counts: bool = True) -> DataFrame:
    """Join tasks with completions by key, parse, ``correct = verdict <=> expected``.

    With ``check_counts`` a task without completion (or the reverse) fails the
    job inside the same plan (full outer join + ``raise_error``), no extra pass.
    """
    if completions is None:
        # the model stage already appended ``completion`` to each task row
        return (tasks.withColumn("verdict", parse_verdict("completion", pattern_a, pattern_b))
                     .withColumn("correct", F.col("verdict").eqNullSafe(F.col("expected_verdict"))))
    keys = list(keys)
    how = "full_outer" if check_counts else "inner"
    joined = tasks.withColumn("_t", F.lit(True)).join(
        completions.withColumn("_c", F.lit(True)), on=keys, how=how)
    if check_counts:
        bad = F.col("_t").isNull() | F.col("_c").isNull()
        joined = joined.withColumn("_check", F.when(bad, F.raise_error(
            F.lit("completion count does not match task count"))).otherwise(F.lit(True)))
        joined = joined.filter(F.col("_check"))
    return (joined.withColumn("verdict", parse_verdict("completion", pattern_a, pattern_b))
                  .withColumn("correct", F.col("verdict").eqNullSafe(F.col("expected_verdict")))
                  .drop("_t", "_c", "_check"))


def raw_projection(records: DataFrame) -> DataFrame:
    cols = ["id", "language", "prompt", "answer_a", "answer_b", "completion", "verdict",
            "expected_verdict", "swapped", "pair_id", "sample_language", "group", "gold"]
    return records.select(*[x for x in cols if x in records.columns] +
                          [x for x in ("seed", "benchmark") if x in records.columns])


def parsed_projection(records: DataFrame) -> DataFrame:
    cols = ["id", "language", "verdict", "expected_verdict", "correct", "swapped",
            "pair_id", "sample_language", "group"]
    return records.select(*[x for x in cols if x in records.columns] +
                          [x for x in ("seed", "benchmark") if x in records.columns])


# --------------------------------------------------------------------------- E3
def parsed_from_raw(raw: DataFrame, group_cols=("seed", "benchmark", "language")) -> DataFrame:
    """Recompute ``correct`` where absent; a group with any undecidable row
    (no ``correct`` and no expected verdict) is reported as not parsed."""
    group_cols = list(group_cols)
    has_correct = "correct" in raw.columns
    corr = F.col("correct") if has_correct else F.lit(None).cast("boolean")
    derived = F.when(F.col("expected_verdict").isNotNull(),
                     F.col("verdict").eqNullSafe(F.col("expected_verdict")))
    x = raw.withColumn("correct", F.coalesce(corr, derived))
    ok = x.groupBy(*group_cols).agg(F.bool_and(F.col("correct").isNotNull()).alias("_ok"))
    x = x.join(ok.filter("_ok").drop("_ok"), on=group_cols, how="left_semi")
    keep = [k for k in ("id", "language", "verdict", "expected_verdict", "correct", "swapped",
                        "pair_id", "group", "seed", "benchmark") if k in x.columns]
    return x.select(*keep)


# --------------------------------------------------------------------------- E4
def missing_groups(expected: DataFrame, parsed: DataFrame | None, raw: DataFrame | None,
                   keys=("benchmark", "language")) -> DataFrame:
    """(benchmark, language) groups still to run: expected minus found; a
    group is found in the parsed results, else in raw results from which
    every row can be decided (E3)."""
    keys = list(keys)
    found = None
    if raw is not None:
        raw = parsed_from_raw(raw, group_cols=keys)
    for src in (parsed, raw):
        if src is not None:
            g = src.select(*keys).distinct()
            found = g if found is None else found.unionByName(g).distinct()
    exp = expected.select(*keys).distinct()
    return exp if found is None else exp.join(found, on=keys, how="left_anti")


# --------------------------------------------------------------------------- E5
def accuracy(records: DataFrame, by=("seed",), bias_benchmarks=()) -> DataFrame:
    """total / correct / accuracy per (benchmark, language), per benchmark
    (row-weighted, language ``_overall``) and overall (benchmark ``_overall``).

    One rollup pass; the overall level leaves out the pair-bias benchmarks
    by conditional sums instead of a second scan."""
    by = list(by)
    inov = ~F.col("benchmark").isin(*bias_benchmarks) if bias_benchmarks else F.lit(True)
    x = records.select(*by, "benchmark", "language",
                       F.col("correct").cast("boolean").alias("_ok"), inov.alias("_inov"))
    g = x.rollup(*by, "benchmark", "language").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("_ok"), 1)).alias("_k"),
        F.count(F.when(F.col("_inov"), 1)).alias("_n_ov"),
        F.count(F.when(F.col("_ok") & F.col("_inov"), 1)).alias("_k_ov"),
        F.grouping_id().alias("_gid"))
    nb = len(by)
    # grouping_id bits: by..., benchmark, language (language is bit 0)
    lvl_lang, lvl_bench, lvl_all = 0, 1, 3
    keep = F.col("_gid").isin(lvl_lang, lvl_bench, lvl_all)
    g = g.filter(keep)
    is_all = F.col("_gid") == lvl_all
    total = F.when(is_all, F.col("_n_ov")).otherwise(F.col("_n"))
    correct = F.when(is_all, F.col("_k_ov")).otherwise(F.col("_k"))
    del nb
    return g.select(
        *by,
        F.when(is_all, F.lit(OVERALL)).otherwise(F.col("benchmark")).alias("benchmark"),
        F.when(F.col("_gid") == lvl_lang, F.col("language")).otherwise(F.lit(OVERALL)).alias("language"),
        total.cast("long").alias("total"), correct.cast("long").alias("correct"),
        F.coalesce(F.try_divide(correct.cast("double"), total.cast("double")), F.lit(0.0)).alias("accuracy"))


def accuracy_from_totals(t: DataFrame, by=("seed",)) -> DataFrame:
    """E5 levels from pre-counted (group, total, correct) rows (streaming totals)."""
    by = list(by)
    g = t.rollup(*by, "benchmark", "language").agg(
        F.sum("total").alias("_n"), F.sum("correct").alias("_k"), F.grouping_id().alias("_gid"))
    g = g.filter(F.col("_gid").isin(0, 1, 3))
    return g.select(
        *by,
        F.when(F.col("_gid") == 3, F.lit(OVERALL)).otherwise(F.col("benchmark")).alias("benchmark"),
        F.when(F.col("_gid") == 0, F.col("language")).otherwise(F.lit(OVERALL)).alias("language"),
        F.col("_n").cast("long").alias("total"), F.col("_k").cast("long").alias("correct"),
        F.coalesce(F.try_divide(F.col("_k").cast("double"), F.col("_n").cast("double")), F.lit(0.0))
         .alias("accuracy"))


# --------------------------------------------------------------------------- E6
SMALL_MEAN = 30.0         # Poisson draws up to this mean are inverted exactly
# Coefficients of Acklam's rational inverse of the normal CDF.
NORMAL_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
NORMAL_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
NORMAL_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
NORMAL_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out


def inverse_normal(u: Column) -> Column:
    """z with P(Z < z) = u, for u strictly between 0 and 1."""
    def tail(p):
        q = F.sqrt(F.lit(-2.0) * F.log(p))
        return _horner(NORMAL_C, q) / (_horner(NORMAL_D, q) * q + 1.0)
    q = u - 0.5
    r = q * q
    middle = _horner(NORMAL_A, r) * q / (_horner(NORMAL_B, r) * r + 1.0)
    return F.when(u < 0.02425, tail(u)).when(u > 1 - 0.02425, -tail(F.lit(1.0) - u)).otherwise(middle)


def poisson_draw(mean: Column, u: Column) -> Column:
    """A Poisson draw from a uniform: the CDF is inverted term by term for
    small means; larger ones use the normal deviate with its skewness term,
    which is within a count of the inverse."""
    steps = F.sequence(F.lit(1), F.lit(120))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"), mean.alias("m"), u.alias("u"))
    walked = F.aggregate(steps, start, lambda a, j: F.struct(
        (a["p"] * a["m"] / j).alias("p"), (a["cdf"] + a["p"] * a["m"] / j).alias("cdf"),
        (a["n"] + (a["cdf"] <= a["u"]).cast("int")).alias("n"), a["m"].alias("m"), a["u"].alias("u")))
    z = inverse_normal(u)
    large = F.greatest(F.floor(mean + z * F.sqrt(mean) + (z * z - 1) / 6 + 0.5), F.lit(0))
    return F.when(mean <= SMALL_MEAN, walked["n"].cast("long")).otherwise(large.cast("long"))


def bootstrap_ci(df: DataFrame, samples: int, confidence: float, seed: int,
                 group_cols=("seed", "benchmark", "language"), value: str = "correct") -> DataFrame:
    """Percentile interval of the mean of a 0/1 column by Poisson bootstrap.

    Each row of a replicate has a Poisson(1) weight; the weights of k rows sum
    to a Poisson(k). So the rows are only counted (k right, n - k wrong per
    group, a partial aggregate), and each of the groups x replicates rows
    draws two sums, from hashes of (seed, replicate, group). The work after the
    count does not grow with the data. low = sorted[int(a*B)],
    high = sorted[int((1-a)*B) - 1], a = (1-confidence)/2, clamped.
    """
    if not 0.0 < confidence < 1.0:
        raise ValueError(f"no interval at confidence {confidence}: it lies strictly between 0 and 1")
    group_cols = list(group_cols)
    if samples <= 0:
        return df.select(*group_cols).distinct().withColumn("ci_low", F.lit(None).cast("double")) \
                 .withColumn("ci_high", F.lit(None).cast("double"))
    n = df.groupBy(*group_cols).agg(F.count(value).alias("_n"), F.count_if(F.col(value).cast("boolean")).alias("_k"))
    x = n.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def uniform(side):
        return (h32(F.lit(seed), F.col("_rep"), F.lit(side), *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group_cols])
                + 0.5) / F.lit(4294967296.0)

    x = x.withColumn("_u1", uniform("right")).withColumn("_u0", uniform("wrong"))
    x = x.withColumn("_sv", poisson_draw(F.col("_k").cast("double"), F.col("_u1"))) \
         .withColumn("_sw", F.col("_sv") + poisson_draw((F.col("_n") - F.col("_k")).cast("double"), F.col("_u0")))
    reps = x.withColumn("_m", F.coalesce(F.try_divide(F.col("_sv").cast("double"), F.col("_sw").cast("double")), F.lit(0.0)))
    alpha = (1.0 - confidence) / 2.0
    lo = max(0, min(int(alpha * samples), samples - 1))
    hi = max(0, min(int((1.0 - alpha) * samples) - 1, samples - 1))
    w = Window.partitionBy(*group_cols).orderBy("_m", "_rep")
    ranked = reps.withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r").isin(lo, hi))
    return ranked.groupBy(*group_cols).agg(
        F.max(F.when(F.col("_r") == lo, F.col("_m"))).alias("ci_low"),
        F.max(F.when(F.col("_r") == hi, F.col("_m"))).alias("ci_high"))


# --------------------------------------------------------------------------- E7
def seed_statistics(df: DataFrame, group_cols=("benchmark", "language"), value: str = "accuracy",
                    seed: str = "seed", total: str | None = "total", digits: int = 4) -> DataFrame:
    """Across seeds: mean, sample std (0 for one seed), values in seed order,
    ``mean ± std`` text and the total of the first seed."""
    group_cols = list(group_cols)
    aggs = [F.avg(value).alias("mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
            F.count(F.lit(1)).alias("n_seeds"),
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(seed).alias("s"), F.col(value).alias("v")))),
                        lambda e: e["v"]).alias("values")]
    if total:
        aggs.append(F.min_by(total, seed).alias("first_total"))
    out = df.groupBy(*group_cols).agg(*aggs)
    return out.withColumn("formatted", F.format_string(f"%.{digits}f ± %.{digits}f", "mean", "std"))


# --------------------------------------------------------------------------- E8
def _betacf(a, b, x):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    cc, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        cc = 1.0 + aa / cc if abs(1.0 + aa / cc) > 1e-300 else 1e-300
        h *= d * cc
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        cc = 1.0 + aa / cc if abs(1.0 + aa / cc) > 1e-300 else 1e-300
        dl = d * cc
        h *= dl
        if abs(dl - 1.0) < 3e-16:
            break
    return h


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p of Student's t: I_{dof/(dof+t^2)}(dof/2, 1/2)."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, max(0.0, front * _betacf(a, b, x) / a))
    return min(1.0, max(0.0, 1.0 - front * _betacf(b, a, 1.0 - x) / b))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) if a is not None and b is not None else float("nan")
                      for a, b in zip(t.astype("float64"), dof.astype("float64"))])


def paired_ttest(a: DataFrame, b: DataFrame, keys=("benchmark",), pair_key: str = "seed",
                 value: str = "accuracy", alpha: float = 0.05) -> DataFrame:
    """Paired t-test of two runs on their shared seeds, per key group.

    null/NaN pairs dropped; n < 2 -> NaN; zero spread -> t = inf, p = 0 when
    the mean difference is non-zero, else t = 0, p = 1. The p-value is the
    only Python step and runs on one row per group."""
    keys = list(keys)
    j = (a.select(*keys, pair_key, F.col(value).alias("_a"))
          .join(b.select(*keys, pair_key, F.col(value).alias("_b")), on=[*keys, pair_key], how="inner")
          .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.isnan("_a") & ~F.isnan("_b")))
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                             F.avg(F.col("_a") - F.col("_b")).alias("mean_diff"),
                             F.stddev_samp(F.col("_a") - F.col("_b")).alias("_sd"))
    nan = F.lit(float("nan"))
    t = (F.when(F.col("n") < 2, nan)
          .when(F.col("_sd") == 0, F.when(F.col("mean_diff") != 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
          .otherwise(F.col("mean_diff") / (F.col("_sd") / F.sqrt(F.col("n").cast("double")))))
    g = g.withColumn("t_stat", t)
    p = (F.when(F.col("n") < 2, nan)
          .when(F.col("_sd") == 0, F.when(F.col("mean_diff") != 0, F.lit(0.0)).otherwise(F.lit(1.0)))
          .otherwise(t_pvalue(F.col("t_stat"), (F.col("n") - 1).cast("double"))))
    return (g.withColumn("p_value", p)
             .withColumn("significant", F.col("p_value") < F.lit(alpha))
             .drop("_sd"))


# --------------------------------------------------------------------------- E9
def bias_severity(df: DataFrame, by=("seed",), group_col: str = "group",
                  language_col: str = "sample_language", fallback_language: str = "language") -> DataFrame:
    """Pair classes over order-swapped pairs, overall / by group / by language.

    A pair (``pair_id`` else ``id``) counts when it has exactly two rows:
    both correct -> human win, both wrong -> machine win, a null verdict
    only adds to the total. severity = machine / (human + machine), 0 if none.
    Pairs are formed inside each scope. Rows are projected and expanded to
    the three scopes, then aggregated per (scope, pair) and per scope: two
    partial-aggregated shuffles, no pair is ever shipped whole."""
    by = list(by)
    pair = F.coalesce(F.col("pair_id").cast("string") if "pair_id" in df.columns else F.lit(None),
                      F.col("id").cast("string"))
    lang = F.coalesce(c(language_col) if language_col in df.columns else F.lit(None),
                      c(fallback_language))
    grp = c(group_col) if group_col in df.columns else F.lit(None).cast("string")
    scopes = F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit(OVERALL).alias("key")),
        F.struct(F.lit("group").alias("scope"), grp.cast("string").alias("key")),
        F.struct(F.lit("language").alias("scope"), lang.cast("string").alias("key")))
    x = (df.select(*by, pair.alias("_pair"), F.col("verdict"), F.col("correct"),
                   F.explode(scopes).alias("_s"))
           .filter(F.col("_pair").isNotNull() & (F.col("_pair") != "") & F.col("_s.key").isNotNull())
           .select(*by, F.col("_s.scope").alias("scope"), F.col("_s.key").alias("key"), "_pair",
                   F.col("verdict").isNull().alias("_nv"), F.coalesce(F.col("correct"), F.lit(False)).alias("_ok")))
    per_pair = x.groupBy(*by, "scope", "key", "_pair").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.col("_nv").cast("int")).alias("_anynull"),
        F.min(F.col("_ok").cast("int")).alias("_all"), F.max(F.col("_ok").cast("int")).alias("_any"))
    two = F.col("_rows") == 2
    clean = two & (F.col("_anynull") == 0)
    out = per_pair.groupBy(*by, "scope", "key").agg(
        F.count(F.when(two, 1)).alias("total_pairs"),
        F.count(F.when(clean & (F.col("_all") == 1), 1)).alias("consistent_human_win"),
        F.count(F.when(clean & (F.col("_any") == 0), 1)).alias("consistent_machine_win"))
    denom = F.col("consistent_human_win") + F.col("consistent_machine_win")
    return out.withColumn("bias_severity", F.when(denom > 0, F.col("consistent_machine_win") / denom)
                          .otherwise(F.lit(0.0)))


# --------------------------------------------------------------------------- E10
def bias_seed_statistics(bias: DataFrame, seed: str = "seed") -> DataFrame:
    """E7 over seeds for the three bias measures, long format."""
    measures = ["bias_severity", "consistent_human_win", "consistent_machine_win"]
    long = bias.select(seed, "scope", "key", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures
    ])).alias("_m")).select(seed, "scope", "key", "_m.measure", "_m.value")
    return seed_statistics(long, group_cols=("scope", "key", "measure"), value="value",
                           seed=seed, total=None)


# --------------------------------------------------------------------------- E11
LEAST_SEEDS = 3           # fewer give no spread worth reporting


def expand_seeds(base: int | None = 42, n: int = 3, step: int = 1, explicit=None) -> list[int]:
    """The seeds of a run: the listed ones (each once, in the order given) or
    an arithmetic row from ``base``. Too few are refused."""
    wanted = explicit or range(n)
    first = 0 if base is None else int(base)
    seeds = {int(s) if explicit else first + step * s: None for s in wanted}
    if len(seeds) < LEAST_SEEDS:
        raise ValueError(f"{len(seeds)} distinct seeds given, a seed study needs {LEAST_SEEDS} or more")
    return list(seeds)


def with_seeds(df: DataFrame, seeds: list[int], name: str = "seed") -> DataFrame:
    """One row per (input row, seed): a literal explode, so all seeds run as one job."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


# --------------------------------------------------------------------------- E12 / E13
def report(acc: DataFrame, bias: DataFrame | None = None) -> dict:
    """Ordered result tables (DataFrames, no console drawing)."""
    out = {
        "by_language": acc.filter(F.col("language") != OVERALL).orderBy("benchmark", "language", *[
            x for x in acc.columns if x == "seed"]),
        "by_benchmark": acc.filter((F.col("language") == OVERALL)).orderBy("benchmark"),
    }
    if bias is not None:
        out["bias_by_group"] = bias.filter(F.col("scope") == "group").orderBy("key")
        out["bias_by_language"] = bias.filter(F.col("scope") == "language").orderBy("key")
    return out


def report_table(acc: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """E12 as one long table: section, benchmark/scope, language/key, seed, value columns."""
    parts = [acc.select(F.when(F.col("language") == OVERALL, F.lit("by_benchmark")).otherwise(F.lit("by_language"))
                        .alias("section"), "seed", F.col("benchmark").alias("name"), F.col("language").alias("key"),
                        F.col("total").alias("count"), F.col("accuracy").alias("value"))]
    if bias is not None:
        parts.append(bias.select(F.concat(F.lit("bias_by_"), F.col("scope")).alias("section"), "seed",
                                 F.lit("judgment-requests").alias("name"), "key",
                                 F.col("total_pairs").alias("count"), F.col("bias_severity").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "name", "key", "seed")


def compare_runs(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Paired t-test per benchmark on shared seeds, only benchmarks that have
    an ``_overall`` row in both runs."""
    fa = a.filter(F.col("language") == OVERALL)
    fb = b.filter(F.col("language") == OVERALL)
    return paired_ttest(fa, fb, keys=("benchmark",), pair_key="seed", value="accuracy", alpha=alpha)
