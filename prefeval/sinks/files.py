"""Sinks (K ops): JSON lines per group, proxy cache lines, in-place replace
after success, prompt logs and nested summaries.

Writers are ordinary DataFrame writers; the only file-system calls (rename,
delete of a staging folder) go through the Hadoop FileSystem of the path, so
they work on any shared storage the cluster uses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The fields of a raw and of a parsed result line.
RAW_FIELDS = ("id", "seed", "language", "prompt", "answer_a", "answer_b", "completion", "verdict", "expected_verdict",
              "swapped", "pair_id", "sample_language", "group", "gold")
PARSED_FIELDS = ("id", "seed", "language", "verdict", "expected_verdict", "correct", "swapped", "pair_id",
                 "sample_language", "group")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_jsonl(df: DataFrame, path: str, by=("benchmark", "language")) -> None:
    """K1: UTF-8 JSON lines in one folder per (benchmark, language). Dynamic
    partition overwrite replaces only the groups present in ``df``, so a
    resumed run writes just its new groups."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*by).json(path))


def write_results(records: DataFrame, folder: str, by=("benchmark", "language")) -> None:
    """K1, both kinds: ``<folder>/kind=raw`` holds every field of a judged row,
    ``<folder>/kind=parsed`` the verdict fields, each in one folder per group.
    The records are read once: each becomes two rows of JSON text."""
    both = records.select(*by, F.explode(F.array(
        F.struct(F.lit("raw").alias("kind"), F.to_json(F.struct(*_fields(records, RAW_FIELDS, by))).alias("value")),
        F.struct(F.lit("parsed").alias("kind"), F.to_json(F.struct(*_fields(records, PARSED_FIELDS, by))).alias("value"))
    )).alias("_r")).select(*by, "_r.kind", "_r.value")
    (both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", *by).text(folder))


def _fields(df: DataFrame, names: tuple, without) -> list:
    return [n for n in names if n in df.columns and n not in without]


def write_proxy_cache(df: DataFrame, path: str, key: str = "row_id") -> None:
    """K2: one JSON line per input row keyed by row id; missing (null)
    metrics are left out of the line."""
    df.select(key, *[c for c in df.columns if c.startswith("proxy_")]) \
      .write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def _renamed(fs, src, dst) -> None:
    if not fs.rename(src, dst):
        raise OSError(f"could not move {src} to {dst}")


def replace_dataset(df: DataFrame, path: str, fmt: str = "parquet", move=_renamed) -> None:
    """K3: rewrite ``path`` only after the new data is fully written: write to
    a staging folder next to it, then swap by two moves, each checked. If the
    second fails the old data is moved back; it is deleted last. A failed job
    or move leaves the old dataset at ``path``."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex[:8]
    staging = f"{path.rstrip('/')}.staging-{tag}"
    df.write.mode("overwrite").format(fmt).save(staging)
    fs, target = _fs(spark, path)
    _, stage = _fs(spark, staging)
    if not fs.exists(target):
        move(fs, stage, target)
        return
    _, backup = _fs(spark, f"{path.rstrip('/')}.old-{tag}")
    move(fs, target, backup)
    try:
        move(fs, stage, target)
    except Exception:
        _renamed(fs, backup, target)
        raise
    fs.delete(backup, True)


def write_named_shards(df: DataFrame, folder: str, prefix: str = "train", fmt: str = "parquet") -> list[str]:
    """Write ``df`` and give its part files reference-style names
    ``<prefix>-00000-of-0000N.<fmt>`` (what S1 reads). Renames are metadata
    operations on the listed part files (one per task)."""
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").format(fmt).save(staging)
    fs, stage = _fs(spark, staging)
    parts = sorted(str(st.getPath().toString()) for st in fs.listStatus(stage)
                   if st.getPath().getName().startswith("part-"))
    names = []
    jvm = spark.sparkContext._jvm
    for i, src in enumerate(parts):
        name = f"{folder.rstrip('/')}/{prefix}-{i:05d}-of-{len(parts):05d}.{fmt}"
        fs.rename(jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(name))
        names.append(name)
    fs.delete(stage, True)
    return names


def write_prompt_log(df: DataFrame, path: str, idx: str = "idx", text: str = "prompt") -> None:
    """K4: (idx, prompt) lines for audit."""
    df.select(idx, text).write.mode("overwrite").json(path)


def summary_json(acc: DataFrame, seed: str = "seed") -> DataFrame:
    """K5: one nested JSON document per seed:
    {"seed": s, "benchmarks": {bench: {lang: {total, correct, accuracy}}}}.
    Built with ``map_from_entries`` over two grouping levels; the result is one
    small row per seed."""
    per_lang = acc.groupBy(seed, "benchmark").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("language"), F.struct("total", "correct", "accuracy")))).alias("langs"))
    per_seed = per_lang.groupBy(seed).agg(
        F.map_from_entries(F.collect_list(F.struct("benchmark", "langs"))).alias("benchmarks"))
    return per_seed.select(seed, F.to_json(F.struct(F.col(seed).alias("seed"), "benchmarks")).alias("json"))


def write_summary(acc: DataFrame, folder: str, seed: str = "seed") -> None:
    """K5 writer: ``<folder>/seed=<n>/`` holds that seed's JSON document (one
    line). Documents are tiny: one task per seed folder."""
    doc = summary_json(acc, seed)
    doc.repartition(seed).write.mode("overwrite").partitionBy(seed).text(folder)


def aggregate_json(stats: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """K5 over all seeds: one document
    {"benchmarks": {bench: {lang: {mean, std, formatted}}}, "paired_t_tests": {name: {...}}}.
    ``stats``: benchmark, language, mean, std, formatted (E7); ``tests``: benchmark
    and the t-test columns (E8, E13), named ``<benchmark>.accuracy``. Both are
    one row per group, far below any row count of the data."""
    per_bench = stats.groupBy("benchmark").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("language"), F.struct("mean", "std", "formatted").alias("v")))).alias("langs"))
    doc = per_bench.agg(F.map_from_entries(F.collect_list(F.struct("benchmark", "langs"))).alias("benchmarks"))
    if tests is None:
        return doc.select(F.to_json(F.struct("benchmarks")).alias("json"))
    values = [n for n in tests.columns if n != "benchmark"]
    t = tests.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat("benchmark", F.lit(".accuracy")).alias("k"), F.struct(*values).alias("v")))).alias("paired_t_tests"))
    return doc.join(t, F.lit(True)).select(F.to_json(F.struct("benchmarks", "paired_t_tests")).alias("json"))
