"""File sources (S ops): parquet shards, JSON lines, judgment-request
folders, language folders and per-seed summaries.

Paths may be local or any Hadoop file system; listing goes through Spark
readers (``binaryFile`` without content, ``_metadata.file_path``) so it runs
on the cluster, not in a driver loop over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefeval.operators.clean import parse_request_filename, parse_user_content  # noqa: F401

# File names that mark a language folder of a benchmark.
LANGUAGE_MARKERS = ["filtered.json", "raw.json"]
LANGUAGE_MARKER_GLOB = "test-*.parquet"
EXCLUDED_DIRS = ["translation"]

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                     T.StructField("content", T.StringType())]))
REQUEST_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("body", T.StructType([T.StructField("messages", MESSAGES)])),
])


def read_preferences(spark: SparkSession, root: str) -> DataFrame:
    """S1: every ``data/train-*.parquet`` under root; none found is an error."""
    return spark.read.parquet(f"{root.rstrip('/')}/data/train-*.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, bad: str = "fail"):
    """S2: JSON lines with a schema. Blank lines are skipped by the reader.
    ``bad='fail'`` fails the job on a malformed line; ``bad='skip'`` drops
    it and counts it through an ``Observation`` (no extra pass).
    Returns (rows, observation or None)."""
    if bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), None
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(full).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    obs = Observation("jsonl")
    flagged = raw.withColumn("_bad", F.col("_corrupt_record").isNotNull())
    counted = flagged.observe(obs, F.count(F.when(F.col("_bad"), 1)).alias("malformed"),
                              F.count(F.lit(1)).alias("lines"))
    return counted.filter(~F.col("_bad")).drop("_bad", "_corrupt_record"), obs


def _depth(root: str) -> int:
    """Number of path segments of root once the scheme is removed."""
    import re
    return len([p for p in re.sub(r"^[a-z0-9]+:(//)?", "", root).split("/") if p])


def read_judgment_requests(spark: SparkSession, root: str, datasets: list[str] | None = None,
                           on_error: str = "raise") -> DataFrame:
    """S3: one folder per dataset, request files below it. The dataset is
    the folder name, the request file name gives the fallback group and
    language (P9); the first ``user`` message is the content. A requested
    dataset that is absent, or a request without user message, fails the
    job inside the plan (``raise_error``)."""
    df = (spark.read.schema(REQUEST_SCHEMA).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.json*").json(root)
          .withColumn("_path", F.col("_metadata.file_path")))
    root_depth = _depth(root)
    parts = F.split(F.regexp_replace(F.col("_path"), r"^[a-z0-9]+:(//)?", ""), "/")
    clean = F.filter(parts, lambda p: p != "")
    dataset = F.regexp_replace(F.element_at(clean, root_depth + 1), r"^[^=]*=", "")
    # the request file: the path segment right under the dataset folder
    fname = F.regexp_replace(F.element_at(clean, root_depth + 2), r"^[^=]*=", "")
    user = F.element_at(F.filter("body.messages", lambda m: m["role"] == "user"), 1)
    out = df.select("custom_id", dataset.alias("dataset"), fname.alias("file_name"),
                    user["content"].alias("content"))
    if on_error == "raise":
        out = out.withColumn("content", F.when(F.col("content").isNotNull(), F.col("content")).otherwise(
            F.raise_error(F.concat(F.lit("no message of role user, file "), F.col("file_name")))))
    if datasets:
        want = spark.createDataFrame([(d,) for d in datasets], "dataset string")
        missing = want.join(out.select("dataset").distinct(), "dataset", "left_anti")
        n_missing = missing.agg(F.count(F.lit(1))).scalar()
        out = out.filter(F.col("dataset").isin(*datasets)).withColumn(
            "dataset", F.when(n_missing == 0, F.col("dataset")).otherwise(
                F.raise_error(F.lit("a requested dataset has no folder"))))
    return out


def available_languages(spark: SparkSession, root: str) -> DataFrame:
    """S4: language folders (direct children of root) that hold
    ``filtered.json``, ``raw.json`` or ``test-*.parquet``; hidden folders and
    ``translation`` are left out; sorted. Listing uses ``binaryFile``
    without reading file contents."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path"))
    root_depth = _depth(root)
    parts = F.filter(F.split(F.regexp_replace("path", r"^[a-z0-9]+:(//)?", ""), "/"), lambda p: p != "")
    lang = F.element_at(parts, root_depth + 1)
    name = F.element_at(parts, -1)
    marked = name.isin(*LANGUAGE_MARKERS) | name.like(LANGUAGE_MARKER_GLOB.replace("*", "%"))
    direct = F.size(parts) == root_depth + 2
    return (files.select(lang.alias("language"), marked.alias("_m"), direct.alias("_d"))
                 .filter(F.col("_m") & F.col("_d") & ~F.col("language").startswith(".")
                         & ~F.col("language").isin(*EXCLUDED_DIRS))
                 .select("language").distinct().orderBy("language"))


def read_seed_results(spark: SparkSession, folder: str, seeds: list[int],
                      schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """S5: per-seed summaries under ``seed_<n>/`` or ``seed=<n>/`` with the
    seed taken from the path, and the requested seeds that have no summary
    (``left_anti``)."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(folder)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"/seed[_=](\d+)/", 1)
    rows = df.drop("seed").withColumn("seed", F.nullif(seed, F.lit("")).cast("int")).filter(F.col("seed").isNotNull())
    want = spark.createDataFrame([(int(s),) for s in seeds], "seed int")
    missing = want.join(rows.select("seed").distinct(), "seed", "left_anti")
    return rows, missing
