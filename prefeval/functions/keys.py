"""Row keys and seeded hashing.

The reference aligns tables by list position and draws randomness from one
RNG in row order. Here every row carries an explicit key and every draw is a
hash of (seed, key), so results do not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefeval.session import materialize


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def h32(*parts) -> Column:
    """Integer of the first 8 hex digits of md5 of the '|'-joined parts.

    Same value as DuckDB ``('0x'||substr(md5(x),1,8))::BIGINT``.
    """
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts]) if len(parts) > 1 \
        else _c(parts[0]).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def dense_index(df: DataFrame, partition_by: list, order_by: list, name: str = "rn",
                weight: str | None = None) -> DataFrame:
    """Add the exact 0-based position of each row inside its group (with
    ``weight``: the sum of the weights of all earlier rows, a running count).

    A plain ``row_number() over (partition by g order by o)`` sends a whole
    group to one task; with one language holding most rows that task is the
    job. Here rows are range-partitioned by (group, order), so a hot group or
    a cluster of close values spreads over as many partitions as it fills and
    an outlier takes no room; the partition number is written down with the
    rows, once, to the shared folder. Rows are then numbered per (group,
    partition), and a small table of per-(group, partition) counts, turned
    into running offsets, makes the local numbers global. It is joined by
    shuffle; AQE may broadcast it after measuring.

    ``order_by`` must be unique inside a group (add a tie-break key). Pass key
    columns only and join wide columns back."""
    g = list(partition_by)
    bound = df.repartitionByRange(*g, *order_by).withColumn("_part", F.spark_partition_id())
    x = materialize(bound, "ranked")
    one = F.col(weight) if weight else F.lit(1)
    w = Window.partitionBy(*g, "_part").orderBy(*order_by)
    if weight:
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = x.withColumn("_local", F.sum(one).over(run) - one)
    else:
        numbered = x.withColumn("_local", F.row_number().over(w) - 1)
    counts = x.groupBy(*g, "_part").agg(F.sum(one).alias("_cnt"))
    before = Window.partitionBy(*(g or [F.lit(0)])).orderBy("_part")   # one row per partition of a group
    offsets = counts.withColumn("_offset", F.sum("_cnt").over(before) - F.col("_cnt")).drop("_cnt")
    keys = [F.expr(f"`{k}` <=> `_k_{k}`") for k in [*g, "_part"]]      # a null group is a group
    for k in [*g, "_part"]:
        offsets = offsets.withColumnRenamed(k, f"_k_{k}")
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    out = numbered.join(offsets, on, "inner").drop(*[f"_k_{k}" for k in [*g, "_part"]])
    return out.withColumn(name, F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset")
