"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefeval.session import materialize  # noqa: F401  (re-used by every operator)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_cache(name: str, make):
    """One object per Python worker process, kept between its tasks until a
    task asks for another: workers are reused by later operators, and what an
    earlier one memoised must not add up.

    Holds only rebuildable things (a loaded vocabulary, memoised words), so a
    lost executor costs time and never results."""
    worker = sys.modules.setdefault("_prefeval_worker", types.ModuleType("_prefeval_worker"))
    if getattr(worker, "name", None) != name:
        worker.held = None
        give_back()
        worker.name, worker.held = name, make()
    return worker.held


def give_back() -> None:
    """Return what this worker has freed to the system: a reused worker would
    keep the pages of an earlier operator's words beside those of its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):       # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def worker_release() -> None:
    """Drop what an earlier operator left in this worker."""
    worker_cache("", lambda: None)


@contextlib.contextmanager
def no_cycles():
    """No cycle collection while a task runs over large word caches: they hold
    no cycles, and every collection would walk them whole."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def as_bytes(col: pa.Array) -> list:
    """UTF-8 bytes of a string column, null as b''."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b or b"" for b in col.cast(kind).to_pylist()]


def as_text(col: pa.Array) -> list:
    """Strings of a column, null as ''."""
    return [t or "" for t in col.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 512):
    """Cut an Arrow batch into runs of at most ``rows`` rows, so that what a
    task holds besides the batch stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fold_of(key, parts: int) -> Column:
    """crc32 of the key's decimal text modulo ``parts`` (null key: of '')."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def below(key, seed: int, limit: int, total):
    """About four times ``limit`` of ``total`` keys, by a hash: what is ranked
    for a bounded sample stays as small, however many tasks there are."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << 31)).cast("double") * total < F.lit(4.0 * limit * (1 << 31))


def sample_ids(rows: DataFrame, limit: int, seed: int, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` distinct, non-null keys by a hash: the documented
    training bound of the classifiers, small enough to broadcast."""
    ids = rows.select(key).filter(F.col(key).isNotNull())
    few = ids.filter(below(key, seed, limit, ids.agg(F.count(F.lit(1))).scalar())).distinct()
    return F.broadcast(few.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(limit))


def bounded_rows(df: DataFrame, key: str, by: str, limit: int, seed: int = 17) -> DataFrame:
    """At most ``limit`` rows per value of ``by``, one per key, by a hash of the
    key. Keys are ranked alone; whole rows are joined to the chosen keys."""
    from pyspark.sql import Window
    keys = df.select(key, by).filter(F.col(key).isNotNull())
    totals = keys.groupBy(by).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.map_from_entries(F.collect_list(F.struct(by, "n")))).scalar()
    few = keys.filter(below(key, seed, limit, F.element_at(totals, F.col(by)))).distinct()
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    few = few.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")
    return df.join(F.broadcast(few), [key, by]).dropDuplicates([key, by])     # limit rows per value


def sorted_groups(batches, keys: list):
    """Runs of equal ``keys`` (never null) out of batches sorted by them, each
    as one Arrow table; a run may span batches."""
    import numpy as np
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 2:
            continue
        cols = [held.column(k).to_numpy() for k in keys]
        new = np.zeros(held.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        flat = held.combine_chunks()
        for a, b in zip(cuts, cuts[1:]):
            yield flat.slice(a, b - a)
        held = flat.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def list_matrix(col) -> "np.ndarray":  # noqa: F821
    """A column of equally long float lists as a matrix."""
    import numpy as np
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat).reshape(len(col), -1) if len(col) else np.empty((0, 0))
