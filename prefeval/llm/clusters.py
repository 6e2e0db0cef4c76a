"""Integer k-means with centroids filtered by an n-simplex projection.

Pivots are the origin and the first centroids, farthest first. The distances
between them fix a base simplex; the distances of a vector to them fix its
apex over that simplex: one coordinate a pivot, the last one the height, which
is never negative. The distance of two apexes is a lower bound of the distance
of their vectors, and with one height turned over it is an upper bound. The
vectors' distances to the pivots are computed once and stored with them; a
round only projects the centroids and compares apexes. A centroid whose lower
bound exceeds the least upper bound of the row is left out; the others are
compared exactly, in integers. The bounds of a centroid are the closer, the
lower it stands over the pivots: at first it is one of them. As the first
round moves centroids most, its result joins the pivots (``anew``); from then
on centroids stay near the pivots' span.

Apexes are floating point. Bounds are widened by ``SLACK`` times the scale of
the row, some orders above their error, and pivots that would make the simplex
thin are not taken, so the filter never leaves out the nearest centroid.

Each task adds up its vectors per cluster; sums are merged in ``LANES`` groups
a cluster, and only those go to the driver, which keeps k centroids.

Components are floor(scale * x) with Python integers where they, or sums of
their squares, could pass the range of exact int64 arithmetic, so any finite
value counts as it is. A distance or inertia beyond 2^63 - 1 is null.

Edge cases: vectors that are null, of another length than ``dims`` or hold
null or non-finite components are dropped; fewer vectors than ``k`` give as
many centroids; equal starting vectors are centroids of their own (the later
stay empty); repeated rows are vectors of their own; ties of the starting
hash, possible among repeated ids only, go to the lesser vector; a null id
hashes as the empty id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import list_matrix, materialize, slices

SAFE = 1 << 26            # up to here 64-bit sums of 256 squared differences are exact
SLACK = 1e-5
LANES = 16


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64 where it is small, else as Python integers."""
    with np.errstate(over="ignore"):
        q = np.floor(x.astype(np.float64) * scale)
    if not q.size or (np.abs(q) <= SAFE).all():
        return q.astype(np.int64)
    exact = lambda v, f: int(f) if np.isfinite(f) else (lambda n, d: n * scale // d)(*float(v).as_integer_ratio())
    return np.array([[exact(v, f) for v, f in zip(r, s)] for r, s in zip(x.tolist(), q.tolist())], object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the vector ``b``."""
    if a.shape[1] > 256 or a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=1)


def integers(rows: list) -> np.ndarray:
    """Centroids as int64 if exact arithmetic allows it, else as objects."""
    out = np.array(rows, object)
    return out.astype(np.int64) if not out.size or max(abs(c) for c in out.ravel()) <= SAFE else out


def distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) distances in floating point."""
    out = np.empty((len(a), len(pivots)))
    for k, p in enumerate(pivots):
        d = squared(a, p)
        out[:, k] = np.sqrt(d.astype(np.float64)) if d.dtype != object else [_root(v) for v in d]
    return out


def _root(v: int) -> float:
    """Square root of an integer of any size, inf beyond a double's range."""
    try:
        return float(math.isqrt(v)) if v >= 1 << 100 else math.sqrt(v)
    except OverflowError:
        return math.inf


class Simplex:
    """Base simplex over the pivots' distances.

    With the first pivot at the origin, the k-th has k - 1 coordinates and a
    height; ``lower`` holds them as a triangular matrix."""

    def __init__(self, between: np.ndarray):
        n = len(between)
        self.lower = np.zeros((n - 1, n - 1))
        for k in range(1, n):
            apex = self.project(between[k:k + 1, :k], k)
            self.lower[k - 1, :k] = apex[0]

    def project(self, to: np.ndarray, n: int | None = None) -> np.ndarray:
        """Apexes of rows of distances to the first ``n`` pivots."""
        n = to.shape[1] if n is None else n
        base = self.lower[:n - 1, :n - 1]
        square = to[:, :1] ** 2
        right = ((base ** 2).sum(axis=1) + square - to[:, 1:n] ** 2) / 2
        # forward substitution, a column at a time: a threaded solver can block in forked workers
        foot = np.empty_like(right)
        for k in range(n - 1):
            foot[:, k] = (right[:, k] - np.einsum("ij,j->i", foot[:, :k], base[k, :k])) / base[k, k]
        height = np.sqrt(np.maximum(square[:, 0] - (foot ** 2).sum(axis=1), 0))
        return np.column_stack([foot, height])


def choose_pivots(starts: np.ndarray, most: int = 64, thin: float = 0.03) -> list[int]:
    """Indices of pivots, the first one, then the farthest from the span of the
    chosen ones; one that stands
    lower than ``thin`` times the widest distance over the simplex of the
    chosen ones is left out, and so is everything out of floating range."""
    between = distances(starts, starts)
    if not np.isfinite(between).all() or not between.max() < 1e150:
        return []
    widest, chosen = between.max(), [0]
    while len(chosen) < most:
        apex = Simplex(between[np.ix_(chosen, chosen)]).project(between[:, chosen])
        height = np.where(np.isin(np.arange(len(starts)), chosen), -1, apex[:, -1])
        best = int(height.argmax())
        if height[best] < max(thin * widest, 1e-9):
            break
        chosen.append(best)
    return chosen


def candidates(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centroids) flags: False where the bounds prove another nearer."""
    flat = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
    up, down = apexes[:, -1:] + centres[None, :, -1], apexes[:, -1:] - centres[None, :, -1]
    low, high = np.sqrt(flat + down ** 2), np.sqrt(flat + up ** 2)
    size = np.sqrt((apexes ** 2).sum(axis=1))[:, None] + np.sqrt((centres ** 2).sum(axis=1))[None, :]
    return low - SLACK * size <= (high + SLACK * size).min(axis=1, keepdims=True)


def nearest(q: np.ndarray, apexes: np.ndarray | None, centroids: np.ndarray, centres: np.ndarray | None):
    """Nearest centroid (ties: smaller number), exact squared distance and
    number of exact comparisons of every row."""
    n, k = len(q), len(centroids)
    look = np.ones((n, k), bool)
    if centres is not None:
        sure = np.isfinite(apexes).all(axis=1) & (np.abs(apexes) < 1e150).all(axis=1)
        look[sure] = candidates(apexes[sure], centres)
    wide = q.dtype == object or centroids.dtype == object
    best = np.full(n, None, object) if wide else np.full(n, np.iinfo(np.int64).max)
    label = np.zeros(n, np.int64)
    for j in range(k):
        at = np.flatnonzero(look[:, j])
        d = squared(q[at], centroids[j])
        nearer = np.array([b is None or v < b for v, b in zip(d, best[at])], bool) if wide else d < best[at]
        best[at[nearer]] = d[nearer]
        label[at[nearer]] = j
    return label, best, look.sum(axis=1)


def _projected(simplex: Simplex | None, pivots: np.ndarray, centroids: np.ndarray):
    """Apexes of the centroids, None without pivots or out of range."""
    if simplex is None:
        return None
    to = distances(centroids, pivots)
    return simplex.project(to) if np.isfinite(to).all() and (to < 1e150).all() else None


def _batches(batches, scale: int):
    for whole in batches:
        for batch in slices(whole, 2048):
            if batch.num_rows:
                yield batch, whole_numbers(list_matrix(batch.column("vec")), scale)


def prepare(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of the vectors that take part."""
    v = F.col("vec")
    usable = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).filter(F.coalesce(usable, F.lit(False)))


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("vec", digest.alias("digest")).orderBy("digest", "vec").limit(k).collect()
    return integers([whole_numbers(np.array([r.vec], np.float64), scale)[0].tolist() for r in first])


def with_apexes(rows: DataFrame, pivots: np.ndarray, simplex: Simplex | None, scale: int) -> DataFrame:
    """Add ``apex``: the stored distances to the pivots, as coordinates."""
    kind = rows.schema.simpleString()[7:-1]

    def run(batches):
        for batch, q in _batches(batches, scale):
            if simplex is None:
                apex = pa.array([None] * len(q), pa.list_(pa.float64()))
            else:
                x = simplex.project(distances(q, pivots))
                apex = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, apex], names=[*batch.schema.names, "apex"])

    return rows.mapInArrow(run, f"{kind}, apex array<double>")


def assign(rows: DataFrame, centroids: np.ndarray, centres: np.ndarray | None, scale: int) -> DataFrame:
    """vec_id, cluster, distance (decimal text), compared of every vector."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch, q in _batches(batches, scale):
            apex = None if centres is None else list_matrix(batch.column("apex"))
            label, best, compared = nearest(q, apex, centroids, centres)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(label, pa.int32()), pa.array([str(v) for v in best.tolist()]),
                 pa.array(compared, pa.int32())], names=["vec_id", "cluster", "distance", "compared"])

    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance string, compared int")


def updated(rows: DataFrame, centroids: np.ndarray, centres: np.ndarray | None, scale: int) -> np.ndarray:
    """Centroids after one round: floor of each cluster's mean."""
    dims = centroids.shape[1]

    def add(into: dict, cluster: int, count: int, total: list) -> None:
        n, old = into.get(cluster, (0, [0] * dims))
        into[cluster] = n + count, [a + b for a, b in zip(old, total)]

    def task(batches):
        from pyspark import TaskContext
        held = {}
        for batch, q in _batches(batches, scale):
            label, _, _ = nearest(q, None if centres is None else list_matrix(batch.column("apex")), centroids, centres)
            for j in np.unique(label).tolist():
                add(held, j, int((label == j).sum()), q[label == j].sum(axis=0).tolist())
        lane = TaskContext.get().partitionId() % LANES       # the same when a task is run again
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([lane] * len(held), pa.int32()),
                 pa.array([n for n, _ in held.values()], pa.int64()),
                 pa.array([[str(v) for v in t] for _, t in held.values()], pa.list_(pa.string()))],
                names=["cluster", "lane", "n", "total"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for j, n, total in zip(frame["cluster"], frame["n"], frame["total"]):
            add(held, int(j), int(n), [int(v) for v in total])
        return pd.DataFrame([(j, n, [str(v) for v in t]) for j, (n, t) in held.items()], columns=["cluster", "n", "total"])

    partial = rows.mapInArrow(task, "cluster int, lane int, n long, total array<string>")
    merged = partial.groupBy("cluster", "lane").applyInPandas(merge, "cluster int, n long, total array<string>")
    held = {}
    for r in merged.collect():                      # at most k * LANES rows
        add(held, r.cluster, r.n, [int(v) for v in r.total])
    return integers([[v // held[j][0] for v in held[j][1]] if j in held else c
                     for j, c in enumerate(centroids.tolist())])


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1,
                    pivots: int = 64, anew: tuple = (1,), id_col: str = "vec_id", vec_col: str = "embedding"):
    """(assigned vectors, final centroids): vec_id, cluster, distance (text of
    an exact integer), compared (exact comparisons made) of every vector. The
    pivots, ``pivots`` at most, are chosen anew after the rounds ``anew``."""
    rows = prepare(vectors, dims, id_col, vec_col)
    centroids = first_centroids(rows, k, scale, seed)
    if not len(centroids):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance string, compared int"), centroids
    pool = integers([[0] * dims, *centroids.tolist()])
    for done in range(rounds + 1):
        if done == 0 or done in anew:
            if done:
                pool = integers([[0] * dims, *centroids.tolist(), *pool[1:].tolist()])
            base = pool[choose_pivots(pool, pivots)]
            simplex = Simplex(distances(base, base)) if len(base) else None
            stored = materialize(with_apexes(rows, base, simplex, scale), "apexes")
            rows = stored.drop("apex")
        centres = _projected(simplex, base, centroids)
        if done < rounds:
            centroids = updated(stored, centroids, centres, scale)
    return assign(stored, centroids, centres, scale), centroids


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add inertias and centroid digests to ``cluster_vectors``' rows."""
    spark = assigned.sparkSession
    stored = materialize(assigned, "assigned")
    limit = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
    exact = stored.withColumn("d", F.expr("try_cast(distance as decimal(38,0))"))

    def total(name):       # null if a term or the sum passes the range of a long
        d = F.when(F.col("d") <= limit, F.col("d"))
        whole = F.when(F.count(d) == F.count(F.lit(1)), F.try_sum(d))
        return F.when(whole <= limit, whole.cast("long")).alias(name)

    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    per = exact.groupBy("cluster").agg(total("cluster_inertia")) \
        .join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster") \
        .crossJoin(F.broadcast(exact.agg(total("inertia"))))          # one row
    return exact.join(F.broadcast(per), "cluster").select(            # k rows
        "vec_id", "cluster", F.when(F.col("d") <= limit, F.col("d").cast("long")).alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256")
