"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the axis (with sign) nearest to it. A code joins two
such hashes; every vector stands in the bucket of its best code and of the
next best ones (``probes``) in each of ``tables`` tables, and vectors that
share a bucket are compared by exact cosine in double precision.

Equal vectors are one class. Buckets are cut into blocks of ``block`` classes
and every two blocks meet in one group, so a hot bucket is spread over tasks.
A group emits, per class, how many rows it links to (a pair counts only in the
first code its members share) and the least class of its links: rows grow with
the vectors, not with the pairs.

Edge cases: a vector that is null, empty, zero or holds null or non-finite
components, or has no label, links with nothing and keeps itself; vectors of
different length are never compared; repeated rows are linked copies; a null
id is counted but names a component only if all its members are null; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import list_matrix, materialize, slices, sorted_groups
from prefeval.llm.components import components


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (width a power of two)."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def codes(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables * probes) bucket codes, all distinct within a row."""
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - dim)))
    rng = np.random.default_rng([seed, width])
    out = np.empty((n, tables, probes), np.int64)
    rows = np.arange(n)[:, None]
    for t in range(tables):
        axis, size = [], []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            near = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            near = np.take_along_axis(near, np.argsort(-np.abs(y[rows, near]), axis=1), axis=1)
            axis.append(2 * near + (y[rows, near] < 0))
            size.append(np.abs(y[rows, near]))
        pair = lambda i, j: axis[0][:, i] * (2 * width) + axis[1][:, j]
        combos = np.stack([pair(0, 0), pair(1, 0), pair(0, 1), pair(1, 1)], axis=1)
        drop = [s[:, 0] - s[:, 1] for s in size]
        loss = np.stack([np.full(n, -1.0), drop[0], drop[1], drop[0] + drop[1]], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(combos, best, axis=1) + t * (2 * width) ** 2
    return out.reshape(n, -1)


def hashed(classes: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """Add ``codes`` to classes (node, label, vec, copies)."""
    schema = classes.schema.simpleString()[7:-1] + ",codes:array<bigint>"

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 2048):
                vecs = batch.column("vec").to_pylist()
                out = [None] * len(vecs)
                for dim in {len(v) for v in vecs}:
                    at = [i for i, v in enumerate(vecs) if len(v) == dim]
                    x = np.array([vecs[i] for i in at], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    for i, c in zip(at, codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes, seed)):
                        out[i] = c
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))],
                                                 names=[*batch.schema.names, "codes"])

    return classes.mapInArrow(run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(a: dict, b: dict | None, code: int, least: float):
    """Links of one block (b None) or between two blocks of a bucket:
    (nodes, linked copies counted here, least node of the linked set)."""
    both = a if b is None else {k: np.concatenate([a[k], b[k]]) for k in a}
    first = len(a["node"])
    x = unit(both["vec"])
    sim = x @ x.T if b is None else x[:first] @ x[first:].T
    i, j = np.nonzero(sim >= least)
    if b is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + first
    if not len(i):
        return None
    # the first code that both hold, in the order of the first one's codes
    mine = np.full(len(i), -1, np.int64)
    for k in range(both["codes"].shape[1]):
        c = both["codes"][i, k]
        hit = (both["codes"][j] == c[:, None]).any(axis=1)
        mine = np.where(hit & ((mine < 0) | (c < mine)), c, mine)
    counted = mine == code
    n = len(both["node"])
    links = np.bincount(i[counted], both["copies"][j[counted]], n) + np.bincount(j[counted], both["copies"][i[counted]], n)
    root = both["node"].copy()
    while True:                      # least node within the links of this group
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (old == root).all():
            break
    keep = (links > 0) | (root != both["node"])
    return both["node"][keep], links[keep].astype(np.int64), root[keep]


def bucket_links(postings: DataFrame, least: float, block: int) -> DataFrame:
    """node, links, root from every bucket of two classes or more."""
    sizes = postings.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    cut = postings.join(sizes, ["label", "dim", "code"]).withColumn("blocks", blocks) \
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block k meets every block: it goes to the groups (min(k, o), max(k, o))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("label", "dim", "code", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                "own", "node", "copies", "vec", "codes")
    keys = ["label", "dim", "code", "lo", "hi"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        for group in sorted_groups(batches, keys):
            if group.num_rows < 2:
                continue
            lo, hi, code = (group.column(k)[0].as_py() for k in ("lo", "hi", "code"))
            cols = {"node": group.column("node").to_numpy(), "copies": group.column("copies").to_numpy(),
                    "vec": list_matrix(group.column("vec")).astype(np.float64), "codes": list_matrix(group.column("codes"))}
            own = group.column("own").to_numpy()
            if lo == hi:
                found = compare(cols, None, code, least)
            else:
                parts = [{k: v[own == o] for k, v in cols.items()} for o in (lo, hi)]
                found = compare(*parts, code, least) if all(len(p["node"]) for p in parts) else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["node", "links", "root"])

    return dealt.mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = 6, probes: int = 2, block: int = 2048,
                 seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vec_col).alias("vec"))
    usable = v.isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) \
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    # -0.0 and 0.0 are one value; the class key is the vector itself, by its digest
    key = F.when(F.coalesce(usable, F.lit(False)),
                 F.sha2(F.concat_ws(",", F.transform(v, lambda c: (c + 0.0).cast("string"))), 256))
    rows = rows.withColumn("key", key)
    classes = rows.filter("key is not null").groupBy("label", "key") \
        .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")) \
        .withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    postings = materialize(hashed(classes.select("node", "label", "copies", "vec"), tables, probes, seed), "hashed") \
        .withColumn("dim", F.size("vec")).withColumn("code", F.explode("codes"))
    links = materialize(bucket_links(postings, least, block), "vector-links")
    roots = components(links, "node", "root")
    named = classes.select("label", "key", "node", "least_id", "copies") \
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left") \
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    out = rows.select("vec_id", "label", "key").join(
        named.select("label", "key", "copies", "links", "component_id"), ["label", "key"], "left")
    n_links = F.when(F.col("copies").isNull(), F.lit(0)) \
        .otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
