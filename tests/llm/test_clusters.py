import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from prefeval.llm.clusters import (SLACK, Simplex, candidates, choose_pivots, cluster_vectors, distances, squared, summary,
                                   whole_numbers)


def plain(rows, k=16, rounds=3, scale=64, dims=64, seed=1):
    """Python integers and fractions only."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        label = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), x in zip(kept, label) if x == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [near(v) for _, v in kept]
    total = [sum(d for d, x in found if x == j) for j in range(len(centres))]
    fit = lambda n, terms: n if n < 2 ** 63 and all(t < 2 ** 63 for t in terms) else None
    terms = [d for d, _ in found]
    return sorted(((i, j, fit(d, []), fit(total[j], [t for t, x in found if x == j]), fit(sum(terms), terms),
                    hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, found)), key=str)


def run(spark, rows, kind="double", **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance string")
    return sorted((tuple(r) for r in summary(*cluster_vectors(df.repartition(5), **kw)).collect()), key=str)


def blobs(n, seed, centres=20, wide=1.0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 64)) * wide
    return [(i, (c[rng.integers(centres)] + rng.normal(size=64) * 0.1).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_version(spark, seed):
    rows = blobs(300, seed) + [(None, [0.5] * 64), (7, blobs(1, 9)[0][1]), (7, blobs(1, 9)[0][1]), (7, [0.25] * 64), (900, None),
                               (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63),
                               (905, [float("nan")] * 64), (906, [float("inf")] * 64), (907, [-0.0] * 64), (908, [-1e-300] * 64)]
    assert run(spark, rows) == plain(rows)


def test_ties_few_rows_and_empty(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert run(spark, same) == plain(same)
    grid = [(i, [float(i % 4)] + [0.0] * 63) for i in range(60)]           # equal distances, equal starts
    assert run(spark, grid) == plain(grid)
    few = blobs(5, 3)
    assert run(spark, few) == plain(few)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


@pytest.mark.parametrize("wide", [1e6, 1e12, 1e300])
def test_values_of_any_size(spark, wide):
    rows = blobs(60, 4, wide=wide) + [(500 + i, v) for i, v in blobs(40, 5)] + [(999, [1.7e308, -1.7e308] * 32)]
    assert run(spark, rows) == plain(rows)


def test_whole_numbers_and_exact_distances():
    x = np.array([[-0.01, 0.0, 1.5, 1e17], [3.0, -3.0, 2.0 ** 60, -1.0]])
    assert whole_numbers(x, 64).tolist() == [[math.floor(Fraction(v) * 64) for v in r] for r in x.tolist()]
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 26), 1 << 26, (50, 256)), rng.integers(-(1 << 26), 1 << 26, 256)
    assert squared(a, b).tolist() == [sum((int(p) - int(q)) ** 2 for p, q in zip(r, b)) for r in a]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    centres = rng.integers(-64, 64, (16, 64))
    x = centres[rng.integers(16, size=4000)] + rng.integers(-12, 12, (4000, 64))
    chosen = choose_pivots(centres)
    simplex = Simplex(distances(centres[chosen], centres[chosen]))
    a, b = simplex.project(distances(x, centres[chosen])), simplex.project(distances(centres + 3, centres[chosen]))
    true = distances(x, centres + 3)
    low = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))
    high = np.sqrt(low ** 2 + 4 * a[:, None, -1] * b[None, :, -1])
    assert (low <= true * (1 + 1e-9) + 1e-6).all() and (high >= true * (1 - 1e-9) - 1e-6).all()
    look = candidates(a, b)
    assert look[np.arange(4000), true.argmin(axis=1)].all()
    assert look.sum(axis=1).mean() < 4                                    # of 16


def test_filter_on_the_given_table(spark):
    """The bounds leave out centroids of real vectors as well."""
    assigned, _ = cluster_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    compared = [r.compared for r in assigned.collect()]
    assert np.mean(compared) < 13                                        # of 16, on 500 vectors without clusters


def test_slack_covers_the_error():
    """Many pivots, some nearly dependent: bounds err by far less than SLACK."""
    rng = np.random.default_rng(5)
    pool = np.vstack([np.zeros((1, 64), np.int64), c := rng.integers(-20, 20, (16, 64)), c + rng.integers(-2, 3, (16, 64))])
    base = pool[choose_pivots(pool)]
    assert len(base) > 17
    simplex = Simplex(distances(base, base))
    x = np.vstack([rng.integers(-64, 64, (500, 64)), base, base + 1])
    a, b = simplex.project(distances(x, base)), simplex.project(distances(c, base))
    low = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))
    high = np.sqrt(low ** 2 + 4 * a[:, None, -1] * b[None, :, -1])
    true, size = distances(x, c), np.linalg.norm(a, axis=1)[:, None] + np.linalg.norm(b, axis=1)[None]
    assert (low - true < SLACK / 10 * size).all() and (true - high < SLACK / 10 * size).all()
