import numpy as np

from prefeval.llm.lsh import hadamard, near_vectors


def brute(rows, least=0.98):
    n = len(rows)
    use = [label is not None and bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
           for _, v, label in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if use[i] and use[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return sorted((str(r[0]), links[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i)))
                  for i, r in enumerate(rows))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    return sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_vectors(df, **kw).collect())


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(hadamard(hadamard(x)), x) and np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_groups_and_edge_rows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            v = base + rng.normal(size=16) * 0.01
            rows.append((len(rows) + 5, (v * rng.uniform(.1, 9)).tolist(), int(rng.integers(0, 2))))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1),
             (905, [float("inf")] * 16, 1), (906, rows[0][1], None), (907, rows[0][1][:8], rows[0][2]),
             (3, rows[9][1], rows[9][2]), (3, rows[9][1], rows[9][2]), (None, rows[9][1], rows[9][2]), (None, None, None)]
    want = brute(rows)
    assert run(spark, rows, tables=12, probes=4) == want
    assert run(spark, rows, tables=12, probes=4, block=3) == want      # hot buckets cut into blocks
    assert run(spark, []) == []


def test_recall_on_table(spark):
    """Found links against all links of the table (at least 0.9, none wrong)."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want, got = brute(rows), sorted((str(r.vec_id), r.n_links) for r in near_vectors(df).collect())
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
