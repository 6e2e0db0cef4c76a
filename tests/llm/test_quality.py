import math

import numpy as np

from prefeval.llm.common import fold_of
from prefeval.llm.quality import classify, estimate_prior, features, fit_pu, risk, risk_slope, sigmoid


def mixture(rng, n, share):
    good = rng.random(n) < share
    return np.where(good[:, None], rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (n, 3))), good


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    p, _ = mixture(rng, 4000, 1.0)
    for share in (0.3, 0.8):
        u, good = mixture(rng, 4000, share)
        prior = estimate_prior(p, u)
        assert abs(prior - share) < 0.08
        predicted = sigmoid(fit_pu(p, u, prior)(u)) >= 0.5
        assert (predicted == good).mean() > 0.95


def plain_risk(f_p, f_u, prior):
    pos = sum(math.log(1 + math.exp(-f)) for f in f_p) / len(f_p)
    neg = sum(math.log(1 + math.exp(f)) for f in f_u) / len(f_u) - prior * sum(math.log(1 + math.exp(f)) for f in f_p) / len(f_p)
    return prior * pos + max(0.0, neg), neg


def test_risk_and_slope_against_plain_sums():
    rng = np.random.default_rng(3)
    signs = set()
    for trial in range(40):
        f_p, f_u, prior = rng.normal(trial % 4, 2, 7), rng.normal(-(trial % 3), 2, 9), rng.uniform(0.05, 0.95)
        whole, negative = plain_risk(f_p, f_u, prior)
        assert math.isclose(risk(f_p, f_u, prior), whole, rel_tol=1e-12)
        signs.add(negative < 0)
        # the slope of the risk, or of the negative part turned round where that is below zero
        of = (lambda a, b: -plain_risk(a, b, prior)[1]) if negative < 0 else (lambda a, b: plain_risk(a, b, prior)[0])
        for side, got in enumerate(risk_slope(f_p, f_u, prior)):
            for i in range(len(got)):
                up, down = [f_p.copy(), f_u.copy()], [f_p.copy(), f_u.copy()]
                up[side][i] += 1e-5
                down[side][i] -= 1e-5
                assert abs((of(*up) - of(*down)) / 2e-5 - got[i]) < 1e-7
    assert signs == {True, False}


def test_labels_of_every_document_still_teach(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg({"quality": "max"}) \
        .toDF("doc_id", "quality")
    covered = docs.join(labels.filter("quality is not null"), "doc_id", "left_semi")
    rows = classify(covered, labels).filter("held_out").join(labels, "doc_id").collect()
    good, junk = [[r.predicted for r in rows if r.quality == q] for q in (1, 0)]
    assert sum(good) >= 0.95 * len(good) and sum(junk) <= 0.15 * len(junk)


def test_an_id_with_several_texts_teaches_alike_in_any_layout(spark):
    rows = [(i // 2, f"Some plain text, as people write it, number {i}." if i % 3 else f"a | {i} | c | d\n" * 5)
            for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted((r.doc_id, r.score) for r in classify(d, labels).collect())
            for d in (docs.repartition(1), docs.orderBy(docs.text.desc()).repartition(7, "text")))
    assert a == b


def test_features_are_finite():
    x = features([b"", b" ", b"a", b"\xff\xfe", b"word " * 9, b"\n\n\n", b"x" * 100000])
    assert np.isfinite(x).all() and (features([b"a b", b"a b"])[0] == features([b"a b"])[0]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(1 - r.predicted for r in rows if r.quality == 0) >= 0.9 * (len(rows) - len(good))


def test_edge_rows(spark):
    texts = ["Some plain text, as people write it.", "a | b | c | d", None, "", "x" * 200000]
    rows = [(i, texts[i % 5], "s") for i in range(60)] + [(None, "no id", "s"), (3, texts[0], "s"), (3, texts[0], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = [(i, 1, 0) for i in range(0, 60, 5)] + [(0, 0, 0), (None, 1, 0), (7, None, 0), (10**9, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 3 and r.score != got[3].score}) <= 1
    assert classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", (fold_of("doc_id", 5) == 0).cast("int") * (1 - labels.quality)
                                + (fold_of("doc_id", 5) != 0).cast("int") * labels.quality)
    kept = labels.filter(fold_of("doc_id", 5) != 0)
    a, b = (sorted(map(tuple, classify(docs, x).collect())) for x in (kept, flipped.filter(fold_of("doc_id", 5) != 0)))
    assert a == b
