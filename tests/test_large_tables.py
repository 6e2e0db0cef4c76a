"""Operators whose cost per row or batch must stay small."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefeval.operators import lang as L
from prefeval.operators import metrics as M
from prefeval.operators import subwords as U
from prefeval.operators import tokens as T
from prefeval.plans import queries as Q


def test_weighted_histogram_equals_repeated_rows(spark):
    rows = [("a", 0, [1.0, 0.0], 3), ("a", 1, [0.25, 0.75], 2), ("b", 1, [0.0, 1.0], 1), ("b", -100, [0.0, 0.0], 4)]
    df = spark.createDataFrame(rows, "g string, label int, target array<double>, n int")
    many = df.select("g", "label", "target", F.explode(F.sequence(F.lit(1), "n")))
    for group in (["g"], []):
        a = M.bin_histogram(df, group=group, weight="n").toPandas().sort_values([*group, "bin"]).reset_index(drop=True)
        b = M.bin_histogram(many, group=group).toPandas().sort_values([*group, "bin"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(a, b)


def test_lengths_are_counted_before_binning(spark, tmp_path):
    rows = [(k, "x", "a b c") for k in range(5)] + [(9, None, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.lang, r.rows) for r in Q._doc_length_bins(spark, str(tmp_path)).collect()}
    assert got == {("x", 5), (None, 1)}


def test_model_sees_few_rows_at_a_time(spark):
    df = spark.range(0, 1500, 1, 1).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("x").alias("wide"))

    def seen(pdf):
        return pd.Series([str(len(pdf))] * len(pdf), index=pdf.index)
    got = L.map_text(df, seen, inputs=["text"], keys=["id"]).collect()
    assert len(got) == 1500 and max(int(r.output) for r in got) <= L.MAP_ROWS
    assert L.map_text(df, seen, inputs=["text"], keys=None).columns == ["id", "text", "wide", "output"]
    once = L.map_text(df.withColumn("text", F.lit("same")), seen, inputs=["text"], keys=["id"], dedupe=True).collect()
    assert len(once) == 1500 and {r.output for r in once} == {"1"}


def test_rare_grams_and_many_languages_give_the_same_language(spark, monkeypatch):
    rows = [(1, "aaa bbb aaa", "x"), (2, "aaa ccc", "y"), (3, "zzz ccc", "y"), (4, "", "x"), (5, None, "x"), (6, "aaa", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train_language_model(df)
    want = sorted((r.doc_id, r.detected) for r in L.detect_language(df, model).collect())
    assert want[3] == (4, "") and {w[1] for w in want[:3]} == {"x", "y"}
    for name, few in (("HOT_GRAMS", 2), ("WIDE_LANGS", 1), ("HOT_GRAMS", 1 << 16)):
        monkeypatch.setattr(L, name, few)
        assert sorted((r.doc_id, r.detected) for r in L.detect_language(df, model).collect()) == want


def test_pair_is_encoded_in_one_stage(spark, capsys):
    def make():
        return lambda texts: [([len(t)], [0], [len(t)]) for t in texts]
    df = spark.createDataFrame([(1, "ab", "c"), (2, None, "dd")], "id long, p string, o string")
    x = U.encode_pair(df, "p", "o", make, 10, 7, 0)
    x.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert {r.id: r.input_ids for r in x.collect()} == {1: [2, 1, 7], 2: [0, 2, 7]}


def test_tags_need_no_array_lambdas(spark, capsys):
    def make():
        return lambda texts: [(list(range(len(t))), list(range(len(t))), list(range(1, len(t) + 1))) for t in texts]
    span = "struct<start:int,end:int>"
    df = spark.createDataFrame([(1, "abcdef", (1, 3), (2, 5))], f"id long, p string, a {span}, b {span}")
    x = U.tag_response_tokens(df, "p", "a", "b", make)
    x.explain()
    assert "zip_with" not in capsys.readouterr().out
    assert x.first().response_types == [0, 1, 1, 2, 2, 0]


def test_ranks_are_aligned_after_one_exchange(spark):
    types = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1), (1, 3, 2), (None, 0, 1)], "row_id long, pos int, side int")
    vals = spark.createDataFrame([(1, 1, 0, 5.0), (1, 1, 1, float("nan")), (1, 1, 2, 7.0), (1, 2, 0, None), (None, 1, 0, 9.0)],
                                 "row_id long, side int, vpos int, value double")
    x = T.rank_align(types, vals)
    assert {(r.row_id, r.pos, r.side, r.value) for r in x.collect()} == {
        (1, 0, 1, 5.0), (1, 2, 1, 7.0), (1, 3, 2, 0.0), (None, 0, 1, 0.0)}
    plan = x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_token_nll_sends_each_pair_once_a_chunk(spark, monkeypatch):
    """Against a plain count, over several chunks, with another corpus, repeated
    and null keys; no row per text and pair is shuffled."""
    import math
    import random
    from collections import Counter

    from prefeval.operators import metrics as M
    monkeypatch.setattr(M, "CHUNK_CHARS", 300, raising=False)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c dd é 1 2 3".split()) for _ in range(rng.randrange(14))) for _ in range(120)]
    rows = [(i if i % 10 else None, t) for i, t in enumerate(texts)] + [(3, "a  b\ta"), (4, None), (5, texts[5]), (200, "x"), (201, "a b")]
    other = [(i, t) for i, t in rows[::3]] + [(7, "zz zz zz")]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")

    def plain(rows, corpus, k):
        split = lambda t: (t or "").split()
        pairs = Counter(p for _, t in corpus for p in zip(split(t), split(t)[1:]))
        first, vocab = Counter(), {w for _, t in corpus for w in split(t)}
        for (a, _), n in pairs.items():
            first[a] += n
        by = {}
        for i, t in rows:
            by.setdefault(i, []).extend(-math.log((pairs[p] + k) / (first[p[0]] + k * len(vocab))) for p in zip(split(t), split(t)[1:]))
        return sorted(((i, sum(by[i]) / len(by[i]) if i is not None and by[i] else 0.0) for i, _ in rows), key=str)

    df = frame(rows)
    for corpus, listed, k in ((df, rows, 1.0), (frame(other), other, 0.5)):
        got = M.token_nll(df, corpus, k=k)
        want = plain(rows, listed, k)
        found = sorted(((r.doc_id, r.nll) for r in got.collect()), key=str)
        assert [r[0] for r in found] == [r[0] for r in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(found, want))
        plan = got._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "hashpartitioning(" in x]
        assert dealt and not any("prev" in x.split("hashpartitioning(")[1] for x in dealt)


def test_token_nll_makes_no_row_per_token(spark, monkeypatch):
    """Neither explodes nor sorts tokens, and shuffles the texts once; odd
    blanks, bytes that are no UTF-8, long words and copies of rows count as in
    a plain count, also with no smoothing."""
    import math
    from collections import Counter

    from prefeval.functions.text import WS_CHARS
    from prefeval.operators import metrics as M
    monkeypatch.setattr(M, "CHUNK_CHARS", 400)
    texts = [x.join(["", "ab", "😀", "", "ab", "é" * 9, ""]) for x in WS_CHARS] + ["ab ab " * 40, " ", "", None, "​ a\x00b ab", "x" * 5000 + " y"]
    rows = [(f"k{i % 30}", t) for i, t in enumerate(texts)] + [("k1", "ab 😀 q")] * 50 + [(None, "ab ab")]
    df = spark.createDataFrame(rows, "name string, said string")
    df = df.unionByName(spark.sql("SELECT 'bad' AS name, CAST(X'6162FF2061622062' AS STRING) AS said"))
    rows.append(("bad", "ab� ab b"))

    split = {t: (t or "").split() for _, t in rows}
    pairs = Counter(p for _, t in rows for p in zip(split[t], split[t][1:]))
    first, vocab = Counter(), {w for x in split.values() for w in x}
    for (a, _), n in pairs.items():
        first[a] += n
    for k in (1.0, 0.0):
        by = {}
        for i, t in rows:
            by.setdefault(i, []).extend(-math.log((pairs[p] + k) / (first[p[0]] + k * len(vocab))) for p in zip(split[t], split[t][1:]))
        want = sorted((str(i), round(sum(by[i]) / len(by[i]), 9) if i is not None and by[i] else 0.0) for i, _ in rows)
        x = M.token_nll(df, df, key="name", text="said", k=k)
        assert sorted((str(r.name), round(r.nll, 9) + 0.0) for r in x.collect()) == want
        plan = x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Window" not in plan and "Generate" not in plan and "ReusedExchange" in plan


def test_token_nll_over_a_corpus_without_words(spark):
    from pyspark.errors import PySparkException

    from prefeval.operators import metrics as M
    df = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None)], "doc_id long, text string")
    none = df.filter("doc_id = 3")
    assert {r.doc_id: r.nll for r in M.token_nll(none, df).collect()} == {3: 0.0}
    assert M.token_nll(df.limit(0), df).collect() == []
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert {r.doc_id: r.nll for r in M.token_nll(df, none).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
        spark.conf.set("spark.sql.ansi.enabled", "true")
        with pytest.raises(PySparkException):
            M.token_nll(df, none).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
