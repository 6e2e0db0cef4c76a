"""Every stage on the small tables, against plain versions of its decision."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from prefeval.llm import langid, quality, secrets
from prefeval.llm.shingles import keep_one
from test_shingles import brute as components_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !!", "de", "s", 8)], docs.schema)
    out = [docs.unionByName(extra)]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "secret_scans",
                                               "best_fit_packing"]
    assert all(s.columns == list(pipeline.COLUMNS) for s in stages[1:5])


def test_language_and_quality(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {i for i, r in before.items() if langid.letter_runs(r.text or "")}
    assert all(after[i] == before[i] for i in after)
    judged = {r.doc_id: r.score for r in quality.classify(stages[1], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(rows(stages[2])) == {i for i, s in judged.items() if s >= 0.3}


def test_one_of_each_group(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted(rows(stages[3])) == sorted(d for (d, _, c) in components_of(before) if int(d) == c
                                             for d in [int(d)])


def test_secrets_and_packing(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(before[i].text):
            assert r.text == before[i].text or "[secret]" in r.text
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages[5].toPandas()
    sizes = {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in after.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]
    assert packed.sequence_id.nunique() <= 1.05 * -(-packed.length.sum() // 2048) + 1


def test_keep_one_edge_rows(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "z"), (None, a, "n"), (3, b, "p"), (3, "other words in a row here", "q"),
            (3, b, "r"), (None, "no id at all for these words", "u"), (None, "no id at all for these words", "v"),
            (4, None, "e1"), (4, "", "e2"), (5, " ", "e3"), (5, " ", "e4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = sorted((str(r.doc_id), r.text or "") for r in keep_one(df).collect())
    assert got == sorted([("1", a), ("3", b), ("3", "other words in a row here"), ("None", "no id at all for these words"),
                          ("4", ""), ("4", ""), ("5", " "), ("5", " ")])
    assert keep_one(df.limit(0)).count() == 0
