import itertools

import numpy as np
import public_tokenizers
import pytest

from prefeval.llm.common import fold_of
from prefeval.llm.langid import Lattice, identify, letter_runs, load_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(lattice, word, p):
    """Sum over every way to cut the word, one by one."""
    index = {x: i for i, x in enumerate(lattice.pieces)}
    text, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                parts.append(text[at:i + 1])
                at = i + 1
        ids = [index.get(x, len(lattice.pieces) - 1 if len(x) == 1 else None) for x in parts]
        if None not in ids:
            total += np.prod(p[ids])
    return total


def test_forward_sums_all_segmentations():
    lattice = Lattice(load_pieces(PATH))
    p = np.random.default_rng(1).uniform(0, 1e-3, (len(lattice.pieces), 2))
    words = ["a", "the", "nation", "über", "ção", "x\U00010450y", "заза"]
    got = lattice.log_probability(words, lattice.weights(p))
    for w, row in zip(words, got):
        for k in range(2):
            assert row[k] == pytest.approx(np.log(brute(lattice, w, p[:, k])))
    uses = lattice.expected(["the", "the"], np.array([2.0, 1.0]), lattice.weights(p[:, :1]))
    letters = np.array([0] + [len(x) for x in lattice.pieces])
    assert (uses * letters).sum() == pytest.approx(3 * 4)     # every letter is in one piece
    assert np.isfinite(lattice.log_probability(["a" * 400], lattice.weights(p))).all()


def test_letter_runs():
    assert letter_runs("Ab1cÉ_x ² 中文") == ["ab", "cé", "x", "中文"] and letter_runs("x" * 900) == ["x" * 400] * 2 + ["x" * 100]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs, PATH, carry=("lang",)).withColumn("held_out", fold_of("doc_id", 3) == 1).filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_edge_rows(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the dog", "en"), ("die katze", "de")] * 4
        + [(None, "en"), ("", None), ("123 !!", "de"), ("the " * 50000, None), ("und die", None)])]
    df = spark.createDataFrame([*rows, (None, "the", None, "x"), (None, "the", None, "x")],
                               "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(df, PATH).collect()}
    assert [got[i].lang_pred for i in range(16, 21)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and identify(df, PATH).count() == len(rows) + 2
    none = df.withColumn("lang", df.lang.substr(9, 0)).filter("false")
    assert identify(none, PATH).count() == 0
    unlabelled = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert identify(unlabelled, PATH).first().lang_pred == "und"


def test_long_runs_do_not_underflow(spark):
    rng = np.random.default_rng(5)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400))
    cjk = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 120))
    junk = ["z" * 400, letters, cjk]
    lattice = Lattice(load_pieces(PATH))
    even = np.full((len(lattice.pieces), 1), 1.0 / len(lattice.pieces))
    w = lattice.weights(even)
    assert np.isfinite(lattice.log_probability(junk, w)).all()
    uses = lattice.expected(junk, np.ones(3), w)
    size = np.array([0] + [len(x) for x in lattice.pieces])
    assert (uses * size).sum() == pytest.approx(401 + 401 + 121)
    few = lattice.expected(["the", letters[:30]], np.array([2.0, 1.0]), w)
    assert (few * size).sum() == pytest.approx(2 * 4 + 31)
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the dog", "en"), ("die katze", "de")] * 4)]
    rows += [(100 + i, f"{t} und die katze", "de") for i, t in enumerate(junk * 4)]       # in training
    rows += [(200 + i, f"the cat and the dog and the cat {t}" if i < 3 else f"der hund und die katze {t}", None)
             for i, t in enumerate(junk * 2)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[203 + i].lang_pred for i in range(3)] == ["de"] * 3


def test_every_letter_of_the_vocabulary_counts(spark):
    pieces = load_pieces(PATH)
    lattice = Lattice(pieces)
    assert set(pieces) <= set(lattice.pieces)
    p = np.random.default_rng(2).uniform(0, 1e-3, (len(lattice.pieces), 1))
    words = ["한국어", "日本語", "中文", "لغة", "שפה", "aか한ا", "語\U00010450a"]
    for w, got in zip(words, lattice.log_probability(words, lattice.weights(p))):
        assert got[0] == pytest.approx(np.log(brute(lattice, w, p[:, 0])))
    texts = {"ko": "우리는 학교에 가고 나는 집에 있다", "ja": "これは日本語の文です。私はそれを見た",
             "zh": "我们在中国学习中文，他是老师", "ar": "هذا كتاب في اللغة العربية من البيت", "he": "זה ספר על השפה של הבית"}
    rows = [(i * 10 + k, t, lang) for i, (lang, t) in enumerate(texts.items()) for k in range(9)]
    asked = {1000: ("나는 학교에 있다", "ko"), 1001: ("私は日本の文を見た", "ja"), 1002: ("老师在学习", "zh"),
             1003: ("من هذا البيت", "ar"), 1004: ("הספר של הבית", "he")}
    rows += [(i, t, None) for i, (t, _) in asked.items()]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    assert {i: got[i] for i in asked} == {i: lang for i, (_, lang) in asked.items()}
