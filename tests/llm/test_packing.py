import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefeval.llm.packing import best_two_fit, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello  World's\tend\x0bof\nline", "a b ́x café <|endoftext|> tail",
         "x" * 500, "word " * 5000, "word " * 5000, "\x1c\x85 mixed　width 123 !!", "ΑΣ ΣΑΣ. İ", "ÀB…!! x×,! É÷! l'amie's. don'T! A<|STARTOFTEXT|> naïve, <|startoftext|>b Ç̧!",
         "1a, a1! ___ª. ß) Ünder/Ähre ok.) k·, E\u0301. e\u0301! \u0301."]


def first_fit_decreasing(lengths):
    room = np.full(len(lengths), 2048)
    for n in sorted(lengths.tolist(), reverse=True):
        room[np.argmax(room >= n)] -= n
    return (room < 2048).sum()


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_gapless_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 3000)
    bins, offsets = best_two_fit(lengths, 2048)
    for b in range(bins.max() + 1):
        rows = np.flatnonzero(bins == b)
        rows = rows[offsets[rows].argsort()]
        ends = np.cumsum(lengths[rows])
        assert offsets[rows].tolist() == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert bins.max() + 1 <= 1.005 * first_fit_decreasing(lengths)


def test_matches_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = pack_documents(df, PATH).toPandas()
    t = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        assert mine.length.sum() == len(ids)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s:s + 2048].tobytes()) for s in mine.start]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert pack_documents(twice, PATH).count() == 3
