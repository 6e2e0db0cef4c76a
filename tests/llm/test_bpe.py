import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prefeval.llm.bpe import Coder, digest_documents, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
CODER = Coder(PATH)


def lib_ids(text):
    return LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["ab", "aeinorst", " \n\t", "thein ", "0123 ", "!?.,-' s", "éüß中 \U0001f600", "Aa Bb'll "])
def test_random_strings(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))
        assert CODER.ids(text) == lib_ids(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODER.ids(text) == lib_ids(text)
    assert CODER.auto.decode(CODER.ids(text)).decode() == text


def test_every_label_is_its_own_path_or_not():
    for i in range(0, 50000, 7):
        text = CODER.auto.label[i].decode("utf-8", "ignore")
        if text:
            assert CODER.ids(text) == lib_ids(text)


def test_rows(spark):
    texts = [None, "", "a <|endoftext|> b", "x" * 3000, "the " * 20000, "the " * 20000, "\x1c\x85　mixed"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in digest_documents(df, PATH).collect()}
    full = {r.doc_id: r for r in encode_documents(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = lib_ids(t or "")
        assert got[i].n_tokens == len(ids) and full[i].ids == ids
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = LIB.decode(ids, skip_special_tokens=False)
        assert full[i].decoded == back
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert digest_documents(df.limit(0), PATH).count() == 0
