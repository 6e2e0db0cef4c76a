import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from prefeval.operators import clean, subwords
from prefeval.plans import queries as Q

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
END = 7
ROWS = [(0, "Say: ", "hello there world"), (1, None, "only a target"), (2, "only a prompt", None), (3, None, None),
        (4, "", ""), (5, "cut in tok", "enisation \U0001f600é 中文"), (6, "word " * 60, "tail " * 60), (7, "x", "<|endoftext|>"),
        (8, "\U0001f600" * 9, "\U0001f600" * 9), (8, "\U0001f600" * 9, "\U0001f600" * 9), (9, "a\x00b \n\n", "  \t ")]


def plain(lib, text):
    e = lib.encode(text or "", add_special_tokens=False)
    return e.ids, e.offsets


def overlap(offsets, spans):
    return [next((k for k, s in enumerate(spans, 1) if s and s[0] < s[1] and a < s[1] and z > s[0]), 0) for a, z in offsets]


@pytest.fixture(params=PATHS, ids=["bytes", "words"])
def vocabulary(request):
    return Tokenizer.from_file(request.param), subwords.library_tokenizer(request.param)


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, prompt string, target string")


def test_encode(spark, vocabulary):
    lib, make = vocabulary
    for cut in (None, 5):
        got = subwords.encode(frame(spark), "target", make, cut).collect()
        for r in got:
            assert r.ids == plain(lib, r.target)[0][:cut] and r.ids_mask == int(bool((r.target or "").strip()))
    assert subwords.encode(frame(spark).limit(0), "target", make).count() == 0


def test_pair(spark, vocabulary):
    lib, make = vocabulary
    for limit in (4, 30, 1000):
        for r in subwords.encode_pair(frame(spark), "prompt", "target", make, limit, END, 3).collect():
            p, o = plain(lib, r.prompt)[0], plain(lib, r.target)[0]
            o = o if o and o[-1] == END else [*o, END]
            over = max(0, len(p) + len(o) - limit)
            kept_o = o[max(0, over - len(p)):]
            assert r.input_ids == p[over:] + kept_o and r.labels == [-100] * len(p[over:]) + kept_o
            assert r.prompt_overflow == (len(p) >= limit) and r.target_len == len(kept_o)


def test_labels(spark, vocabulary):
    lib, make = vocabulary
    for limit in (4, 30, 1000):
        for r in subwords.label_tokens(frame(spark), "prompt", "target", make, limit, END).collect():
            ids, offsets = plain(lib, (r.prompt or "") + (r.target or ""))
            start = next((k for k, (_, z) in enumerate(offsets) if z > len(r.prompt or "")), len(ids))
            cut = ids[:limit]
            start, end = min(start, len(cut)), [END] if len(cut) < limit else []
            assert r.target_start == start and r.truncated == (len(ids) > limit)
            assert r.input_ids == cut + end and r.labels == [-100] * start + cut[start:] + end


def test_tags(spark, vocabulary):
    lib, make = vocabulary
    texts = ["ask tokenisation and \U0001f600 more", "", None, "ab" * 40]
    spans = [((4, 9), (9, 22)), ((6, 6), None), (None, None), ((0, 3), (2, 80)), ((21, 22), (0, 1))]
    rows = [(i, t, *s) for i, (t, s) in enumerate((t, s) for t in texts for s in spans)]
    span = "struct<start:int,end:int>"
    df = spark.createDataFrame(rows, f"id long, prompt string, sa {span}, sb {span}")
    for cut in (None, 3):
        for r in subwords.tag_response_tokens(df, "prompt", "sa", "sb", make, cut).collect():
            assert r.response_types == overlap(plain(lib, r.prompt)[1], [r.sa, r.sb])[:cut], r


def test_name_clash(spark):
    with pytest.raises(ValueError, match="already there"):
        subwords.tokenise(frame(spark).withColumn("tok_IDS", F.lit(1)), "prompt", subwords.library_tokenizer(PATHS[0]))


def test_queries_equal_plain_loops(spark):
    lib = Tokenizer.from_file(PATHS[0])
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in Q.QUERIES["t1_encode_subwords"](spark, SF_SMALL).collect()}
    assert got == {r.doc_id: " ".join(map(str, plain(lib, r.text)[0][:256])) for r in docs}
    x = clean.with_span(Q._span_inputs(spark, SF_SMALL), "sa", "content", "resp_a")
    rows = clean.with_span(x, "sb", "content", "resp_b", F.col("sa.end")).collect()
    got = {r.id: r.types for r in Q.QUERIES["t4_tag_subwords"](spark, SF_SMALL).collect()}
    assert got == {r.id: "".join(map(str, overlap(plain(lib, r.content)[1], [r.sa, r.sb]))) for r in rows}
    assert any("1" in t for t in got.values()) and any("2" in t for t in got.values())
    for name in ("t2_encode_pair_subwords", "t3_label_subwords"):
        assert Q.QUERIES[name](spark, SF_SMALL).count() == Q._sft_rows(spark, SF_SMALL).count() > 0
