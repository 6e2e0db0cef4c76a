"""T1-T4 with a tokeniser of the caller's choice.

A tokeniser is a function without arguments, called once per Python worker,
that returns a function from a list of texts to one (ids, starts, ends) per
text; starts and ends are character offsets, in order. ``library_tokenizer``
makes one from a vocabulary file of the tokenizers library. One Arrow stage
adds ids and offsets; labels and span tags are array expressions over them.

Edge cases: null text is the empty text and has no tokens; a null span tags
nothing; a prompt that ends inside a token leaves that token to the target;
columns of the output's names that the input already has are an error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from prefeval.functions.memory import free_memory
from prefeval.functions.text import NON_WS, c
from prefeval.operators import tokens as T

ROWS = 256                # texts handed to the tokeniser at a time
PARTS = ("ids", "starts", "ends")


def library_tokenizer(path: str, special: bool = True) -> Callable:
    """The vocabulary file at ``path``, which every executor can open; with
    ``special`` false, control strings in a text are ordinary text."""
    def make():
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark's tasks fill the cores
        from tokenizers import Tokenizer
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        lib.encode_special_tokens = not special

        def encode(texts: list) -> list:
            found = lib.encode_batch(texts, add_special_tokens=False)
            return [(e.ids, *([*ends] for ends in zip(*e.offsets))) if len(e) else ([], [], []) for e in found]

        # the same ids for callers that need no offsets
        encode.ids_only = lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        return encode
    return make


def _stage(df: DataFrame, tokenizer: Callable, drop: list, added: list, work: Callable) -> DataFrame:
    """One Arrow stage: ``work(encode, column)`` gives the values of the ``added``
    (name, type) columns for ``ROWS`` rows at a time, ``column`` the list of a
    column's values there. Columns in ``drop`` do not come back."""
    clash = {n.lower() for n, _ in added} & {n.lower() for n in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    given = df.columns
    kept = [i for i, n in enumerate(given) if n not in drop]
    schema = ST.StructType([*[df.schema.fields[i] for i in kept], *[ST.StructField(n, t) for n, t in added]])
    kinds = [pa.list_(pa.int32()) if isinstance(t, ST.ArrayType) else pa.int32() for _, t in added]
    names = [*[given[i] for i in kept], *[n for n, _ in added]]

    def run(batches):
        encode = tokenizer()
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                found = work(encode, lambda n: batch.column(given.index(n)).to_pylist())     # noqa: B023
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in kept], *[pa.array(f, t) for f, t in zip(found, kinds)]], names=names)
            free_memory()

    return df.mapInArrow(run, schema)


INTS = ST.ArrayType(ST.IntegerType())


def _ids(encode: Callable, texts: list) -> list:
    texts = [t or "" for t in texts]
    only = getattr(encode, "ids_only", None)
    return only(texts) if only else [f[0] for f in encode(texts)]


def tokenise(df: DataFrame, text: str, tokenizer: Callable, out: str = "tok") -> DataFrame:
    """Add ``out``_ids, ``out``_starts and ``out``_ends of the whole text."""
    def work(encode, column):
        found = encode([t or "" for t in column(text)])
        return [[f[i] for f in found] for i in range(3)]

    return _stage(df, tokenizer, [], [(f"{out}_{p}", INTS) for p in PARTS], work)


def token_ids(df: DataFrame, texts: dict, tokenizer: Callable) -> DataFrame:
    """Add the ids of several text columns, ``texts`` naming the new column of
    each, in one stage; the library tokeniser then makes no offsets."""
    return _stage(df, tokenizer, [], [(n, INTS) for n in texts.values()],
                  lambda encode, column: [_ids(encode, column(t)) for t in texts])


def _cut(col, max_len: int | None):
    return c(col) if max_len is None else F.slice(c(col), 1, max_len)


# --------------------------------------------------------------------------- T1
def encode(df: DataFrame, text: str, tokenizer: Callable, max_len: int | None = None, out: str = "ids") -> DataFrame:
    """text -> ids, right-truncated to max_len if there is one; mask 1 when the text is present."""
    present = F.coalesce(c(text).rlike(NON_WS), F.lit(False))
    return token_ids(df, {text: "_t_ids"}, tokenizer).withColumn(out, _cut("_t_ids", max_len)) \
        .withColumn(out + "_mask", present.cast("int")).drop("_t_ids")


# --------------------------------------------------------------------------- T2
def encode_pair(df: DataFrame, prompt: str, output: str, tokenizer: Callable, max_len: int, eos: int, pad: int) -> DataFrame:
    """As ``tokens.encode_pair``, over the tokeniser's ids and control ids."""
    x = df.withColumn("_pt", c(prompt)).withColumn("_ot", c(output))       # one column may be both
    x = token_ids(x, {"_pt": "_p_ids", "_ot": "_o_ids"}, tokenizer)
    return T.encode_pair(x, prompt, output, max_len, prompt_ids="_p_ids", output_ids="_o_ids", eos=eos, pad=pad) \
        .drop("_pt", "_ot", "_p_ids", "_o_ids")


# --------------------------------------------------------------------------- T3
def label_tokens(df: DataFrame, prompt: str, target: str, tokenizer: Callable, max_len: int, eos: int) -> DataFrame:
    """prompt + target encoded together and right-truncated; the label starts at
    the first token whose end passes the prompt's length; earlier labels are
    -100; ``eos`` is added when there is room."""
    plen = F.length(F.coalesce(c(prompt), F.lit("")))
    x = df.withColumn("_full", F.concat(F.coalesce(c(prompt), F.lit("")), F.coalesce(c(target), F.lit(""))))
    x = tokenise(x, "_full", tokenizer, "_t").withColumn("_ids", _cut("_t_ids", max_len))
    # ends never fall, so those within the prompt are the first ones
    inside = F.filter(F.zip_with("_t_ends", F.array_repeat(plen, F.size("_t_ends")), lambda z, p: z <= p), lambda b: b)
    n = F.size("_ids")
    x = x.withColumn("target_start", F.least(F.size(inside), n))
    ts, room = F.col("target_start"), n < max_len
    labels = F.concat(F.array_repeat(F.lit(-100), ts), F.slice("_ids", ts + 1, n - ts))
    end = F.array(F.lit(eos))
    return (x.withColumn("input_ids", F.when(room, F.concat("_ids", end)).otherwise(F.col("_ids")))
             .withColumn("labels", F.when(room, F.concat(labels, end)).otherwise(labels))
             .withColumn("truncated", F.size("_t_ids") > max_len)
             .drop("_full", "_ids", *[f"_t_{p}" for p in PARTS]))


# --------------------------------------------------------------------------- T4
def tag_response_tokens(df: DataFrame, prompt: str, span_a: str, span_b: str, tokenizer: Callable,
                        max_len: int | None = None, out: str = "response_types") -> DataFrame:
    """Type 1 / 2 for tokens whose [start, end) overlaps span A / span B (A
    first), else 0. Tokens and spans are both in order, so the tokens that meet
    a span are one index range: from the number of ends up to the span's start
    to the number of starts before its end. Only the types leave the stage."""
    spans = {f"_{side}{k}": F.when(F.col(span)["end"] > F.col(span)["start"], F.col(span)[part]).cast("int")
             for side, span in (("a", span_a), ("b", span_b)) for k, part in enumerate(("start", "end"))}

    bounds = list(spans)

    def tags(found, a0, a1, b0, b1):
        _, starts, ends = found
        types = [0] * len(ends)
        for kind, start, end in ((2, b0, b1), (1, a0, a1)):              # A is written last
            if start is not None:
                first, past = bisect_right(ends, start), bisect_left(starts, end)
                types[first:past] = [kind] * (past - first)
        return types if max_len is None else types[:max_len]

    def work(encode, column):
        found = encode([t or "" for t in column("_prompt")])
        return [[tags(*row) for row in zip(found, *[column(n) for n in bounds])]]

    x = df.withColumn("_prompt", c(prompt)).withColumns(spans)
    return _stage(x, tokenizer, ["_prompt", *spans], [("_types", INTS)], work) \
        .withColumn(out, F.col("_types")).drop("_types")
