"""Best-two-fit packing of token pieces into sequences of bounded length.

Every document is encoded, ended with one separator id and cut into pieces of
at most ``capacity`` tokens. Pieces are spread over shards of about
``shard_rows`` rows and each shard is packed on its own: a bin is filled
greedily with the largest piece that fits; then its smallest piece is
replaced by two unpacked pieces if they fill the widened gap more tightly.
A shard leaves a bin or two half empty, against some ten thousand full ones.

Edge cases: a null text is the empty text and gives one piece holding only the
separator; null or repeated ids are kept, every row is packed by itself; an
empty table gives no rows; columns other than the id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_bytes, materialize, slices, worker_cache

CACHE_WORDS = 600_000
LONG_WORD = 64
# lower-case Latin letters, then ASCII punctuation without the apostrophe: the
# tokenizer cuts between the two, so they can be encoded apart
LETTERS_MARKS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")


class WordIds(dict):
    """Little-endian ids of blank-separated words, each encoded once while it
    is in use: when full, words not met since the last time are forgotten."""

    def __init__(self, tokenizer, most: int = CACHE_WORDS):
        self.tokenizer, self.most, self.older = tokenizer, most, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = LETTERS_MARKS.fullmatch(word)
            ids = self[parts[1]] + self[parts[2]] if parts else np.array(
                self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _words(text: bytes) -> list:
    """The tokenizer lower-cases all but its control strings."""
    return (text if b"<|" in text else text.lower()).split()


def _load(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text.

    The tokenizer drops white space and no token spans it, so a text's ids are
    those of its ASCII-blank-separated words in turn; each distinct word is
    encoded once per worker."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches):
        known = worker_cache(f"words {cache_words} {tokenizer_path}", lambda: WordIds(_load(tokenizer_path), cache_words))
        step = 4 * capacity
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    buf = b"".join([known[w] for w in _words(text)]) + end
                    for k, at in enumerate(range(0, len(buf), step)):
                        part = buf[at:at + step]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()),
                     *[pa.array(c, pa.int64()) for c in cols[2:]]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (all between 1 and capacity)."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    nxt = np.cumsum(count)                       # end of each length's run in ``order``
    have = np.where(count > 0, np.arange(capacity + 1), 0)
    fits = np.maximum.accumulate(have)           # largest unpacked length <= i
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, number = len(lengths), 0

    def take(n: int) -> None:
        nonlocal left, fits
        count[n] -= 1
        left -= 1
        if not count[n]:
            have[n] = 0
            fits = np.maximum.accumulate(have)

    def put_back(n: int) -> None:
        nonlocal left, fits
        count[n] += 1
        left += 1
        if count[n] == 1:
            have[n] = n
            fits = np.maximum.accumulate(have)

    while left:
        content, gap = [], capacity
        while gap and (n := int(fits[gap])):
            take(n)
            content.append(n)
            gap -= n
        if gap and left and len(content) > 1:    # swap the smallest for two that fit more tightly
            small = content[-1]
            first = np.flatnonzero(have[:gap + small])
            second = fits[gap + small - first]
            ok = (second > 0) & ((second != first) | (count[first] > 1))
            total = np.where(ok, first + second, 0)
            if len(total) and total[best := int(total.argmax())] > small:
                content[-1:] = [int(second[best]), int(first[best])]
                put_back(small)
                take(content[-1])
                take(content[-2])
        at = 0
        for n in content:
            nxt[n] -= 1
            row = order[nxt[n]]
            bins[row], offsets[row] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a *stored* table of pieces.

    Shards are dealt by row number within the stored files, never by a key, so
    no repeated id can fill one."""
    shards = max(1, math.ceil(pieces.count() / shard_rows))
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["_shard"].iloc[0])
        frame = frame.drop(columns="_shard").sort_values(["doc_id", "piece"], kind="stable")
        bins, offsets = best_two_fit(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=shard * (1 << 32) + bins, offset=offsets)

    row = F.monotonically_increasing_id()
    return pieces.withColumn("_shard", F.pmod(F.xxhash64(row), F.lit(shards))) \
        .groupBy("_shard").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0,
                   shard_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
                   cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of every document with their place in the packed sequences. A
    worker keeps the ids of ``cache_words`` words in use, and of as many that
    were before: fewer take more time and less memory."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, separator, id_col, text_col, cache_words), "pieces")
    return pack(pieces, capacity, shard_rows)
