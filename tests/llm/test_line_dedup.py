import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefeval.llm.line_dedup import apply_bitmaps, keep_bitmaps, mark_runs

BLANKS = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, shortest=20, least=3):
    rank = lambda k: (k is not None, k)
    held = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            k = lower(line.strip(BLANKS))
            if len(k) >= shortest:
                held.setdefault(k, set()).add(key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            docs = held.get(lower(line.strip(BLANKS)), set())
            if len(docs) < least or key == max(docs, key=rank):
                keep.append(line)
        out.append((key, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def run(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, digest string, n_lines int")
    df = df.repartition(parts)
    got = apply_bitmaps(df, keep_bitmaps(df, **kw))
    return sorted([tuple(r) for r in got.collect()], key=str)


COMMON = "A line that MANY documents share"
ROWS = [(k, f"own line of document {k} alone\n  {COMMON}\t\n{COMMON.lower()}\r\nshort\n" + "\n" * (k % 3)) for k in range(40)] + [
    (100, None), (101, ""), (102, "\n"), (103, "short line\n" * 9), (104, "short line\n" * 9), (105, "short line\n" * 9),
    (7, "another text of document seven\n" + COMMON), (7, "another text of document seven\n" + COMMON), (None, COMMON),
    (None, "a line of documents without id"), (None, "a line of documents without id"), (3, "a line of documents without id"),
    (2, "a line of documents without id"), (200, "ÄÖÜ" * 7), (201, "ÄÖÜ" * 7), (202, "äöü" * 7), (203, "ÄÖÜ" * 7),
    (204, "é" * 19), (205, "é" * 19), (206, "é" * 19), (207, "é" * 20), (208, "é" * 20), (209, "é" * 20 + "\x1c"),
    (210, "　" + "é" * 20), (211, "é" * 20), (300, "x" * 100_000), (301, "x" * 100_000), (302, "y\n" * 30_000 + "x" * 100_000)]


def test_against_plain_version(spark):
    assert run(spark, ROWS) == plain(ROWS)
    assert run(spark, ROWS, shortest=5, least=2) == plain(ROWS, 5, 2)


@pytest.mark.parametrize("parts", [1, 23])
def test_any_number_of_partitions(spark, parts):
    """A key in every document spreads over neighbour partitions."""
    rows = [(k % 90, f"{COMMON}\n{COMMON}\nthis line is in some documents {k % 7}\nx") for k in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert run(spark, rows, parts=7) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmaps_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    maps = {(r.doc_id, r.digest): r for r in keep_bitmaps(df).collect()}
    assert len(maps) == len({(k, t or "") for k, t in ROWS})
    for k, n, d, _ in plain(ROWS):
        assert any(r.n_lines == n and r.n_dropped == d and np.unpackbits(
            np.frombuffer(zlib.decompress(r.keep), np.uint8), count=n).sum() == n - d
            for (key, _), r in maps.items() if key == k)
    none = df.limit(0)
    assert apply_bitmaps(none, keep_bitmaps(none)).count() == 0
    text_ids = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("doc_id is not null")
    got = apply_bitmaps(text_ids, keep_bitmaps(text_ids), digest_only=True).collect()
    want = plain([(r.doc_id, r.text) for r in text_ids.collect()])
    assert sorted((r.doc_id, r.kept_sha256) for r in got) == sorted((w[0], hashlib.sha256(w[3].encode()).hexdigest()) for w in want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=40), st.integers(1, 5), st.integers(1, 4), st.integers(1, 4))
def test_runs_over_batches_and_partitions(lines, width, cuts, least):
    """Streaming the sorted lines cut anywhere equals grouping them whole."""
    rows = sorted(((h, h, d, 0, i) for i, (h, d) in enumerate(lines)), key=lambda r: (r[0], -r[2], r[4]))
    want = set()
    for h in {r[0] for r in rows}:
        docs = {r[2] for r in rows if r[0] == h}
        if len(docs) >= least:
            want |= {r[4] for r in rows if r[0] == h and r[2] != max(docs)}
    size = -(-len(rows) // cuts) or 1
    got, opened, sums = set(), [], {}
    for part, at in enumerate(range(0, len(rows), size)):
        chunk = rows[at:at + size]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk[k:k + width])],
                                              names=["h1", "h2", "doc_id", "digest", "pos"])
                   for k in range(0, len(chunk), width)]
        for out in mark_runs(iter(batches), least):
            for h, _, d, _, pos, state, docs, top, last in out:
                if state == 0:
                    got.add(pos)
                elif state == 1:
                    opened.append((h, d, pos))
                else:
                    sums.setdefault(h, []).append((docs, top, last))
    for h, d, pos in opened:
        s = sums[h]
        total = sum(x[0] for x in s) - sum(x[2] == y[1] for x, y in zip(s, s[1:]))
        if total >= least and d != s[0][1]:
            got.add(pos)
    assert got == want
