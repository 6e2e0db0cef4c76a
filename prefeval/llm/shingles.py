"""Near-duplicate classes: n-gram Jaccard join with several token orders.

Texts are sets of distinct 5-word shingles (A-Z lower-cased, words between
ASCII blanks). Two sets whose Jaccard similarity is 0.8 or more share a token
among their first ``n - ceil(0.8 n) + 1`` tokens under *any* global token
order. Candidates must share one under every one of three orders; then their
texts are compared.

1. One pass counts every shingle of the corpus in a fixed-size sketch. All
   three orders put rare shingles first (by the sketch's octave) and break
   ties by hashes of their own, so widely shared passages come last.
2. A second pass writes one row per document: size, 64-bit fingerprint of the
   set (the *class*; equal sets meet here) and its prefix under the first order.
   Classes that meet another get their prefixes under the other two orders.
3. Classes that meet in a token of the first order are paired with one head
   of that token only, the class with the fewest rarer tokens. The filters of the other orders are intersected,
   then the texts are verified and the links give first components.
4. What still meets in a token across two components is paired in full (if
   its place in both prefixes leaves room for a link), filtered and verified the same way: no link between components is lost,
   and no group of copies is ever expanded into its pairs.

Tokens and classes are 64-bit hashes; a wrong link needs two of them to clash.

Edge cases: null or blank texts have no shingles, a class of their own row and
no links; fewer than five words are one shingle; repeated rows are members of
one class; a null id never names a component unless all its members are null;
rows with equal ids and different texts are separate; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_bytes, materialize, slices, worker_release
from prefeval.llm.components import components

WORDS = 5
SKETCH_BITS = 21          # 2M counters: the size of everything that is broadcast
SKETCH_PARTS = 32
CHUNK = 1 << 20           # bytes hashed at a time
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_random = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
BYTE_VALUES = np.where(np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r")), np.uint64(0), _random | np.uint64(1))


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(ODD[seed % 5])
    return (h ^ (h >> np.uint64(32))) * np.uint64(ODD[(seed + 2) % 5])


def powers(n: int) -> np.ndarray:
    """ODD[0] ** k for k < n."""
    out = np.ones(max(n, 2), np.uint64)
    out[1:] = np.uint64(ODD[0])
    return np.cumprod(out, dtype=np.uint64)[:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word between ASCII blanks, A-Z lower-cased: the
    sum over a word's bytes of a random value times a power of its place."""
    value = BYTE_VALUES[np.frombuffer(text.lower(), np.uint8)]
    inside = np.flatnonzero(value)
    if not len(inside):
        return inside, np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)      # in ``inside``
    size = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, size)
    return inside[first], mix(np.add.reduceat(value[inside] * powers(int(size.max()))[place], first), 4)


def chunks(texts: list):
    """Runs of texts of about CHUNK bytes together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def shingle_sets(texts: list) -> list:
    """Sorted distinct shingle hashes of each text (bytes)."""
    out = []
    for some in chunks(texts):
        starts, words = word_hashes(b"\n".join(some))
        ends = np.cumsum([len(t) + 1 for t in some])
        cuts = np.searchsorted(starts, ends).tolist()
        whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS if len(whole) else 0):
            whole += words[k:k + len(whole)] * np.uint64(ODD[k])
        whole = mix(whole + np.uint64(WORDS), 3)
        a = 0
        for z in cuts:
            if z - a >= WORDS:
                out.append(np.unique(whole[a:z - WORDS + 1]))
            elif z > a:
                short = (words[a:z] * np.array(ODD[:z - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
                out.append(mix(short + np.uint64(z - a), 3))
            else:
                out.append(np.empty(0, np.uint64))
            a = z
    return out


def fingerprint(s: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None


def prefix_length(n: int) -> int:
    """n - ceil(0.8 n) + 1"""
    return n - (4 * n + 4) // 5 + 1


def count_sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """Octave of every counter of the corpus sketch. Tasks add up their own
    counts and emit them in parts; the parts are summed by Spark. Only the
    final 2**SKETCH_BITS octaves (one byte each) reach the driver."""
    size = 1 << (SKETCH_BITS - SKETCH_PARTS.bit_length() + 1)
    shift = np.uint64(64 - SKETCH_BITS)

    def count(batches):
        worker_release()
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(as_bytes(batch.column(0)))
                at = np.concatenate(sets) >> shift if sets else np.empty(0, np.uint64)
                total += np.bincount(at.astype(np.int64), minlength=len(total))
        if total.any():
            packed = [zlib.compress(total[k * size:(k + 1) * size].astype("<i8").tobytes(), 1)
                      for k in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())],
                                             names=["part", "counts"])

    def add(batches):
        sums: dict = {}
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(packed), "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())],
                names=["part", "counts"])

    schema = "part int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema)
    # sums over the tasks in two steps, so that no task reads all of them
    salted = parts.repartition(4 * SKETCH_PARTS, "part", F.crc32("counts")).mapInArrow(add, schema)
    octave = np.zeros(1 << SKETCH_BITS, np.uint8)
    for part, packed in salted.repartition(SKETCH_PARTS, "part").mapInArrow(add, schema).collect():
        c = np.frombuffer(zlib.decompress(packed), "<i8")
        octave[part * size:(part + 1) * size] = np.floor(2 * np.log2(np.maximum(c, 1)))
    return octave


def ranks(s: np.ndarray, rare: np.ndarray, order: int) -> np.ndarray:
    """Place of each token in a global order: octave, then a hash of its own."""
    top = rare[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57)
    return top | (mix(s, order) >> np.uint64(7))


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)))


def prefix_table(docs: DataFrame, octave, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, n, node, and the set's prefix under the first order
    (none if the set was seen before in the same task)."""
    src = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                      F.col(text_col).alias("text"))
    schema = f"doc_id {src.schema[0].dataType.simpleString()}, row_key long, n long, node long, prefix array<long>"

    def run(batches):
        worker_release()
        rare, seen = octave.value, set()
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for s in shingle_sets(as_bytes(batch.column(2))):
                    node, prefix = fingerprint(s), None
                    if node is not None and node not in seen:
                        seen.add(node)
                        k = prefix_length(len(s))
                        rank = ranks(s, rare, 0)
                        first = np.argpartition(rank, k - 1)[:k]
                        prefix = s[first[np.argsort(rank[first])]].view(np.int64)
                    rows.append((len(s), node, prefix))
                n, node, prefix = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "row_key", "n", "node", "prefix"])

    return src.mapInArrow(run, schema)


def members_of(docs: DataFrame, wanted: DataFrame, octave, id_col: str, text_col: str) -> DataFrame:
    """node, n, p2, p3 (prefixes under the other orders, 32 bits a token) and
    text of every class in ``wanted`` (node, row_key, rows under that key)."""
    def run(batches):
        worker_release()
        rare = octave.value
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for node, s in zip(batch.column(0).to_pylist(), shingle_sets(as_bytes(batch.column(1)))):
                    if fingerprint(s) != node:       # another row under the same key
                        rows.append((0, None, None))
                        continue
                    k = prefix_length(len(s))
                    rows.append((len(s), *[(s[np.argpartition(ranks(s, rare, o), k - 1)[:k]] >> np.uint64(32))
                                           .astype(np.uint32).view(np.int32) for o in (1, 2)]))
                n, p2, p3 = zip(*rows)
                kind = pa.list_(pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(p2, kind), pa.array(p3, kind), batch.column(1)],
                    names=["node", "n", "p2", "p3", "text"])
                yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).join(wanted, "row_key")
    made = lambda x: x.select("node", "text").mapInArrow(
        run, "node long, n long, p2 array<int>, p3 array<int>, text string")
    # only rows that share a key can be equal: those alone are shuffled again
    return made(rows.filter("rows = 1")).unionByName(made(rows.filter("rows > 1")).dropDuplicates(["node"]))


def size_ok(n: str, m: str):
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m})")


def same_prefix(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) that also share prefix tokens under the other two orders."""
    side = lambda x: prefixes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"),
                                     F.col("p2").alias(f"p2_{x}"), F.col("p3").alias(f"p3_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(size_ok("n_a", "n_b")) \
        .filter(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose texts reach the similarity, by their whole shingle sets."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 128):
                left, right = (shingle_sets(as_bytes(batch.column(i))) for i in (2, 3))
                keep = []
                for x, y in zip(left, right):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= 80 * (len(x) + len(y) - both))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b") \
        .mapInArrow(run, "a long, b long")


def across(placed: DataFrame) -> DataFrame:
    """Pairs of nodes of different roots that meet in a token and can link.

    At the first token that two sets share, what they have in common is at
    most what either has from there on; a link needs 4/9 of the sizes' sum. So
    a row is of use only if its rest is long enough for the smallest set of
    its token, and a pair only if both rests are long enough for the two."""
    def still(rows):
        of = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least_n")) \
            .filter("lo < hi")
        return rows.join(of, "token").filter("9 * (n - pos) >= 4 * (n + greatest(least_n, ceil(0.8 * n)))") \
            .select("token", "node", "n", "pos", "root")

    placed = materialize(still(still(placed)), "placed")
    a, b = placed.alias("a"), placed.alias("b")
    return a.join(b, F.expr("a.token = b.token AND a.root < b.root")) \
        .filter(size_ok("a.n", "b.n")).filter("9 * least(a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)") \
        .select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")).distinct()


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n, node per row; node, root of every linked class)."""
    octave = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, text_col))
    table = materialize(prefix_table(docs, octave, id_col, text_col), "prefixes")

    # tokens of the first order in which two classes meet
    tokens = table.filter("prefix is not null").select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    meet = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")) \
        .filter("lo < hi").select("token")
    shared = materialize(tokens.join(meet.hint("shuffle_hash"), "token"), "shared")
    wanted = table.filter("prefix is not null").join(shared.select("node").distinct(), "node", "left_semi") \
        .groupBy("node").agg(F.min("row_key").alias("row_key"))
    wanted = wanted.join(table.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")), "row_key")
    members = materialize(members_of(docs, wanted, octave, id_col, text_col), "members")

    # first links: with the class that has the fewest rarer tokens before the
    # shared one, the least changed of a group of copies
    heads = shared.groupBy("token").agg(F.min(F.struct("pos", "node"))["node"].alias("head"))
    first = shared.join(heads, "token").filter("node <> head") \
        .select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    tried = materialize(same_prefix(first, members), "pairs")
    links = materialize(verified(tried, members), "links")
    roots = materialize(components(links, "a", "b"), "roots")

    # the rest: every pair that still meets across two components
    rest = across(shared.join(roots, "node", "left").select(
        "token", "node", "n", "pos", F.coalesce("root", "node").alias("root")).distinct())
    rest = materialize(same_prefix(rest.join(tried, ["a", "b"], "left_anti"), members), "pairs")
    more = materialize(verified(rest, members), "links")
    if more.take(1):
        roots = components(links.unionByName(more), "a", "b")
    return table.drop("prefix"), roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) per row."""
    table, roots = classes_of(docs, id_col, text_col)
    least = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id")) \
        .join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = least.join(least.groupBy("root").agg(F.min("id").alias("component_id")), "root") \
        .select("node", "component_id")
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id"))
                      .otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each component: that with the
    least id (null last). Rows without shingles all stay."""
    table, roots = classes_of(docs, id_col, text_col)
    placed = table.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.filter("node is not null").groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "node")).alias("b")).select("b.row_key", "b.node")
    keys = placed.groupBy("row_key").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("node").isNull()).alias("_blank")) \
        .join(best.groupBy("row_key").agg(F.collect_set("node").alias("_kept")), "row_key", "left") \
        .filter("_blank > 0 OR _kept IS NOT NULL")
    keys = materialize(keys, "kept")
    rows = docs.withColumn("row_key", row_key(id_col, text_col)).join(keys, "row_key")
    names, schema = docs.columns, docs.schema.simpleString()[7:-1]
    once = rows.filter("_rows = 1").select(*names)

    def run(batches):                    # rows under one key: tell them apart by their sets
        for whole in batches:
            for batch in slices(whole):
                nodes = [fingerprint(s) for s in shingle_sets(as_bytes(batch.column(text_col)))]
                keep = [n is None or n in (k or ()) for n, k in zip(nodes, batch.column("_kept").to_pylist())]
                yield batch.drop_columns(["_rows", "_blank", "_kept"]).append_column("_node", pa.array(nodes, pa.int64())) \
                    .filter(pa.array(keep, pa.bool_()))

    again = rows.filter("_rows > 1").select(*names, "row_key", "_rows", "_blank", "_kept") \
        .mapInArrow(run, f"{schema},row_key:bigint,_node:bigint")
    again = again.filter("_node is null").unionByName(
        again.filter("_node is not null").dropDuplicates(["row_key", "_node"])).select(*names)
    return once.unionByName(again)
