"""Proxy metrics, quantile bins and histograms (M ops).

Per-row metrics are array expressions; corpus models (bigram NLL) and
quantiles are shuffles with partial aggregation; vector statistics explode
dimensions (bounded per row) and aggregate, or build one Gramian per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefeval.functions.keys import dense_index
from prefeval.functions.text import c, count_below, py_strip, repeat_for, words

# Default bin edges of the proxy tasks when quantiles cannot be
# computed (fallback edges).
DEFAULT_LENGTH_BINS = (0, 50, 100, 200, 400, 1000000)
DEFAULT_TTR_BINS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
DEFAULT_NLL_BINS = (0.0, 2.3026, 2.9957, 3.6889, 4.3820, 5.0752, 13.8155)


# --------------------------------------------------------------------------- M1
def length_ttr(col) -> Column:
    """struct(length, ttr): whitespace tokens and distinct / total (0 if empty)."""
    toks = words(F.coalesce(c(col), F.lit("")))
    n = F.size(toks)
    ttr = F.when(n > 0, F.size(F.array_distinct(toks)) / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("length"), ttr.cast("double").alias("ttr"))


# --------------------------------------------------------------------------- M2
CHUNK_CHARS = 8_000_000    # text of a chunk of rows


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words (as ``words``) in order of appearance, and the word and the text of every token."""
    split = pc.utf8_split_whitespace(texts)
    found, owner = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    full = pc.not_equal(found, "").to_numpy(zero_copy_only=False)      # blank ends split off empty words
    if not full.all():
        found, owner = found.filter(pa.array(full)), owner[full]
    found = found.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), owner


def word_hash(found: pa.Array) -> np.ndarray:
    """A number per word, from its bytes; it only deals words to shards."""
    if not len(found):
        return np.zeros(0, np.uint64)
    found = pa.concat_arrays([found])
    at = np.frombuffer(found.buffers()[1], np.int32)[found.offset:][:len(found) + 1]
    data, size, starts = np.frombuffer(found.buffers()[2], np.uint8)[at[0]:at[-1]], np.diff(at), at[:-1] - at[0]
    power = np.cumprod(np.full(size.max(), 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat(data * power[np.arange(len(data)) - np.repeat(starts, size)], starts)


class ChunkPairs:
    """The pairs of a chunk with their counts, and each word with the empty word
    for all pairs that it begins, dealt to shards. The order depends on the
    distinct texts alone, so sums come back without words."""

    def __init__(self, texts: pa.Array, times: np.ndarray, shards: int):
        found, code, owner = text_words(texts)
        follows = owner[1:] == owner[:-1]
        self.owner, prev, word = owner[1:][follows], code[:-1][follows], code[1:][follows]
        pairs, self.pair = np.unique(prev << 32 | word, return_inverse=True)
        n = len(found)
        self.prev, self.word = np.append(pairs >> 32, np.arange(n)), np.append(pairs & 0xFFFFFFFF, np.full(n, n))
        self.begun = len(pairs) + (pairs >> 32)                         # where the sum for a pair's first word stands
        self.words = pa.concat_arrays([found, pa.array([""], found.type)])
        weight = times[self.owner]
        self.n = np.append(np.bincount(self.pair, weight, len(pairs)), np.bincount(prev, weight, n)).astype(np.int64)
        h = np.append(word_hash(found), np.uint64(0))
        h = (h[self.prev] ^ h[self.word] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
        shard = (h % np.uint64(shards)).astype(np.min_scalar_type(shards))      # 16 bits sort by digits
        self.order = np.argsort(shard, kind="stable")
        self.cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=shards)))


def chunk_rows(batches) -> tuple:
    """Of a chunk: sorted distinct texts, the text of each row, keys, and the
    sums sent back with the size of the vocabulary. Copies are held once."""
    seen, at, keys, back = pa.array([], pa.string()), [], [], {}
    for b in batches:
        if "_shard" in b.schema.names:
            sent = b.filter(pc.is_valid(b.column("_shard")))
            for s, sums, vocab in zip(*(sent.column(x) for x in ("_shard", "_sums", "_vocab"))):
                back[s.as_py()] = sums.values.to_numpy(), vocab.as_py()
            b = b.filter(pc.is_null(b.column("_shard")))
        keys.append(b.column("_key"))
        text = b.column("_text").dictionary_encode()
        seen = pc.unique(pa.concat_arrays([seen, text.dictionary]))
        at.append(pc.index_in(text.dictionary, seen).to_numpy()[text.indices.to_numpy()])
    order = pc.sort_indices(seen)
    place = np.empty(len(seen), np.int64)
    place[order.to_numpy()] = np.arange(len(seen))
    return seen.take(order), place[np.concatenate(at)], pa.concat_arrays(keys), back


def pair_counts(dealt: DataFrame, shards: int, counts: bool, asks: bool) -> DataFrame:
    """A row for each chunk and shard, with the chunk's pairs that are summed
    there, as lines 'prev word', and their counts."""
    def run(chunk: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, at, *_ = chunk_rows(batches)
        p, zstd = ChunkPairs(texts, np.bincount(at, minlength=len(texts)), shards), pa.Codec("zstd", 1)
        cuts = pa.array(p.cuts, pa.int32())
        line = pc.binary_join_element_wise(*(p.words.take(pa.array(x[p.order])) for x in (p.prev, p.word)), " ")
        lines = pc.binary_join(pa.ListArray.from_arrays(cuts, line), "\n")
        n = pa.ListArray.from_arrays(cuts, pa.array(p.n[p.order] if counts else np.zeros(len(p.n), np.int64)))
        yield pa.RecordBatch.from_pydict({
            "_chunk": pa.array([chunk[0].as_py()] * shards, pa.int32()), "_shard": pa.array(range(shards), pa.int32()),
            "_counts": [counts] * shards, "_asks": [asks] * shards, "_n": n, "_bytes": pc.binary_length(lines),
            "_lines": [zstd.compress(x.as_buffer(), asbytes=True) for x in lines]})
    return dealt.groupBy("_chunk").applyInArrow(
        run, "_chunk int, _shard int, _counts boolean, _asks boolean, _n array<long>, _bytes int, _lines binary")


def pair_sums(sent: DataFrame) -> DataFrame:
    """For each row that asks, the sums over all chunks in its order, and the
    number of words of the corpus that the shard knows."""
    def run(rows: pa.Table) -> pa.Table:
        rows, zstd = rows.combine_chunks(), pa.Codec("zstd")
        size = pc.list_value_length(rows["_n"]).to_numpy()
        lines = [zstd.decompress(x.as_buffer(), n, asbytes=True) for x, n, k in zip(rows["_lines"], rows["_bytes"].to_pylist(), size) if k]
        found = pc.split_pattern(pa.array(lines, pa.binary()).cast(pa.string()), "\n").flatten().dictionary_encode()
        at = found.indices.to_numpy()
        sums = np.bincount(at, pc.list_flatten(rows["_n"]).to_numpy()).astype(np.int64)[at]
        begun = pc.ends_with(found.dictionary, " ").to_numpy(zero_copy_only=False)
        known = np.repeat(rows["_counts"].to_numpy(), size) & begun[at]
        out = {"_chunk": rows["_chunk"], "_shard": rows["_shard"],
               "_sums": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(sums)),
               "_vocab": np.full(len(size), len(np.unique(at[known])))}
        return pa.table(out).filter(rows["_asks"])
    return sent.groupBy("_shard").applyInArrow(run, "_chunk int, _shard int, _sums array<long>, _vocab long")


def token_nll(df: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text",
              k: float = 1.0, out: str = "nll") -> DataFrame:
    """Mean of -ln p(word | prev) over tokens 2..n, add-k bigram model counted
    on ``corpus``; fewer than two tokens -> 0.

    Rows are dealt to chunks of bounded text by a hash. A chunk counts its
    pairs and sends each once, packed as lines of text, to the shard where the
    pair is summed over all chunks. The sums come back in the order sent to the
    chunk's texts, which are split again and add up their pairs. A hot pair
    sends a line per chunk, not per text, and pairs with a hot first word are
    spread over all shards. Words are compared as text; their hash only deals."""
    one = corpus is df
    chars = F.coalesce(F.sum(F.length(text).cast("double")), F.lit(0.0)).alias("n")
    chunks = 1 + int(max(x.agg(chars).first().n for x in ([df] if one else [df, corpus])) / CHUNK_CHARS)
    parts = max(chunks, min(4 * chunks, 64))    # so that of few chunks no two share a partition
    valid = F.coalesce(F.make_valid_utf8(F.col(text).cast("string")), F.lit("")).alias("_text")

    def dealt(x, key):
        x = x.select(key.alias("_key"), valid)
        return x.withColumn("_chunk", F.pmod(F.xxhash64("_key", "_text"), F.lit(chunks)).cast("int")).repartition(parts, "_chunk")

    asked = dealt(df, F.col(key))
    sent = pair_counts(asked, chunks, one, True)
    if not one:
        sent = sent.unionByName(pair_counts(dealt(corpus, F.lit(0)), chunks, True, False))
    back = pair_sums(sent.repartition(parts, "_shard")).repartition(parts, "_chunk")
    strict = df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, at, keys, back = chunk_rows(batches)
        p = ChunkPairs(texts, np.bincount(at, minlength=len(texts)), chunks)
        sums = np.empty(len(p.n), np.int64)
        sums[p.order] = np.concatenate([back[s][0] for s in range(chunks)])
        above, below = sums[:len(p.begun)] + k, sums[p.begun] + k * sum(vocab for _, vocab in back.values())
        if strict and not below.all():
            raise ZeroDivisionError("k is 0 or the corpus has no words, and it does not have a first word")
        some = (above > 0) & (below > 0)         # others are null in SQL, no part of the mean
        nlp = -np.log(np.divide(above, below, where=some, out=np.ones(len(some))))
        total, n = (np.bincount(p.owner, x[p.pair], len(texts))[at].astype(float) for x in (nlp, some))
        yield pa.RecordBatch.from_pydict({"_key": keys, "_sum": total, "_n": n}).filter(pa.array(n > 0))

    both = asked.unionByName(back, allowMissingColumns=True)     # one exchange of the texts serves both uses
    fields = [asked.schema["_key"], T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.DoubleType())]
    per = both.groupBy("_chunk").applyInArrow(run, T.StructType(fields))
    per = per.groupBy(F.col("_key").alias(key)).agg((F.sum("_sum") / F.sum("_n")).alias(out))
    return df.select(key).join(per, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


# --------------------------------------------------------------------------- M3 / M4
def backfill_proxy(df: DataFrame, key: str = "row_id", text: str = "response_A", side: str = "A",
                   overwrite: bool = False) -> DataFrame:
    """Fill missing proxy metrics of one side: nll from ln(ppl) when missing;
    length / ttr computed (M1) only for rows that miss them (or all rows with
    ``overwrite``); blank responses are skipped. The expensive branch runs on
    the missing subset only (filter + union), so Catalyst prunes the rest."""
    ln, lt = f"proxy_length_{side}", f"proxy_ttr_{side}"
    nll, ppl = f"proxy_nll_{side}", f"proxy_ppl_{side}"
    x = df
    if nll in x.columns and ppl in x.columns:
        x = x.withColumn(nll, F.coalesce(F.col(nll), F.when(F.col(ppl) > 0, F.log(F.col(ppl)))))
    blank = F.coalesce(py_strip(c(text)), F.lit("")) == ""
    need = F.lit(True) if overwrite else (F.col(ln).isNull() | F.col(lt).isNull())
    todo = x.filter(need & ~blank)
    done = x.filter(~(need & ~blank))
    m = length_ttr(text)
    todo = todo.withColumn(ln, m["length"].cast("double")).withColumn(lt, m["ttr"])
    return done.withColumn("computed", F.lit(False)).unionByName(todo.withColumn("computed", F.lit(True)))


def merge_proxy_cache(df: DataFrame, cache: DataFrame, key: str = "row_id",
                      fields=("nll",)) -> tuple[DataFrame, DataFrame]:
    """Fill only missing fields from the cache (left join on key); returns
    (merged rows, one-row alignment stats: data rows, cache rows, cache rows
    without data, data rows without cache)."""
    cj = cache.select(key, *[F.col(f).alias(f"_cache_{f}") for f in fields])
    merged = df.join(cj, key, "left")
    for f in fields:
        merged = merged.withColumn(f, F.coalesce(F.col(f), F.col(f"_cache_{f}"))).drop(f"_cache_{f}")
    both = df.select(key, F.lit(1).alias("_d")).join(cache.select(key, F.lit(1).alias("_c")), key, "full_outer")
    stats = both.agg(F.count("_d").alias("data_rows"), F.count("_c").alias("cache_rows"),
                     F.count(F.when(F.col("_d").isNull(), 1)).alias("cache_only"),
                     F.count(F.when(F.col("_c").isNull(), 1)).alias("data_only"))
    return merged, stats


# --------------------------------------------------------------------------- M5
def quantile_edges(df: DataFrame, col: str, k: int, lengths: bool = False,
                   fallback=DEFAULT_LENGTH_BINS, exact: bool = True) -> DataFrame:
    """Bin edges [min (0 for lengths)] + k-1 nearest-rank cuts + [max].

    Cut i is the value at sorted position ceil(i/k * n) - 1. Exact: equal
    values are counted first, running counts over the distinct values come
    from ``dense_index`` (bucketed windows, no single-task sort), and each
    distinct value emits the wanted positions its count range covers.
    ``exact=False`` uses ``percentile_approx`` for very large inputs. Nulls and
    NaN are left out; no values or k < 2 gives the fallback edges."""
    spark = df.sparkSession
    if k < 2:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(fallback)], "edge_idx int, edge double")
    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = vals.agg(F.count(F.lit(1))).scalar()
    if not exact:
        qs = [i / k for i in range(1, k)]
        row = vals.agg(F.min("v").alias("lo"), F.percentile_approx("v", qs, 10000).alias("q"),
                       F.max("v").alias("hi"))
        return row.select(F.posexplode(F.concat(F.array(F.lit(0.0) if lengths else F.col("lo")),
                                                F.col("q"), F.array(F.col("hi"))))
                          .alias("edge_idx", "edge"))
    # equal values collapse into one (value, count) row first, so a value
    # that fills a third of the column is one row, not a hot bucket
    vc = vals.groupBy("v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = dense_index(vc, [], ["v"], name="_before", weight="_n")
    pos = [F.lit(0).cast("long")] + \
        [F.least(F.greatest(F.ceil(F.lit(i / float(k)) * n) - 1, F.lit(0)), n - 1) for i in range(1, k)] + \
        [(n - 1).cast("long")]
    hits = F.array(*[F.when((p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")), F.lit(i))
                     for i, p in enumerate(pos)])
    picked = (ranked.select("v", F.explode(hits).alias("edge_idx")).filter(F.col("edge_idx").isNotNull())
                    .select(F.col("edge_idx").cast("int").alias("edge_idx"), F.col("v").alias("edge")))
    if lengths:
        picked = picked.withColumn("edge", F.when(F.col("edge_idx") == 0, F.lit(0.0)).otherwise(F.col("edge")))
    fb = spark.createDataFrame([(i, float(v)) for i, v in enumerate(fallback)], "edge_idx int, edge double")
    # no values -> fallback edges
    return picked.filter(n > 0).unionByName(fb.filter(n == 0))


# --------------------------------------------------------------------------- M6 / M7
def bucketize(col, edges) -> Column:
    """First i with e[i] <= v <= e[i+1] (an edge value goes to the lower bin);
    below the first edge -> 0, above the last -> last bin; < 2 edges -> 0.

    For sorted edges that is (number of edges strictly below v) - 1, clamped
    to [0, bins-1]: one small ``filter`` over the literal edge array."""
    v = c(col).cast("double")
    if len(edges) < 2:
        return F.when(v.isNotNull(), F.lit(0))
    below = count_below(edges, v)
    idx = F.least(F.greatest(below - 1, F.lit(0)), F.lit(len(edges) - 2))
    return F.when(v.isNotNull() & ~F.isnan(v), idx)


def soft_bin(col, edges, soft: bool = True) -> Column:
    """struct(label, target): target mass split linearly between bin i and
    i+1; the last bin, zero-width bins and hard mode put all mass on i;
    null / NaN -> label -100 and zeros; < 2 edges -> label -100, empty.
    The target is a literal-length ``array`` (no lambda), so the bin index is
    computed once per row by subexpression elimination."""
    nb = max(0, len(edges) - 1)
    v = c(col).cast("double")
    if nb <= 0:
        return F.struct(F.lit(-100).alias("label"), F.array().cast("array<double>").alias("target"))
    idx = bucketize(v, edges)
    e = F.array(*[F.lit(float(x)) for x in edges])
    left = F.element_at(e, idx + 1)
    right = F.element_at(e, F.least(idx + 2, F.lit(len(edges))))
    hard = (F.lit(not soft or nb == 1)) | (idx >= nb - 1) | (right <= left)
    ratio = F.least(F.greatest((v - left) / (right - left), F.lit(0.0)), F.lit(1.0))
    missing = v.isNull() | F.isnan(v)
    cells = []
    for j in range(nb):
        cells.append(F.when(missing, F.lit(0.0))
                      .when(hard, F.when(idx == j, F.lit(1.0)).otherwise(F.lit(0.0)))
                      .when(idx == j, 1.0 - ratio).when(idx + 1 == j, ratio).otherwise(F.lit(0.0)))
    return F.struct(F.when(missing, F.lit(-100)).otherwise(idx).alias("label"), F.array(*cells).alias("target"))


# --------------------------------------------------------------------------- M8
def proxy_labels(df: DataFrame, key: str = "row_id", length_bins=DEFAULT_LENGTH_BINS,
                 ttr_bins=DEFAULT_TTR_BINS, nll_bins=DEFAULT_NLL_BINS, soft: bool = True) -> DataFrame:
    """Per row and side: presence mask and (label, target) for length, ttr and
    nll. Length / ttr default to M1 on the side's own tokens; an absent
    response gets label -100 and zero targets."""
    sides = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"response_{s}").alias("text"),
                 (F.col(f"proxy_length_{s}") if f"proxy_length_{s}" in df.columns else F.lit(None).cast("double")).alias("plen"),
                 (F.col(f"proxy_ttr_{s}") if f"proxy_ttr_{s}" in df.columns else F.lit(None).cast("double")).alias("pttr"),
                 (F.col(f"proxy_nll_{s}") if f"proxy_nll_{s}" in df.columns else F.lit(None).cast("double")).alias("pnll"))
        for s in ("A", "B")]))
    x = df.select(key, sides.alias("_s")).select(key, "_s.*")
    present = F.coalesce(py_strip(F.col("text")), F.lit("")) != ""
    x = x.withColumn("present", present.cast("int")).withColumn("_m", length_ttr("text"))
    x = (x.withColumn("_len", F.when(present, F.coalesce(F.col("plen"), F.col("_m.length").cast("double"))))
          .withColumn("_ttr", F.when(present, F.coalesce(F.col("pttr"), F.col("_m.ttr"))))
          .withColumn("_nll", F.when(present, F.col("pnll"))))
    return (x.withColumn("length", soft_bin("_len", length_bins, soft))
             .withColumn("ttr", soft_bin("_ttr", ttr_bins, soft))
             .withColumn("nll", soft_bin("_nll", nll_bins, soft))
             .select(key, "side", "present", "length", "ttr", "nll"))


# --------------------------------------------------------------------------- M9 / M10 / M11
def bin_histogram(df: DataFrame, label: str = "label", target: str = "target", group=(), eps: float = 1e-8,
                  weight: str | None = None) -> DataFrame:
    """Sum of target vectors over labelled rows (``weight``: a column that
    counts how many equal rows a row stands for), probabilities and entropy
    per group: (group..., bin, mass, prob, entropy)."""
    group = list(group)
    times = F.lit(1) if weight is None else F.col(weight)
    x = df.filter(F.col(label) != -100).select(*group, times.alias("_times"), F.posexplode_outer(target).alias("bin", "w")) \
        .filter(F.col("bin").isNotNull())
    h = x.groupBy(*group, "bin").agg(F.sum(F.col("w") * F.col("_times")).alias("mass"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    h = h.withColumn("prob", F.col("mass") / F.greatest(F.sum("mass").over(w), F.lit(eps)))
    return h.withColumn("entropy", -F.sum(F.col("prob") * F.log(F.col("prob") + eps)).over(w))


def distribution_distance(hist: DataFrame, ref: DataFrame, group: str, nbins: int) -> DataFrame:
    """1-D Wasserstein between each group's bin distribution and a reference:
    sum |cdf - cdf_ref| over bins, and |mean bin - mean bin_ref|.
    ``hist``: (group, bin, prob); ``ref``: (bin, prob). Bins are a small
    literal range, so the reference is broadcast."""
    grid = hist.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    h = grid.join(hist.select(group, "bin", "prob"), [group, "bin"], "left").fillna(0.0, ["prob"])
    r = ref.select(F.col("bin").cast("int").alias("bin"), F.col("prob").alias("rprob"))
    x = h.join(F.broadcast(r), "bin", "left").fillna(0.0, ["rprob"])   # nbins rows
    w = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_cdf", F.sum("prob").over(w)).withColumn("_rcdf", F.sum("rprob").over(w))
    return x.groupBy(group).agg(
        F.sum(F.abs(F.col("_cdf") - F.col("_rcdf"))).alias("emd"),
        F.abs(F.sum(F.col("prob") * F.col("bin")) - F.sum(F.col("rprob") * F.col("bin"))).alias("mean_bin_diff"))


def soft_histogram(df: DataFrame, col: str, edges, group=()) -> DataFrame:
    """Per group: clamp to the edge range, give each value to bin idx (edge
    value -> lower bin) and idx+1 linearly (last bin hard), divide by the
    number of valid values: (group..., bin, share)."""
    group = list(group)
    nb = max(1, len(edges) - 1)
    e = F.array(*[F.lit(float(x)) for x in edges])
    v = F.least(F.greatest(F.col(col).cast("double"), F.lit(float(edges[0]))), F.lit(float(edges[-1])))
    # bucketize(right=False) - 1: number of edges strictly below v, minus 1
    below = count_below(edges, v) - 1
    idx = F.least(F.greatest(below, F.lit(0)), F.lit(nb - 1))
    left = F.element_at(e, idx + 1)
    right = F.element_at(e, F.least(idx + 2, F.lit(len(edges))))
    wr = F.least(F.greatest((v - left) / F.greatest(right - left, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    wr = F.when(idx == nb - 1, F.lit(0.0)).otherwise(wr)
    valid = F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))
    x = df.filter(valid).select(*group, idx.alias("_i"), wr.alias("_wr"))
    parts = x.select(*group, F.explode(F.array(
        F.struct(F.col("_i").alias("bin"), (1.0 - F.col("_wr")).alias("w")),
        F.struct(F.least(F.col("_i") + 1, F.lit(nb - 1)).alias("bin"), F.col("_wr").alias("w")))).alias("_p"))
    h = parts.groupBy(*group, "_p.bin").agg(F.sum("_p.w").alias("mass"))
    n = x.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        return h.join(n, group, "inner").select(*group, "bin", (F.col("mass") / F.col("_n")).alias("share"))
    return h.select("bin", (F.col("mass") / n.scalar()).alias("share"))


# --------------------------------------------------------------------------- M12 - M14
def with_standardised(df: DataFrame, vec: str, out: str = "_z", eps: float = 1e-6) -> DataFrame:
    """Layer norm of each vector: (x - mean) / sqrt(var_pop + eps).

    Sum and sum of squares come from one ``aggregate``; the per-element step
    reads (mean, scale) from a zipped repeat, never from an outer column
    (which Catalyst would inline and re-evaluate per element)."""
    n = F.size(vec)
    acc = F.aggregate(vec, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                      lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")))
    mean = acc["s"] / n
    var = F.greatest(acc["q"] / n - mean * mean, F.lit(0.0))
    st = F.struct(mean.alias("m"), F.sqrt(var + F.lit(eps)).alias("d"))
    z = F.zip_with(vec, repeat_for(st, vec), lambda v, p: (v - p["m"]) / p["d"])
    return df.withColumn(out, z)


def vector_moments(df: DataFrame, vec: str = "embedding", group: str = "label") -> DataFrame:
    """Per group and dimension: mean, population variance and log variance
    (floor 1e-6) of the standardised vectors."""
    x = with_standardised(df.select(group, vec), vec) \
        .select(group, F.posexplode_outer("_z").alias("dim", "z")).filter(F.col("dim").isNotNull())
    return (x.groupBy(group, "dim").agg(F.avg("z").alias("mean"), F.var_pop("z").alias("var"))
             .withColumn("logvar", F.log(F.greatest(F.col("var"), F.lit(1e-6)))))


def magnitude_histogram(df: DataFrame, edges, vec: str = "embedding", group: str = "label") -> DataFrame:
    """Mean |standardised value| per vector, then a soft histogram per group."""
    x = with_standardised(df.select(group, vec), vec)
    mag = F.aggregate("_z", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size("_z")
    return soft_histogram(x.select(group, mag.alias("mag")), "mag", edges, group=[group])


def gaussian_kl(moments: DataFrame, group: str = "label", logvar_min: float = -10.0,
                logvar_max: float = 10.0) -> DataFrame:
    """0.5 * sum over dims of (mu^2 + var - 1 - logvar) against N(0, 1), the
    log variance clamped to [min, max]."""
    lv = F.least(F.greatest(F.col("logvar"), F.lit(logvar_min)), F.lit(logvar_max))
    return moments.groupBy(group).agg(
        (0.5 * F.sum(F.col("mean") * F.col("mean") + F.exp(lv) - 1.0 - lv)).alias("kl"))


# --------------------------------------------------------------------------- M15
HELD_GROUPS = 256


def _gram_schema(dim: int):
    return T.StructType([T.StructField("grp", T.LongType()), T.StructField("i", T.IntegerType()),
                         T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])


def dependence_audit(pairs: DataFrame, task: str = "task", bias: str = "bias", group: str = "grp",
                     cos_weight: float = 1.0, cov_weight: float = 1.0, min_batch: int = 2,
                     eps: float = 1e-6) -> DataFrame:
    """Mean |cosine| of paired vectors + cov_weight * mean squared
    cross-correlation of standardised dimensions, per group; groups with
    fewer than ``min_batch`` pairs get the cosine term only.

    The dim x dim cross sums are built per task with numpy, summed over its
    Arrow batches and yielded once at its end; no row leaves its task, only
    dim^2 numbers per group and task are shuffled."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    t, b = F.col(task), F.col(bias)
    cos = F.abs(dot(t, b) / (F.greatest(F.sqrt(dot(t, t)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12))))
    base = pairs.groupBy(group).agg(F.avg(cos).alias("mean_abs_cos"), F.count(F.lit(1)).alias("n"))
    # first moments per dim
    mt = pairs.select(group, F.posexplode(t).alias("i", "x")).groupBy(group, "i").agg(
        F.avg("x").alias("mt"), F.stddev_pop("x").alias("st"))
    mb = pairs.select(group, F.posexplode(b).alias("j", "y")).groupBy(group, "j").agg(
        F.avg("y").alias("mb"), F.stddev_pop("y").alias("sb"))

    def rows(held):
        for g, S in held.items():
            ii, jj = np.indices(S.shape)
            yield pd.DataFrame({"grp": np.int64(g), "i": ii.ravel().astype("int32"),
                                "j": jj.ravel().astype("int32"), "s": S.ravel()})

    def gram(batches):
        held = {}
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                X = np.vstack(part["task"].to_numpy()).astype("float64")
                Y = np.vstack(part["bias"].to_numpy()).astype("float64")
                held[g] = held.get(g, 0.0) + X.T @ Y
                if len(held) > HELD_GROUPS:          # many groups: pass on what there is
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    sums = (pairs.select(F.col(group).cast("long").alias("grp"), t.cast("array<double>").alias("task"),
                         b.cast("array<double>").alias("bias"))
                 .mapInPandas(gram, _gram_schema(0))
                 .groupBy("grp", "i", "j").agg(F.sum("s").alias("s"))
                 .withColumnRenamed("grp", group))
    cov = (sums.join(base.select(group, "n"), group)
               .join(mt, [group, "i"]).join(mb, [group, "j"])
               .withColumn("cov", (F.col("s") / F.col("n") - F.col("mt") * F.col("mb")) /
                           (F.greatest(F.col("st"), F.lit(eps)) * F.greatest(F.col("sb"), F.lit(eps))))
               .groupBy(group).agg(F.avg(F.col("cov") * F.col("cov")).alias("cov_loss")))
    out = base.join(cov, group, "left")
    use_cov = (F.col("n") >= min_batch) & F.lit(cov_weight > 0)
    return out.withColumn("cov_loss", F.when(use_cov, F.col("cov_loss"))).withColumn(
        "loss", F.col("mean_abs_cos") * cos_weight + F.coalesce(F.col("cov_loss") * cov_weight, F.lit(0.0)))


# --------------------------------------------------------------------------- M16
def last_n(df: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """The n most recent rows per key. ``row_number() <= n`` gets a partial
    per-task group limit before the shuffle, so a hot key ships n rows per task."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
