"""Training-ready token tables (T ops).

Default tokeniser: whitespace words; a word's id is a stable hash into a
fixed vocabulary (map-only, no vocabulary join), ids 0..2 are reserved
(pad, eos, unknown). Token character offsets come from the whitespace runs
of the text, so spans and labels are array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefeval.functions.keys import dense_index, h32
from prefeval.functions.text import WS_CHARS, c, py_strip, words

PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
VOCAB = 50000


def token_id(word: Column) -> Column:
    return (h32(word) % VOCAB + 3).cast("int")


def ids_of(text, max_len: int | None = None) -> Column:
    toks = words(F.coalesce(c(text), F.lit("")))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    return F.transform(toks, token_id)


# --------------------------------------------------------------------------- T1
def encode(df: DataFrame, text: str, max_len: int | None, out: str = "ids") -> DataFrame:
    """text -> ids, right-truncated to max_len if there is one; mask 1 when the text is present."""
    present = F.coalesce(py_strip(c(text)), F.lit("")) != ""
    return df.withColumn(out, ids_of(text, max_len)).withColumn(out + "_mask", present.cast("int"))


# --------------------------------------------------------------------------- T2
def encode_pair(df: DataFrame, prompt: str, output: str, max_len: int, append_eos: bool = True,
                prompt_ids: str | None = None, output_ids: str | None = None,
                eos: int = EOS_ID, pad: int = PAD_ID) -> DataFrame:
    """prompt + output ids (those of the default tokeniser unless id columns are named); EOS appended when absent; overflow cut from the
    left (prompt first, then output); labels -100 on prompt tokens; both
    empty -> one pad token; ``prompt_overflow`` when the prompt alone >= max."""
    p = ids_of(prompt) if prompt_ids is None else c(prompt_ids)
    o = ids_of(output) if output_ids is None else c(output_ids)
    if append_eos:
        o = F.when((F.size(o) == 0) | (F.element_at(o, -1) != eos), F.concat(o, F.array(F.lit(eos)))).otherwise(o)
    x = df.withColumn("_p", p).withColumn("_o", o)
    lp, lo = F.size("_p"), F.size("_o")
    over = lp + lo - F.lit(max_len)
    x = x.withColumn("prompt_overflow", lp >= max_len)
    p2 = F.when(over <= 0, F.col("_p")).when(over >= lp, F.slice("_p", 1, 0)).otherwise(F.slice("_p", over + 1, lp))
    drop = over - lp
    o2 = F.when((over > 0) & (drop > 0), F.slice("_o", drop + 1, lo)).otherwise(F.col("_o"))
    x = x.withColumn("_p", p2).withColumn("_o", o2)
    ids = F.concat("_p", "_o")
    labels = F.concat(F.transform("_p", lambda _: F.lit(-100)), F.col("_o"))
    empty = F.size(ids) == 0
    return (x.withColumn("input_ids", F.when(empty, F.array(F.lit(pad))).otherwise(ids))
             .withColumn("labels", F.when(empty, F.array(F.lit(-100))).otherwise(labels))
             .withColumn("target_len", F.size("_o"))
             .drop("_p", "_o"))


# --------------------------------------------------------------------------- offsets
def tokens_starting_before(text, pos) -> Column:
    """Number of whitespace tokens that start before character ``pos``
    (0-based): the tokens of the first ``pos`` characters."""
    return F.size(words(F.substring(c(text), F.lit(1), pos)))


def tokens_ending_by(text, pos) -> Column:
    """Number of whitespace tokens that end at or before character ``pos``:
    the tokens of the prefix, minus one when a token runs across ``pos``.
    A few substring scans per row; no per-token offsets are built."""
    t = c(text)
    before = F.substring(t, pos, F.lit(1))          # character pos-1 (0-based)
    at = F.substring(t, pos + 1, F.lit(1))          # character pos
    crossing = (pos > 0) & (F.length(before) > 0) & (F.length(at) > 0) & ~before.isin(*WS_CHARS) & ~at.isin(*WS_CHARS)
    return tokens_starting_before(t, pos) - F.when(crossing, F.lit(1)).otherwise(F.lit(0))


# --------------------------------------------------------------------------- T3
def label_tokens(df: DataFrame, prompt: str, target: str, max_len: int) -> DataFrame:
    """prompt + target encoded together and right-truncated; the label starts at
    the first token whose end passes the prompt's character length; earlier
    labels are -100; EOS is added when there is room.

    The first such token is the number of tokens that end at or before the
    prompt's length, so no token offsets are materialised."""
    full = F.concat(F.coalesce(c(prompt), F.lit("")), F.coalesce(c(target), F.lit("")))
    x = df.withColumn("_full", full)
    x = x.withColumn("_ids", ids_of("_full", max_len))
    plen = F.length(F.coalesce(c(prompt), F.lit("")))
    n = F.size("_ids")
    x = x.withColumn("target_start", F.least(tokens_ending_by("_full", plen), n).cast("int"))
    ts = F.col("target_start")
    labels = F.concat(F.array_repeat(F.lit(-100), ts), F.slice("_ids", ts + 1, F.greatest(n - ts, F.lit(0))))
    room = n < max_len
    return (x.withColumn("input_ids", F.when(room, F.concat("_ids", F.array(F.lit(EOS_ID)))).otherwise(F.col("_ids")))
             .withColumn("labels", F.when(room, F.concat(labels, F.array(F.lit(EOS_ID)))).otherwise(labels))
             .withColumn("truncated", F.size(words("_full")) > max_len)
             .drop("_full", "_ids"))


# --------------------------------------------------------------------------- T4
def tag_response_tokens(df: DataFrame, prompt: str, span_a: str, span_b: str, max_len: int | None = None,
                        out: str = "response_types") -> DataFrame:
    """Type 1 / 2 for tokens whose [start, end) overlaps span A / span B
    (A first), else 0. Spans are structs(start, end) from ``locate_span``.

    Tokens overlapping [s, e) are the index range [tokens ending by s,
    tokens starting before e): two counts per span, then one array of
    types built from literal comparisons. ``max_len`` truncates on the right."""
    t = F.coalesce(c(prompt), F.lit(""))
    n = F.size(words(t))
    x = df.withColumn("_n", n if max_len is None else F.least(n, F.lit(max_len)))
    for side, span in (("a", span_a), ("b", span_b)):
        sp = F.col(span)
        x = (x.withColumn(f"_{side}0", F.when(sp.isNotNull(), tokens_ending_by(t, sp["start"])))
              .withColumn(f"_{side}1", F.when(sp.isNotNull(), tokens_starting_before(t, sp["end"]))))
    bounds = F.struct("_a0", "_a1", "_b0", "_b1")
    idx = F.sequence(F.lit(0), F.col("_n") - 1)
    types = F.zip_with(idx, F.array_repeat(bounds, F.col("_n")), lambda k, b: (
        F.when((k >= b["_a0"]) & (k < b["_a1"]), F.lit(1))
         .when((k >= b["_b0"]) & (k < b["_b1"]), F.lit(2)).otherwise(F.lit(0))))
    return x.withColumn(out, F.when(F.col("_n") > 0, types).otherwise(F.array().cast("array<int>"))) \
            .drop("_n", "_a0", "_a1", "_b0", "_b1")


def find_subseq(hay, needle) -> Column:
    """0-based [start, end) of the first occurrence of ``needle`` in ``hay``
    (id arrays), null when absent or empty. Both are joined to texts with a
    mark around every id, so the search is one substring scan and not a
    comparison at each position."""
    def marked(ids):
        return F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    n = F.size(c(needle))
    at = F.instr(marked(c(hay)), marked(c(needle)))
    before = F.substring(marked(c(hay)), F.lit(1), at - 1)
    start = F.size(F.regexp_extract_all(before, F.lit(",-?[0-9]+,"), 0))
    return F.when((n > 0) & (at > 0), F.struct(start.alias("start"), (start + n).alias("end")))


def tag_by_ids(df: DataFrame, prompt: str, answer_a: str, answer_b: str, max_len: int | None = None,
               out: str = "response_types") -> DataFrame:
    """T4 without offsets: type 1 / 2 where the ids of answer A / B stand as a
    sub-sequence of the prompt's ids, else the ids without their first one
    (a first token can differ in context). B overwrites A where they overlap."""
    x = df.withColumn("_p", ids_of(prompt, max_len))
    for side, text in (("a", answer_a), ("b", answer_b)):
        x = x.withColumn(f"_{side}", ids_of(text, max_len))
        ids = F.col(f"_{side}")
        tail = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(1)))
        x = x.withColumn(f"_{side}", F.coalesce(
            find_subseq("_p", ids), F.when(F.size(ids) > 1, find_subseq("_p", tail))))
    n = F.size("_p")
    types = F.zip_with(F.sequence(F.lit(0), n - 1), F.array_repeat(F.struct("_a", "_b"), n), lambda k, s: (
        F.when((k >= s["_b"]["start"]) & (k < s["_b"]["end"]), F.lit(2))
         .when((k >= s["_a"]["start"]) & (k < s["_a"]["end"]), F.lit(1)).otherwise(F.lit(0))))
    return x.withColumn(out, F.when(n > 0, types).otherwise(F.array().cast("array<int>"))).drop("_p", "_a", "_b")


# --------------------------------------------------------------------------- T5
def apply_length_policy(df: DataFrame, mode: str, min_target: int, max_len: int,
                        batch: str = "batch_id", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Flag rows that were truncated or whose prompt alone reaches max_len
    (``truncated``, ``prompt_overflow``), or that have fewer than
    ``min_target`` target tokens. ``mask``: their labels become all -100 and
    their ``response_types`` (where there are any) all 0. ``drop``: they are
    removed; a batch that loses every row keeps its first row (by ``key``)
    with everything masked. Returns (rows with their key, counts per reason)."""
    over = F.col("prompt_overflow")
    if "truncated" in df.columns:
        over = over | F.coalesce(F.col("truncated"), F.lit(False))
    few = F.lit(min_target > 0) & (F.col("target_len") < min_target)
    x = df.withColumn("_over", over).withColumn("_few", few).withColumn("_flag", over | few)
    counts = x.agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("_over"), 1)).alias("drop_maxlen"),
                   F.count(F.when(F.col("_few"), 1)).alias("drop_min_target"),
                   F.count(F.when(F.col("_flag"), 1)).alias("flagged")) \
        .withColumn("ratio", F.coalesce(F.try_divide(F.col("flagged").cast("double"), F.col("seen").cast("double")),
                                        F.lit(0.0)))

    def masked(rows, where):
        out = rows.withColumn("labels", F.when(where, F.transform("labels", lambda _: F.lit(-100)))
                              .otherwise(F.col("labels")))
        if "response_types" in rows.columns:
            out = out.withColumn("response_types", F.when(where, F.transform("response_types", lambda _: F.lit(0)))
                                 .otherwise(F.col("response_types")))
        return out.drop("_over", "_few", "_flag")

    if mode == "mask":
        return masked(x, F.col("_flag")), counts
    # batches that lose all rows: a small aggregate, joined back on the batch
    lost = x.groupBy(batch).agg(F.bool_and("_flag").alias("_all"), F.min(key).alias("_first")).filter("_all")
    kept = x.join(lost.select(batch, "_first"), batch, "left") \
        .filter(~F.col("_flag") | (F.col(key) == F.col("_first"))).drop("_first")
    return masked(kept, F.col("_flag")), counts


# --------------------------------------------------------------------------- T6
def pack_batches(df: DataFrame, size: int, ids: str = "input_ids", order: str = "row_id",
                 side: str = "right", max_length: int | None = None) -> DataFrame:
    """batch = row position (by ``order``) div size; sequences padded with PAD to the batch
    maximum (capped at max_length), on the left or right; attention mask.
    Batches are small fixed-size groups, so the window stays bounded."""
    place = dense_index(df.select(order), [], [order], name="_at")     # keys only
    x = df.join(place, order).withColumn("batch_id", F.floor(F.col("_at") / size).cast("long")).drop("_at")
    w = Window.partitionBy("batch_id")
    seq = F.slice(F.col(ids), 1, max_length) if max_length else F.col(ids)
    x = x.withColumn("_seq", seq).withColumn("_len", F.max(F.size("_seq")).over(w))
    pad = F.array_repeat(F.lit(PAD_ID), (F.col("_len") - F.size("_seq")).cast("int"))
    ones = F.array_repeat(F.lit(1), F.size("_seq"))
    zeros = F.array_repeat(F.lit(0), (F.col("_len") - F.size("_seq")).cast("int"))
    if side == "left":
        packed, mask = F.concat(pad, "_seq"), F.concat(zeros, ones)
    else:
        packed, mask = F.concat("_seq", pad), F.concat(ones, zeros)
    return x.withColumn("padded", packed).withColumn("attention_mask", mask).drop("_seq", "_len")


# --------------------------------------------------------------------------- T7 / T8
def shard_contiguous(idx, total, n: int) -> Column:
    """Shard of row idx when total rows are cut into n contiguous shards, the
    remainder going to the first shards."""
    i = c(idx)
    base = F.floor(total / n)
    rem = total % n
    cut = (base + 1) * rem
    return F.when(i < cut, F.floor(i / (base + 1))).otherwise(rem + F.floor((i - cut) / F.greatest(base, F.lit(1)))).cast("int")


def shard_strided(idx, n: int) -> Column:
    return (c(idx) % n).cast("int")


def merge_shards(shards: DataFrame, expected, idx: str = "idx", rank: str = "rank",
                 world: str = "world_size") -> tuple[DataFrame, DataFrame]:
    """Union of shard rows checked for completeness. Returns (rows, one-row
    report: distinct world sizes, missing ranks, indices out of range,
    missing indices, duplicate indices). ``expected`` is the row count the
    shards must cover, a number or a one-value column expression.

    One aggregate over (index, rank, world) counts: an index that is in range
    is either there or missing, so the missing ones are a difference."""
    per = shards.groupBy(idx).agg(F.count(F.lit(1)).alias("_n"), F.collect_set(rank).alias("_ranks"),
                                  F.collect_set(world).alias("_worlds"))
    total = F.lit(expected) if isinstance(expected, int) else expected
    inside = (F.col(idx) >= 0) & (F.col(idx) < F.col("_total"))
    flat = F.array_distinct(F.flatten(F.collect_set("_ranks")))
    worlds = F.array_distinct(F.flatten(F.collect_set("_worlds")))
    g = per.withColumn("_total", total).agg(
        worlds.alias("_w"), flat.alias("_r"), F.max("_total").alias("_total"),
        F.sum(F.when(~inside, F.col("_n")).otherwise(F.lit(0))).alias("out_of_range"),
        F.count(F.when(inside, 1)).alias("_present"), F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_indices"))
    wanted = F.sequence(F.lit(0), F.array_max("_w").cast("int") - 1)
    return shards, g.select(
        F.size("_w").cast("long").alias("world_sizes"),
        F.size(F.array_except(wanted, F.col("_r"))).cast("long").alias("missing_ranks"),
        "out_of_range", (F.col("_total") - F.col("_present")).alias("missing_indices"), "duplicate_indices")


# --------------------------------------------------------------------------- T9
def rank_align(types: DataFrame, values: DataFrame, key: str = "row_id") -> DataFrame:
    """The k-th position of a side (type 1 = A, 2 = B) receives the k-th valid
    value of that side; extra positions get 0. ``types``: (key, pos, side),
    ``values``: (key, side, vpos, value).

    Both tables are dealt out once by (key, side); ranks and the match by rank
    stay within those partitions. A null key takes no values."""
    real = F.col("value").isNotNull() & ~F.isnan("value")
    kind = values.schema["value"].dataType
    t = types.filter(F.col("side") > 0).select(key, "side", F.lit(True).alias("_t"), F.col("pos").alias("_at"),
                                               F.lit(None).cast(kind).alias("value"))
    v = values.filter(real & F.col(key).isNotNull() & F.col("side").isNotNull()) \
        .select(key, "side", F.lit(False).alias("_t"), F.col("vpos").alias("_at"), "value")
    w = Window.partitionBy(key, "side", "_t").orderBy("_at")
    x = t.unionByName(v).repartition(key, "side").withColumn("_k", F.row_number().over(w))
    x = x.groupBy(key, "side", "_k").agg(F.bool_or("_t").alias("_t"), F.max(F.when(F.col("_t"), F.col("_at"))).alias("pos"),
                                         F.max("value").alias("value"))
    return x.filter("_t").select(key, "pos", "side", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
