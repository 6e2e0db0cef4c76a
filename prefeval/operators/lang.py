"""Languages and text mapping stages (L ops)."""

from __future__ import annotations

import hashlib
from typing import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefeval.functions.memory import free_memory
from prefeval.functions.text import c, no_space, squeeze
from prefeval.session import materialize


MAP_ROWS = 256            # rows handed to a model at a time


# --------------------------------------------------------------------------- L5
def map_text(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], inputs: list[str],
             keys: list[str] | None, out: str = "output", dedupe: bool = False) -> DataFrame:
    """Apply any batch text model (translate, generate, judge) in one
    ``mapInArrow`` stage and return ``keys + [out]``.

    ``fn`` gets a pandas DataFrame of ``inputs`` (``MAP_ROWS`` rows at most) and
    returns one string per row; a missing output becomes ``""``. Only these rows
    are Python objects at a time, whatever the size of an Arrow batch, and only
    the keys and the output go back. With ``dedupe`` the
    distinct inputs are mapped once and joined back on the inputs, so a text
    that occurs many times costs one model call. Filter rows before calling:
    Catalyst cannot push a filter through the Python stage.
    """
    def mapped(rows: DataFrame, carry: list) -> DataFrame:
        given = rows.columns
        at = [given.index(n) for n in inputs]
        kept = [given.index(n) for n in carry]
        schema = T.StructType([*[rows.schema.fields[i] for i in kept], T.StructField(out, T.StringType(), False)])

        def run(batches):
            for whole in batches:
                for k in range(0, whole.num_rows, MAP_ROWS):
                    batch = whole.slice(k, MAP_ROWS)
                    pdf = pa.Table.from_arrays([batch.column(i) for i in at], names=list(inputs)) \
                        .to_pandas(date_as_object=True)
                    res = pd.Series(fn(pdf), index=pdf.index).where(lambda s: s.notna(), "").astype(str)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(i) for i in kept], pa.array(res.tolist(), pa.string())],
                        names=[*[given[i] for i in kept], out])
                free_memory()

        return rows.mapInArrow(run, schema)

    if dedupe:
        # one digest of all inputs (null told apart from text): texts are
        # shuffled once to find the distinct ones, the join back moves digests
        parts = [F.coalesce(F.concat(F.lit("1"), F.sha2(F.col(i).cast("string"), 256)), F.lit("0")) for i in inputs]
        x = df.withColumn("_digest", F.sha2(F.concat_ws("|", *parts), 256))
        distinct = x.select("_digest", *inputs).dropDuplicates(["_digest"])
        return x.select("_digest", *keys).join(mapped(distinct, ["_digest"]), "_digest", "left").select(*keys, out)
    # keys=None: keep every input column and add the output (no join back).
    if keys is None:
        return mapped(df, df.columns)
    return mapped(df.select(*dict.fromkeys([*keys, *inputs])), list(dict.fromkeys(keys))).select(*keys, out)


def _h32(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16)


def make_stub_judge(salt: str = ""):
    """Deterministic stand-in for a judge model (tests and benches).

    Prefers the longer answer. By h = md5-prefix of salt+'seed|id' mod 10:
    0 -> no verdict, 1 -> lower-case verdict, 2 -> both patterns with the
    other one first, else a plain verdict. A per-row Python helper, run in
    Arrow batches by ``map_text``."""
    def judge(pdf: pd.DataFrame) -> pd.Series:
        out = []
        for seed, rid, a, b in zip(pdf["seed"], pdf["id"], pdf["answer_a"], pdf["answer_b"]):
            la = len(a) if isinstance(a, str) else 0
            lb = len(b) if isinstance(b, str) else 0
            better = "A" if la >= lb else "B"
            other = "B" if better == "A" else "A"
            k = _h32(f"{salt}{seed}|{rid}") % 10
            if k == 0:
                out.append("Both answers have merits; no decision.")
            elif k == 1:
                out.append("Assessment done. final verdict: [[" + better.lower() + "]]")
            elif k == 2:
                out.append("Weighing [[" + other + "]] against [[" + better + "]]: the second wins.")
            else:
                out.append("Assessment done. Final verdict: [[" + better + "]]")
        return pd.Series(out, index=pdf.index)
    return judge


stub_judge = make_stub_judge("")


# --------------------------------------------------------------------------- L3
def core_languages(df: DataFrame, language: str = "language") -> DataFrame:
    """Null language -> 'unknown'; keep languages without '_' (distinct, sorted)."""
    lang = F.coalesce(c(language), F.lit("unknown")).alias("language")
    return df.select(lang).distinct().filter(~F.col("language").contains("_")).orderBy("language")


# --------------------------------------------------------------------------- L2
def resolve_languages(requested: DataFrame | None, available: DataFrame,
                      short_to_code: dict, on_missing: str = "flag") -> DataFrame:
    """Match requested languages to available ones: directly, else through the
    short -> config-code map, else missing. No request -> all available.
    Output: requested, resolved (null when missing), display (the short name
    when the code came from the map), missing flag; ``on_missing='raise'``
    fails the job on a missing language, as a run of the evaluation would.
    The map is a small literal (a ``create_map`` expression), so no join is
    needed for it."""
    avail = available.select(F.col("language").alias("_avail")).distinct()
    if requested is None:
        req = avail.select(F.col("_avail").alias("requested"))
    else:
        req = requested.select(F.col("language").alias("requested")).distinct()
    if short_to_code:
        fwd = F.create_map(*[x for kv in short_to_code.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        inv = F.create_map(*[x for kv in short_to_code.items() for x in (F.lit(kv[1]), F.lit(kv[0]))])
    req = req.withColumn("_code", F.element_at(fwd, F.col("requested")) if short_to_code
                         else F.lit(None).cast("string"))
    direct = avail.select(F.col("_avail").alias("_direct"))
    via = avail.select(F.col("_avail").alias("_via"))
    x = (req.join(direct, req["requested"] == direct["_direct"], "left")
            .join(via, F.col("_code") == via["_via"], "left"))
    res = F.coalesce(F.col("_direct"), F.col("_via"))
    disp = F.coalesce(F.element_at(inv, res), res) if short_to_code else res
    out = x.select("requested", res.alias("resolved"), disp.alias("display"), res.isNull().alias("missing"))
    if on_missing == "raise":
        out = out.withColumn("resolved", F.when(~F.col("missing"), F.col("resolved")).otherwise(
            F.raise_error(F.concat(F.lit("Missing languages: "), F.col("requested")))))
    return out


# --------------------------------------------------------------------------- L4
def unpivot_responses(df: DataFrame, key: str = "row_id", a: str = "response_A",
                      b: str = "response_B") -> DataFrame:
    """A and B become two long rows at positions 2i and 2i+1."""
    return df.select(key, F.explode(F.array(
        F.struct(F.lit("A").alias("side"), F.lit(0).alias("pos"), c(a).alias("text")),
        F.struct(F.lit("B").alias("side"), F.lit(1).alias("pos"), c(b).alias("text")))).alias("_s")) \
        .select(key, "_s.side", (F.col(key) * 2 + F.col("_s.pos")).alias("flat_idx"), "_s.text")


def repivot_responses(long: DataFrame, key: str = "row_id", value: str = "text",
                      suffix: str = "_eng", check_rows: bool = True) -> DataFrame:
    """Mapped long rows back to columns ``response_A{suffix}``, ``response_B{suffix}``.

    The pivot values are given, so Spark does one aggregation without a
    discovery pass. With ``check_rows`` a key without exactly two rows fails."""
    g = long.groupBy(key).pivot("side", ["A", "B"]).agg(F.first(value), F.count(F.lit(1)))
    cols = g.columns
    a_val = [x for x in cols if x.startswith("A_first")][0]
    b_val = [x for x in cols if x.startswith("B_first")][0]
    a_n = [x for x in cols if x.startswith("A_count")][0]
    b_n = [x for x in cols if x.startswith("B_count")][0]
    out = g.select(key, F.col(a_val).alias(f"response_A{suffix}"), F.col(b_val).alias(f"response_B{suffix}"),
                   (F.coalesce(F.col(a_n), F.lit(0)) + F.coalesce(F.col(b_n), F.lit(0))).alias("_n"))
    if check_rows:
        out = out.withColumn("_n", F.when(F.col("_n") == 2, F.col("_n")).otherwise(
            F.raise_error(F.lit("translation count does not match input count"))))
    return out.drop("_n")


def back_translate(long: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], key: str = "row_id",
                   text: str = "text_eng", lang: str = "lang", out: str = "text_bt", on_missing: str = "raise") -> DataFrame:
    """Translate each mapped text back into its row's own language. A row
    without a language fails the job (``on_missing='null'``: null output)."""
    blank = F.coalesce(F.col(lang) == "", F.lit(True))
    if on_missing == "raise":
        checked = F.when(~blank, F.col(lang)).otherwise(F.raise_error(F.concat(
            F.lit("no language to translate back into for row "), F.col(key).cast("string"))))
        long = long.withColumn(lang, checked)
        blank = F.lit(False)
    mapped = map_text(long, fn, inputs=[text, lang], keys=[key, "side"], out=out)
    if on_missing == "raise":
        return mapped
    none = long.filter(blank).select(key, "side")
    return mapped.join(none.withColumn("_none", F.lit(True)), [key, "side"], "left") \
        .withColumn(out, F.when(F.col("_none").isNull(), F.col(out))).drop("_none")


# --------------------------------------------------------------------------- L1
HOT_GRAMS = 1 << 16       # grams of the language model that are broadcast
WIDE_LANGS = 32           # up to this many languages are summed in a column each


def char_trigrams(text) -> "F.Column":
    """Character trigrams of ' ' + lower(text) + ' ' with whitespace squeezed.

    All overlapping trigrams are three non-overlapping regex scans started at
    offsets 0, 1 and 2 - linear in the text, no per-character arrays. (The
    order of the grams does not matter for counting.) A text shorter than
    three characters is its own single gram."""
    t = F.concat(F.lit(" "), squeeze(F.lower(c(text))), F.lit(" "))
    tri = r"(?s)..."
    grams = F.concat(F.regexp_extract_all(t, F.lit(tri), 0),
                     F.regexp_extract_all(F.substring(t, 2, 1 << 30), F.lit(tri), 0),
                     F.regexp_extract_all(F.substring(t, 3, 1 << 30), F.lit(tri), 0))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(grams)


def train_language_model(docs: DataFrame, text: str = "text", label: str = "lang",
                         alpha: float = 1.0) -> DataFrame:
    """Char-trigram naive Bayes: log p(gram | lang) with add-alpha smoothing
    over the corpus vocabulary.

    Trigrams are exploded and counted with a partial aggregate, so the
    shuffle carries (lang, gram, count) rows, not characters. The count
    table is bounded by the trigram vocabulary, not by the corpus; it is
    written once to the shared checkpoint folder so totals, vocabulary size
    and log-probabilities read it instead of re-exploding the corpus."""
    # explode_outer: a plain explode makes Catalyst infer ``size(grams) > 0``
    # and push that filter (the whole trigram build) down into the scan task
    grams = docs.select(c(label).alias("lang"), F.explode_outer(char_trigrams(text)).alias("gram")) \
        .filter(F.col("gram").isNotNull())
    counts = materialize(grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "trigram-counts")
    vocab = counts.select("gram").distinct().agg(F.count(F.lit(1))).scalar()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    denom = F.col("total") + F.lit(alpha) * vocab
    return counts.join(F.broadcast(totals), "lang").select(     # one row per language
        "lang", "gram", F.log((F.col("n") + alpha) / denom).alias("logp"),
        F.log(F.lit(alpha) / denom).alias("logp_unseen"))


def detect_language(df: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text",
                    out: str = "detected") -> DataFrame:
    """Naive-Bayes language of each row; blank text -> ''.

    score(lang) = sum over the row's trigrams of log p(gram | lang), unseen
    grams at the language's floor. Candidates are the languages sharing at
    least one trigram with the row; ties go to the larger language code.

    The model is one row per gram with a map from language to log probability.
    Its ``HOT_GRAMS`` likeliest grams are broadcast, so nearly all grams of a
    text are scored and summed per language where the text is read and are
    never shuffled. What is left, one row per text and rarer gram, is written
    once and joined to the whole model by shuffle. Floors come with the model,
    nothing is read to the driver."""
    langs = model.groupBy("lang").agg(F.first("logp_unseen").alias("floor"))
    floors = langs.agg(F.map_from_entries(F.collect_list(F.struct("lang", "floor")))).scalar()
    wide = model.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "logp"))).alias("p"),
                                     F.max("logp").alias("_top"))
    names = [r.lang for r in langs.select("lang").collect()]         # a handful
    likely = wide.orderBy(F.desc("_top"), "gram").limit(HOT_GRAMS)
    # the gram total is taken before the explode: an expression over the
    # array next to the generator would carry the whole array on every row
    g = df.select(key, char_trigrams(text).alias("_g")).select(key, F.size("_g").alias("_K"), "_g")
    exploded = g.select(key, "_K", F.explode_outer("_g").alias("gram")).filter(F.col("gram").isNotNull())

    def scores(few):
        """Sum and number per language of ``few``, one column each: a gram is
        one row, whatever the number of languages."""
        cells = likely.select("gram", F.lit(True).alias("_hit"), *[F.element_at("p", n).alias(f"_l{i}") for i, n in enumerate(few)])
        found = exploded.join(F.broadcast(cells), "gram", "left")      # HOT_GRAMS rows at most
        rest = F.when(F.col("_hit").isNull(), F.col("gram")).alias("_rest")
        return found.groupBy(key, "_K", rest).agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"_l{i}").alias(f"s{i}") for i in range(len(few))],
            *[F.count(f"_l{i}").alias(f"n{i}") for i in range(len(few))]) \
            .select(key, "_K", "_rest", "n", F.array(*[F.struct(F.lit(n).alias("lang"), F.col(f"s{i}").alias("s"),
                                                                F.col(f"n{i}").alias("n")) for i, n in enumerate(few)]).alias("_by"))

    if 0 < len(names) <= WIDE_LANGS:
        met = materialize(scores(names), "gram-scores")
        near = met.filter(F.col("_rest").isNull()).select(key, "_K", F.explode("_by").alias("_b")) \
            .select(key, "_K", "_b.*").filter(F.col("n") > 0)
    else:
        found = exploded.join(F.broadcast(likely.select("gram", "p")), "gram", "left")
        met = found.select(key, "_K", F.when(F.col("p").isNull(), F.col("gram")).alias("_rest"),
                           F.explode_outer("p").alias("lang", "lp"))
        met = materialize(met.groupBy(key, "_K", "lang", "_rest").agg(
            F.sum("lp").alias("s"), F.count(F.lit(1)).alias("n")), "gram-scores")
        near = met.filter(F.col("_rest").isNull()).select(key, "_K", "lang", "s", "n")
    rest = met.filter(F.col("_rest").isNotNull()).select(key, "_K", F.col("_rest").alias("gram"), F.col("n").alias("k"))
    rest = rest.join(wide.select("gram", "p"), "gram").select(key, "_K", "k", F.explode("p").alias("lang", "lp")) \
        .select(key, "_K", "lang", (F.col("k") * F.col("lp")).alias("s"), F.col("k").alias("n"))
    scored = near.unionByName(rest).groupBy(key, "_K", "lang").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    score = F.col("s") + (F.col("_K") - F.col("n")) * F.element_at(floors, F.col("lang"))
    best = scored.groupBy(key).agg(F.max_by("lang", F.struct(score.alias("score"), F.col("lang").alias("lang"))).alias(out))
    return df.join(best, key, "left").withColumn(
        out, F.when(no_space(text) == "", F.lit("")).otherwise(F.col(out)))
