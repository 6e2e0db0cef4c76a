"""Derived test tables (FIXTURES.md part 2), built from the given parquet
tables with DataFrame plans. The DuckDB oracle builds the same tables with
its own SQL (``prefeval.plans.oracle``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefeval.functions.keys import dense_index, h32
from prefeval.operators import lang as L
from prefeval.operators import tasks as J
from prefeval.operators.evaluate import with_seeds
from prefeval.session import materialize
from prefeval.sources.tables import table

SEEDS = [42, 43, 44]


def user_turns(spark: SparkSession, root: str, with_text: bool = True) -> DataFrame:
    """User turns of ``conversations`` with a dense global rank u. Ranks are
    computed on keys only; the text joins back once."""
    conv = table(spark, root, "conversations").filter(F.col("role") == "user")
    ranked = dense_index(conv.select("conv_id", "turn"), [], ["conv_id", "turn"], name="u")
    if not with_text:
        return ranked
    return ranked.join(conv.select("conv_id", "turn", F.col("text").alias("prompt")), ["conv_id", "turn"])


_PAIR_KEYS: dict = {}


def pair_keys(spark: SparkSession, root: str) -> DataFrame:
    """Keys of F-PAIR (document, rejected document, prompt turn), written once
    per session and folder: every query on pairs reads the same small table
    instead of planning the ranking again."""
    at = (spark.sparkContext.applicationId, root)
    if at not in _PAIR_KEYS:
        _PAIR_KEYS[at] = materialize(_pair_keys(spark, root), "pair-keys")
    return _PAIR_KEYS[at]


def _pair_keys(spark: SparkSession, root: str) -> DataFrame:
    """Ranks come from ``dense_index`` on key columns only: a language that
    holds most documents is still numbered by many tasks."""
    docs = table(spark, root, "documents")
    lab = table(spark, root, "labels").select("doc_id", "quality")
    keys = docs.select("doc_id", "lang", "source").join(lab, "doc_id")
    good = dense_index(keys.filter(F.col("quality") == 1).drop("quality"), ["lang"], ["doc_id"], "i")
    bad = dense_index(keys.filter(F.col("quality") == 0).select("doc_id", "lang"), ["lang"], ["doc_id"], "j")
    n0 = bad.groupBy("lang").agg(F.count(F.lit(1)).alias("n0"))
    users = user_turns(spark, root, with_text=False)
    n_users = users.agg(F.count(F.lit(1))).scalar()
    g = (good.join(F.broadcast(n0), "lang")            # one row per language
             .withColumn("j", F.col("i") % F.col("n0"))
             .withColumn("u", F.col("i") % n_users))
    rej = bad.select("lang", "j", F.col("doc_id").alias("rejected_id"))
    return g.join(rej, ["lang", "j"]).join(users.select("u", "conv_id", "turn"), "u") \
        .select("doc_id", "lang", "source", "rejected_id", "conv_id", "turn")


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """F-PAIR: per language, the i-th quality-1 document (by doc_id) against
    the (i mod n0)-th quality-0 document; prompt = user turn (i mod #users).
    The three texts are joined to the stored keys."""
    ids = pair_keys(spark, root)
    texts = table(spark, root, "documents").select("doc_id", "text")
    prompts = table(spark, root, "conversations").filter(F.col("role") == "user") \
        .select("conv_id", "turn", F.col("text").alias("prompt"))
    out = (ids.join(texts, "doc_id")
              .join(texts.select(F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected")),
                    "rejected_id")
              .join(prompts, ["conv_id", "turn"]))
    return out.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("language"),
        F.col("source").alias("subset"),
        F.concat(F.lit("bench"), (F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2).cast("string"))
         .alias("benchmark"),
        "prompt",
        F.col("text").alias("chosen"),
        "rejected")


def judge_tasks(spark: SparkSession, root: str, seeds=None) -> DataFrame:
    """F-PAIR x seeds -> J1 order -> J2 prompt."""
    p = with_seeds(pairs(spark, root), seeds or SEEDS)
    t = J.randomise_order(p, F.col("seed"), key="id")
    return J.render_default(t, question="prompt", language="language")


def judge_completions(tasks: DataFrame) -> DataFrame:
    """F-JUDGE: stub judge through the generic model stage (L5)."""
    return L.map_text(tasks, L.stub_judge, inputs=["seed", "id", "answer_a", "answer_b"],
                      keys=["id", "seed"], out="completion")


RECORD_KEYS = ["id", "seed", "benchmark", "language", "swapped", "expected_verdict"]


def judge_completions_inline(tasks: DataFrame, judge=L.stub_judge, keep: list | None = None) -> DataFrame:
    """F-JUDGE appended to the task rows (no join back). Only the model's four
    inputs and the ``keep`` columns go to Python; Catalyst prunes the rest."""
    return L.map_text(tasks, judge, inputs=["seed", "id", "answer_a", "answer_b"],
                      keys=RECORD_KEYS if keep is None else keep, out="completion")


def requests(spark: SparkSession, root: str) -> DataFrame:
    """F-REQ: judgment requests. custom_id = group-lang-idx-gold(A|B); group
    ``high_resource`` for en else ``low_resource``; even ids emit both golds
    (a swapped pair), odd ids one gold chosen by hash."""
    p = pairs(spark, root)
    grp = F.when(F.col("language") == "en", F.lit("high_resource")).otherwise(F.lit("low_resource"))
    one = F.when(h32(F.col("id")) % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("B")))
    golds = F.when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(one)
    x = p.withColumn("group", grp).withColumn("gold", F.explode(golds))
    x = (x.withColumn("answer_a", F.when(F.col("gold") == "A", F.col("chosen")).otherwise(F.col("rejected")))
          .withColumn("answer_b", F.when(F.col("gold") == "A", F.col("rejected")).otherwise(F.col("chosen"))))
    x = J.render_user(x, question="prompt", out="content")
    return x.select(
        F.concat_ws("-", "group", "language", F.col("id").cast("string"),
                    F.concat(F.lit("gold"), F.col("gold"))).alias("custom_id"),
        "content",
        F.concat(F.lit("set"), F.substring("benchmark", 6, 1)).alias("dataset"),
        F.concat(F.col("group"), F.lit("_"), F.col("language"), F.lit("_judgment_requests.jsonl")).alias("file_name"),
        (F.col("id") * 2 + F.when(F.col("gold") == "B", 1).otherwise(0)).alias("row_id"))


def sections(spark: SparkSession, root: str) -> DataFrame:
    """F-SECT: F-PAIR texts under the ``###`` headers. h(id)%3=0 carries a
    reference block, h(id)%7=0 misses the Response B header; orig_criteria
    and output take missing-value forms by hash."""
    p = pairs(spark, root)
    hh = h32(F.col("id"))
    ref = F.when(hh % 3 == 0, F.concat(F.lit("\n\n###Reference Answer:\nA model answer for item "),
                                       F.col("id").cast("string"))).otherwise(F.lit(""))
    header_b = F.when(hh % 7 == 0, F.lit("###Response B:")).otherwise(F.lit("###Response B to evaluate:"))
    instruction = F.concat(
        F.lit("###Task Description:\nRead the instruction and both responses, given a reference answer, "
              "a rubric and the task.\n\n###The instruction to evaluate:\n"), F.col("prompt"),
        F.lit("\n\n###Response A to evaluate:\n"), F.col("chosen"), F.lit("\n\n"), header_b, F.lit("\n"),
        F.col("rejected"), ref,
        F.lit("\n\n###Evaluation Criteria:\nIs the response helpful and correct?\n\n###Feedback: "))
    crit = (F.when(hh % 5 == 0, F.lit(None).cast("string")).when(hh % 5 == 1, F.lit(" none "))
             .when(hh % 5 == 2, F.lit("")).when(hh % 5 == 3, F.lit("Helpfulness")).otherwise(F.lit("NULL")))
    output = F.when(hh % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Feedback "), F.col("id").cast("string")))
    return p.select("id", instruction.alias("instruction"), F.col("prompt").alias("orig_instruction"),
                    F.concat(F.lit(" "), F.col("chosen"), F.lit("\n")).alias("orig_response_A"),
                    F.col("rejected").alias("orig_response_B"), crit.alias("orig_criteria"),
                    output.alias("output"))


def responses(spark: SparkSession, root: str) -> DataFrame:
    """F-RESP: assistant turn t as A, assistant turn t+2 as B (null when
    absent), the user turn t-1 as instruction; row_id = conv_id*1000 + turn."""
    conv = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    a = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response_A"))
    b = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("response_B"))
    u = conv.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("instruction"))
    r = a.join(b, ["conv_id", "turn"], "left").join(u, ["conv_id", "turn"], "left")
    return r.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "conv_id", "turn",
                    "instruction", "response_A", "response_B", F.lit("").alias("output"))


def proxy(spark: SparkSession, root: str) -> DataFrame:
    """F-PROXY: events as proxy rows: nll = value (null when h%11=0),
    ppl = props.k."""
    ev = table(spark, root, "events")
    nll = F.when(h32(F.col("event_id")) % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return ev.select(F.col("event_id").alias("row_id"), nll.alias("nll"),
                     F.get_json_object("props", "$.k").alias("ppl"), "value", "event_type", "ts", "user_id")


def metric_log(spark: SparkSession, root: str) -> DataFrame:
    """F-LOG: events as a training log; run = user_id % 8, metric =
    event_type, step = rank of (ts, event_id) inside (run, metric)."""
    ev = table(spark, root, "events")
    x = ev.select((F.col("user_id") % 8).alias("run"), F.col("event_type").alias("metric"), "value",
                  F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return dense_index(x, ["run", "metric"], ["ts", "event_id"], name="step")


STATUS = {"signup": "submitted", "view": "processing", "click": "succeeded", "purchase": "expired",
          "error": "failed"}


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """F-LEDGER: events as request observations; id = user_id, attempt = rank
    of (ts, event_id) per id, status by event type, output for successes."""
    ev = table(spark, root, "events")
    m = F.create_map(*[x for kv in STATUS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    x = ev.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                  F.element_at(m, F.col("event_type")).alias("status"),
                  F.when(F.col("event_type") == "click", F.concat(F.lit("out-"), F.col("event_id").cast("string")))
                   .alias("output"))
    # many ids, each possibly hot: offsets are joined by shuffle, not broadcast
    return dense_index(x, ["id"], ["ts", "event_id"], name="attempt")
