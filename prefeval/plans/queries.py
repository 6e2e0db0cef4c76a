"""

Every query reads the given tables (or tables Spark derives from them) at
``root`` and returns a DataFrame; the SQL twin of each lives in
``prefeval.plans.oracle`` under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefeval.functions.keys import h32
from prefeval.functions.text import WS, words
from prefeval.operators import clean as P
from prefeval.operators import evaluate as E
from prefeval.operators import lang as L
from prefeval.operators import tasks as J
from prefeval.plans import fixtures as FX
from prefeval.sources.tables import table

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def judge_records(spark: SparkSession, root: str, keep: list | None = None) -> DataFrame:
    """F-PAIR x 3 seeds -> J1 -> J2 -> stub judge (L5) -> E1/E2 records.

    The judge stage appends its output to the ``keep`` columns (labels only,
    unless a query writes the texts), so records need no join back."""
    tasks = FX.judge_tasks(spark, root)
    judged = FX.judge_completions_inline(tasks, keep=keep)
    return E.build_records(judged, None)


@register("e5_accuracy")
def q_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """E5 (flagship): accuracy per seed by grouping sets."""
    return E.accuracy(judge_records(spark, root), by=["seed"])




# ---------------------------------------------------------------------------- J ops
TEMPLATE = ("Question ({src_lang} to {tgt_lang}): {question}\n{{kept braces}} A: {response_a}\n"
            "B: {answer_b}\nUnknown stays: {rubric}\nPrompt again: {prompt}")
RUBRICS = [
    "Prefer the answer that is correct.",
    {"Tie": "both are equal", "Assistant B": "B is better", "Assistant A": "A is better", "Other": "none fits"},
    ["Check facts.", "Check tone."],
    "Prefer the answer that is complete.",
    "Prefer the shorter answer when both are correct.",
]
TEMPLATE_KEYS = ["instruction_msg", "tags", "schema", "general", "math", "code", "safety", "src1", "src12", "en"]
TASK_TEXT = {"src1": "Judge answers about source one.", "math": "Check the math."}
DEFAULT_TASK = "Judge the two answers."


def seed42_tasks(spark, root):
    return J.randomise_order(FX.pairs(spark, root), 42, key="id")


@register("j1_randomise_order")
def q_j1(spark, root):
    return FX.judge_tasks(spark, root).select("id", "seed", "swapped", "expected_verdict")


@register("j2_render_default")
def q_j2(spark, root):
    return FX.judge_tasks(spark, root).select("id", "seed", "judge_prompt")


@register("j3_render_template")
def q_j3(spark, root):
    t = J.render_template(seed42_tasks(spark, root), TEMPLATE, out="text")
    return t.select("id", "text")


@register("j4_pick_rubric")
def q_j4(spark, root):
    return J.pick_rubric(FX.pairs(spark, root), RUBRICS, seed=42, key="id").select("id", "rubric_index", "rubric")


@register("j4_pick_rubric_unseeded")
def q_j4u(spark, root):
    return J.pick_rubric(FX.pairs(spark, root), RUBRICS, key="id").select("id", "rubric_index", "rubric")


def _doc_categories(spark, root):
    d = table(spark, root, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id") % 4
    cat = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.concat(F.lit("Chat "), F.col("lang")))
            .when(k == 2, F.col("lang")).otherwise(F.lit("")))
    return d.withColumn("category", cat).withColumnRenamed("source", "subset")


@register("j5_select_template_type")
def q_j5(spark, root):
    return J.select_template_type(_doc_categories(spark, root), TEMPLATE_KEYS).select("doc_id", "template_type")


RUBRIC_TEMPLATE = {
    "instruction_msg": "Instruction",
    "tags": {"evaluation_rubric_tag": "Rubric", "input_tag": "Input"},
    "schema": "{\"score\": \"Assistant A or Assistant B\"}",
    "general": {"task_description": DEFAULT_TASK, "rubric_list": RUBRICS},
    "src1": {"task_description": TASK_TEXT["src1"], "rubric_list": RUBRICS[:2], "schema": "{\"score\": \"A|B\"}"},
    "math": {"task_description": TASK_TEXT["math"], "rubric_list": RUBRICS[2:]},
    "src12": {"task_description": "Judge answers about source twelve.", "rubric_list": []},
}


@register("j6_render_rubric_prompt")
def q_j6(spark, root):
    t = seed42_tasks(spark, root).withColumn("category", F.lit(None).cast("string"))
    r = J.render_rubric_prompt(t, RUBRIC_TEMPLATE, seed=42, key="id")
    return r.select("id", "template_type", "judge_prompt")


@register("j7_fit_token_budget")
def q_j7(spark, root):
    p = FX.pairs(spark, root).select("id", words("prompt").alias("q_tokens"), words("chosen").alias("a_tokens"),
                                     words("rejected").alias("b_tokens"))
    f = J.fit_token_budget(p, limit=600, overhead=40)
    return f.select("id", F.size("q_fit").alias("q_n"), F.size("a_fit").alias("a_n"), F.size("b_fit").alias("b_n"),
                    "prompt_tokens", "truncated", "cut_whole",
                    F.array_join("a_fit", " ").alias("a_text"), F.array_join("b_fit", " ").alias("b_text"))


def parsed_requests(spark, root, on_error="raise"):
    r = FX.requests(spark, root)
    r = P.parse_user_content(r, "content", on_error=on_error)
    fb = P.parse_request_filename(F.col("file_name"))
    r = r.withColumn("_fb", fb)
    r = r.withColumn("_id", P.parse_custom_id("custom_id", F.col("_fb.fallback_group"), F.col("_fb.fallback_lang")))
    return r.select("custom_id", "row_id", "dataset", "file_name", "question", "answer_a", "answer_b",
                    F.col("_id.group").alias("group"), F.col("_id.language").alias("sample_language"),
                    F.col("_id.idx").alias("idx"), F.col("_id.gold").alias("gold"),
                    F.col("_id.pair_id").alias("pair_id"))


@register("j8_mark_pairs")
def q_j8(spark, root):
    return J.mark_pairs(parsed_requests(spark, root)).select("custom_id", "pair_id", "has_pair")


def swap_tasks(spark, root):
    x = J.expand_swaps(J.mark_pairs(parsed_requests(spark, root)))
    return x.withColumn("language", F.col("dataset")).withColumn("benchmark", F.lit("judgment-requests"))


@register("j9_expand_swaps")
def q_j9(spark, root):
    return swap_tasks(spark, root).select("id", "pair_id", "swapped", "expected_verdict",
                                          F.md5("answer_a").alias("a_hash"), F.md5("answer_b").alias("b_hash"))


@register("j10_limit_pairs")
def q_j10(spark, root):
    return J.limit_pairs(parsed_requests(spark, root), 25, order_col="row_id",
                         per=["file_name"]).select("custom_id", "file_name")


@register("j11_limit_per_language")
def q_j11(spark, root):
    d = table(spark, root, "documents").select("doc_id", "lang")
    return J.limit_per_language(d, 30, language="lang", order_col="doc_id")


@register("j12_build_requests")
def q_j12(spark, root):
    t = FX.judge_tasks(spark, root, seeds=[42])
    return J.build_requests(t, "judge-model", id_col="id", prompt="judge_prompt", max_tokens=512,
                            temperature=0.0, seed=42)


# ---------------------------------------------------------------------------- E ops
@register("e1_parse_verdict")
def q_e1(spark, root):
    c = FX.judge_completions(FX.judge_tasks(spark, root))
    return c.select("id", "seed", "completion", E.parse_verdict("completion").alias("verdict"))


@register("e2_build_records")
def q_e2(spark, root):
    tasks = FX.judge_tasks(spark, root)
    comp = FX.judge_completions(tasks)
    rec = E.build_records(tasks.select("id", "seed", "benchmark", "language", "expected_verdict"), comp)
    return rec.select("id", "seed", "verdict", "expected_verdict", "correct")


def raw_records(spark, root):
    rec = judge_records(spark, root)
    exp = F.when(h32(F.col("seed"), F.col("id")) % 97 == 0, F.lit(None).cast("string")) \
        .otherwise(F.col("expected_verdict"))
    return rec.withColumn("expected_verdict", exp).drop("correct")


@register("e3_parsed_from_raw")
def q_e3(spark, root):
    return E.parsed_from_raw(raw_records(spark, root)).select("id", "seed", "benchmark", "language", "correct")


@register("e4_missing_groups")
def q_e4(spark, root):
    expected = FX.pairs(spark, root).select("benchmark", "language")
    found = judge_records(spark, root).filter(F.col("language") != "de")
    return E.missing_groups(expected, E.parsed_projection(found), None)


@register("e4_missing_groups_raw")
def q_e4r(spark, root):
    """Parsed results for one language, raw ones (some undecidable) for the rest."""
    expected = FX.pairs(spark, root).select("benchmark", "language")
    parsed = E.parsed_projection(judge_records(spark, root).filter(F.col("language") == "de"))
    return E.missing_groups(expected, parsed, raw_records(spark, root).filter(F.col("language") != "de"))


@register("e6_bootstrap_ci")
def q_e6(spark, root):
    return E.bootstrap_ci(judge_records(spark, root), samples=200, confidence=0.95, seed=7)


def _values_text(col):
    return F.array_join(F.transform(col, lambda v: F.format_string("%.6f", v)), ",")


@register("e7_seed_statistics")
def q_e7(spark, root):
    s = E.seed_statistics(q_accuracy(spark, root))
    return s.select("benchmark", "language", "mean", "std", "n_seeds", _values_text(F.col("values")).alias("values"),
                    "first_total", "formatted")


def accuracy_run(spark, root, salt):
    tasks = FX.judge_tasks(spark, root)
    judged = FX.judge_completions_inline(tasks, L.make_stub_judge(salt))
    return E.accuracy(E.build_records(judged, None), by=["seed"])


@register("e8_paired_ttest")
def q_e8(spark, root):
    return E.paired_ttest(accuracy_run(spark, root, ""), accuracy_run(spark, root, "b"),
                          keys=("benchmark", "language"))


def bias_records(spark, root):
    tasks = E.with_seeds(swap_tasks(spark, root), FX.SEEDS)
    judged = FX.judge_completions_inline(tasks, keep=[*FX.RECORD_KEYS, "pair_id", "sample_language", "group", "gold"])
    return E.build_records(judged, None)


@register("e9_bias_severity")
def q_e9(spark, root):
    return E.bias_severity(bias_records(spark, root))


@register("e10_bias_seed_statistics")
def q_e10(spark, root):
    s = E.bias_seed_statistics(E.bias_severity(bias_records(spark, root)))
    return s.select("scope", "key", "measure", "mean", "std", "n_seeds",
                    _values_text(F.col("values")).alias("values"), "formatted")


@register("e11_expand_seeds")
def q_e11(spark, root):
    seeds = E.expand_seeds(base=42, n=3, step=1, explicit=[44, 42, 43, 42])
    t = E.with_seeds(FX.pairs(spark, root).select("id"), seeds)
    return t.groupBy("seed").agg(F.count(F.lit(1)).alias("tasks"), F.sum("id").alias("id_sum"))


@register("e12_report")
def q_e12(spark, root):
    acc = q_accuracy(spark, root)
    bias = E.bias_severity(bias_records(spark, root))
    return E.report_table(acc, bias)


@register("e13_compare_runs")
def q_e13(spark, root):
    return E.compare_runs(accuracy_run(spark, root, ""), accuracy_run(spark, root, "b"))


# ---------------------------------------------------------------------------- P ops
@register("p1_is_missing")
def q_p1(spark, root):
    s = FX.sections(spark, root)
    return s.select("id", P.is_missing("orig_criteria", strict=True).alias("missing_strict"),
                    P.is_missing("orig_criteria", strict=False).alias("missing_plain"),
                    P.is_missing("output", strict=True).alias("output_missing"))


@register("p2_sample_uncriteria")
def q_p2(spark, root):
    return P.sample_uncriteria(FX.sections(spark, root), 60, seed=42).select("id")


@register("p3_strip_reference_block")
def q_p3(spark, root):
    return FX.sections(spark, root).select("id", P.strip_reference_block("instruction").alias("cleaned"))


@register("p4_extract_sections")
def q_p4(spark, root):
    s = FX.sections(spark, root).select("id", P.extract_sections(P.strip_reference_block("instruction")).alias("x"))
    return s.select("id", "x.instruction", "x.response_A", "x.response_B")


@register("p5_prepare_preferences")
def q_p5(spark, root):
    return P.prepare_preferences(FX.sections(spark, root)).select(
        "id", "instruction", "response_A", "response_B", "judge_prompt", "output")


@register("p6_clean_judge_prompt")
def q_p6(spark, root):
    return FX.sections(spark, root).select("id", P.clean_judge_prompt("instruction").alias("cleaned"))


@register("p7_parse_user_content")
def q_p7(spark, root):
    r = P.parse_user_content(FX.requests(spark, root), "content")
    return r.select("custom_id", "question", "answer_a", "answer_b")


def _doc_ids(spark, root):
    d = table(spark, root, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id") % 6
    ds = F.col("doc_id").cast("string")
    cid = (F.when(k == 0, F.concat(F.lit("high_resource-"), F.col("lang"), F.lit("-"), ds, F.lit("-goldA")))
            .when(k == 1, F.concat(F.col("lang"), F.lit("_"), ds, F.lit("_goldB")))
            .when(k == 2, F.concat(F.lit("grp"), (F.col("doc_id") % 3).cast("string"), F.lit("--"), ds, F.lit("-goldA")))
            .when(k == 3, F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("_"), ds, F.lit("-goldB")))
            .when(k == 4, F.concat(F.lit("low_resource_"), F.col("lang"), F.lit("_"), ds, F.lit("_goldA")))
            .otherwise(F.concat(F.lit("bad"), ds)))
    j = F.col("doc_id") % 5
    fname = (F.when(j == 0, F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("_judgment_requests.jsonl")))
              .when(j == 1, F.concat(F.lit("high_resource_"), F.col("lang"), F.lit("_judgment_requests.jsonl")))
              .when(j == 2, F.concat(F.col("source"), F.lit("_judgment_requests.jsonl")))
              .when(j == 3, F.concat(F.lit("low_resource_"), F.col("lang"), F.lit("_judgment_requests.jsonl")))
              .otherwise(F.concat(F.col("source"), F.lit(".jsonl"))))
    return d.select("doc_id", cid.alias("custom_id"), fname.alias("file_name"))


@register("p8_parse_custom_id")
def q_p8(spark, root):
    d = _doc_ids(spark, root).withColumn("_fb", P.parse_request_filename(F.col("file_name")))
    x = d.withColumn("_id", P.parse_custom_id("custom_id", F.col("_fb.fallback_group"),
                                              F.col("_fb.fallback_lang"), on_error="null"))
    return x.select("doc_id", F.col("_id.group").alias("group"), F.col("_id.language").alias("language"),
                    F.col("_id.idx").alias("idx"), F.col("_id.gold").alias("gold"),
                    F.col("_id.pair_id").alias("pair_id"))


@register("p9_parse_request_filename")
def q_p9(spark, root):
    d = _doc_ids(spark, root).withColumn("_fb", P.parse_request_filename(F.col("file_name")))
    return d.select("doc_id", "_fb.fallback_group", "_fb.fallback_lang")


@register("p10_coerce_example")
def q_p10(spark, root):
    pr = FX.proxy(spark, root)
    x = pr.select("row_id", F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
                  .alias("judge_instruction"),
                  F.col("nll").cast("string").alias("proxy_nll_A"), F.col("ppl").alias("proxy_ppl_A"),
                  F.when(F.col("row_id") % 7 == 0, F.lit("abc")).otherwise(F.col("value").cast("string"))
                  .alias("proxy_length_A"))
    return P.coerce_example(x).select("row_id", "judge_prompt", "proxy_nll_A", "proxy_length_A")


@register("p11_filter_empty")
def q_p11(spark, root):
    kept, counts = P.filter_empty(FX.responses(spark, root), require_both=True)
    return kept.select("row_id")


@register("p11_filter_empty_a_only")
def q_p11a(spark, root):
    kept, counts = P.filter_empty(FX.responses(spark, root), require_both=False)
    return kept.select("row_id")


@register("p11_filter_empty_counts")
def q_p11c(spark, root):
    kept, counts = P.filter_empty(FX.responses(spark, root), require_both=True)
    return counts


@register("p12_flag_missing_proxy")
def q_p12(spark, root):
    pr = FX.proxy(spark, root)
    ppl_b = F.when(F.col("row_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("ppl"))
    nll_b = F.when(F.col("row_id") % 5 == 0, F.col("nll")).otherwise(F.lit(None).cast("double"))
    resp_b = F.when(F.col("row_id") % 4 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    return pr.select("row_id", P.flag_missing_proxy(F.col("nll"), F.lit(None).cast("string"), nll_b, ppl_b, resp_b)
                     .alias("missing_proxy"))


def _span_inputs(spark, root):
    t = seed42_tasks(spark, root)
    t = J.render_user(t, question="prompt", out="content")
    k = h32(F.col("id")) % 3
    resp_a = F.when(k == 0, F.regexp_replace("answer_a", "\n", "  ")).otherwise(F.col("answer_a"))
    resp_b = F.when(k == 1, F.concat(F.lit("  "), F.col("answer_b"))).otherwise(F.col("answer_b"))
    return t.select("id", "content", resp_a.alias("resp_a"), resp_b.alias("resp_b"))


@register("p13_locate_span")
def q_p13(spark, root):
    x = P.with_span(_span_inputs(spark, root), "span_a", "content", "resp_a")
    x = P.with_span(x, "span_b", "content", "resp_b", F.col("span_a.end"))
    return x.select("id", F.col("span_a.start").alias("a_start"), F.col("span_a.end").alias("a_end"),
                    F.col("span_b.start").alias("b_start"), F.col("span_b.end").alias("b_end"))


@register("p14_section_between")
def q_p14(spark, root):
    pg = table(spark, root, "pages").select("page_id", "html")
    return pg.select("page_id", P.section_between(F.col("html"), "<title>", "</title>").alias("title"),
                     P.section_between(F.col("html"), "<h1>", None).alias("after_h1_len")) \
             .withColumn("after_h1_len", F.length("after_h1_len"))


@register("p15_contains_either")
def q_p15(spark, root):
    p = FX.pairs(spark, root)
    piece = F.regexp_replace("chosen", WS, "\n")          # the whole answer, other blanks
    return p.select("id", P.contains_either(F.col("chosen"), piece).alias("c1"),
                    P.contains_either(F.col("rejected"), piece).alias("c2"))


@register("p16_preview")
def q_p16(spark, root):
    d = table(spark, root, "documents")
    return d.select("doc_id", P.preview("text", 120).alias("preview"))


@register("p16_preview_span")
def q_p16s(spark, root):
    x = P.with_span(_span_inputs(spark, root), "span", "content", "resp_b")
    return x.select("id", P.preview_span("content", F.col("span.start"), F.col("span.end"), 40).alias("preview"))


@register("p17_cap_rows")
def q_p17(spark, root):
    return P.cap_rows(table(spark, root, "documents").select("doc_id", "lang"), 300, order="doc_id")


@register("p18_prefilter_long")
def q_p18(spark, root):
    kept, stats, sample = P.prefilter_long(table(spark, root, "documents"), 2000, order="doc_id")
    return kept.select("doc_id")


@register("p18_prefilter_stats")
def q_p18s(spark, root):
    kept, stats, sample = P.prefilter_long(table(spark, root, "documents"), 2000, order="doc_id")
    return stats


@register("p18_prefilter_sample")
def q_p18d(spark, root):
    kept, stats, sample = P.prefilter_long(table(spark, root, "documents"), 2000, order="doc_id", k=5)
    return sample


@register("p19_output_to_text")
def q_p19(spark, root):
    conv = table(spark, root, "conversations")
    g = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("_a"),
        F.array_sort(F.collect_list("turn")).alias("turns"))
    texts = F.when(F.size("_a") > 0, F.transform("_a", lambda s: s["text"]))
    return g.select("conv_id", P.output_to_text_typed(texts, "array<string>").alias("text"),
                    P.output_to_text_typed(F.col("turns"), "array<bigint>").alias("turns_json"))


# ---------------------------------------------------------------------------- L ops
LANG_CODES = {"en": "eng_Latn", "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn"}
REQUESTED = ["en", "fr", "de", "es", "it"]


def _available_langs(spark, root):
    d = table(spark, root, "documents")
    code = F.when(F.col("lang") == "en", F.col("lang")).otherwise(
        F.element_at(F.create_map(*[x for kv in LANG_CODES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                     F.col("lang")))
    return d.select(code.alias("language"))


@register("l1_detect_language")
def q_l1(spark, root):
    d = table(spark, root, "documents")
    model = L.train_language_model(d, text="text", label="lang")
    return L.detect_language(d.select("doc_id", "text"), model).select("doc_id", "detected")


@register("l2_resolve_languages")
def q_l2(spark, root):
    req = spark.createDataFrame([(x,) for x in REQUESTED], "language string")
    return L.resolve_languages(req, _available_langs(spark, root), LANG_CODES)


@register("l3_core_languages")
def q_l3(spark, root):
    return L.core_languages(_available_langs(spark, root))


def translate_stub(pdf):
    return "[en] " + pdf["text"].fillna("")


def back_stub(pdf):
    return "[" + pdf["lang"].fillna("") + "] " + pdf["text_eng"].fillna("")


@register("l4_repivot_responses")
def q_l4(spark, root):
    r = FX.responses(spark, root).select("row_id", "response_A", F.coalesce("response_B", F.lit("")).alias("response_B"))
    long = L.unpivot_responses(r)
    eng = L.map_text(long, translate_stub, inputs=["text"], keys=["row_id", "side"], out="text_eng", dedupe=True)
    return L.repivot_responses(eng, value="text_eng", suffix="_eng")


@register("l4_back_translation")
def q_l4b(spark, root):
    """English and back: both sides of each row, with the row's own language."""
    langs = table(spark, root, "documents").select(F.col("doc_id").alias("_d"), "lang")
    r = FX.responses(spark, root).select("row_id", "conv_id", "response_A",
                                         F.coalesce("response_B", F.lit("")).alias("response_B"))
    r = r.join(langs, r["conv_id"] == langs["_d"])
    long = L.unpivot_responses(r)
    eng = L.map_text(long, translate_stub, inputs=["text"], keys=["row_id", "side"], out="text_eng")
    back = L.back_translate(eng.join(r.select("row_id", "lang"), "row_id"), back_stub)
    return L.repivot_responses(back, value="text_bt", suffix="_bt")


@register("l5_map_text")
def q_l5(spark, root):
    d = table(spark, root, "documents").select("doc_id", "text")
    return L.map_text(d, translate_stub, inputs=["text"], keys=["doc_id"], out="translated", dedupe=True) \
            .select("doc_id", F.md5("translated").alias("translated_md5"), F.length("translated").alias("n"))


# ---------------------------------------------------------------------------- M ops
from prefeval.operators import metrics as M  # noqa: E402
from prefeval.operators import subwords as U
from prefeval.operators import tokens as T  # noqa: E402

VALUE_EDGES = [0.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0]
MAG_EDGES = [0.0, 0.5, 0.7, 0.8, 0.9, 1.0, 1.5]


@register("m1_length_ttr")
def q_m1(spark, root):
    d = table(spark, root, "documents")
    m = M.length_ttr("text")
    return d.select("doc_id", m["length"].alias("length"), m["ttr"].alias("ttr"))


@register("m2_token_nll")
def q_m2(spark, root):
    d = table(spark, root, "documents").select("doc_id", "text")
    return M.token_nll(d, d, key="doc_id", text="text")


def _resp_with_proxy(spark, root):
    r = FX.responses(spark, root)
    k = h32(F.col("row_id")) % 3
    m = M.length_ttr("response_A")
    return r.select("row_id", "response_A",
                    F.when(k == 0, F.lit(None).cast("double")).otherwise(F.lit(-1.0)).alias("proxy_length_A"),
                    F.when(k == 1, F.lit(None).cast("double")).otherwise(F.lit(-1.0)).alias("proxy_ttr_A"),
                    F.when(k == 2, F.lit(0.5)).alias("proxy_nll_A"),
                    (F.col("row_id") % 7).cast("double").alias("proxy_ppl_A"))


@register("m3_backfill_proxy")
def q_m3(spark, root):
    return M.backfill_proxy(_resp_with_proxy(spark, root)).select("row_id", "proxy_length_A", "proxy_ttr_A", "proxy_nll_A", "computed")


def _cache_frames(spark, root):
    pr = FX.proxy(spark, root)
    data = pr.select("row_id", "nll")
    n = pr.agg(F.count(F.lit(1))).scalar()
    cache = pr.filter(F.col("row_id") < n * 0.9).select("row_id", (F.col("value") * 2).alias("nll"))
    return data, cache


@register("m4_merge_proxy_cache")
def q_m4(spark, root):
    data, cache = _cache_frames(spark, root)
    return M.merge_proxy_cache(data, cache)[0]


@register("m4_merge_proxy_stats")
def q_m4s(spark, root):
    data, cache = _cache_frames(spark, root)
    return M.merge_proxy_cache(data, cache)[1]


@register("m5_quantile_edges")
def q_m5(spark, root):
    return M.quantile_edges(table(spark, root, "lineitem"), "l_extendedprice", 10)


@register("m5_length_edges")
def q_m5l(spark, root):
    d = table(spark, root, "documents").select(M.length_ttr("text")["length"].alias("n"))
    return M.quantile_edges(d, "n", 6, lengths=True)


@register("m5_fallback_edges")
def q_m5f(spark, root):
    """No value passes the predicate: the default edges come back."""
    none = table(spark, root, "lineitem").filter(F.col("l_extendedprice") < 0)
    return M.quantile_edges(none, "l_extendedprice", 10)


@register("m6_bucketize")
def q_m6(spark, root):
    ev = table(spark, root, "events")
    return ev.select("event_id", M.bucketize("value", VALUE_EDGES).alias("bin"))


@register("m7_soft_bin")
def q_m7(spark, root):
    pr = FX.proxy(spark, root)
    sb = M.soft_bin("nll", VALUE_EDGES)
    return pr.select("row_id", sb["label"].alias("label"),
                     *[F.element_at(sb["target"], i + 1).alias(f"w{i}") for i in range(len(VALUE_EDGES) - 1)])


@register("m8_proxy_labels")
def q_m8(spark, root):
    r = FX.responses(spark, root)
    nll = lambda side: F.when(h32(F.lit(side), F.col("row_id")) % 5 != 0,
                              (h32(F.lit(side), F.col("row_id")) % 900).cast("double") / 100)
    lab = M.proxy_labels(r.withColumn("proxy_nll_A", nll("A")).withColumn("proxy_nll_B", nll("B")))
    cells = [F.element_at(f"{m}.target", i + 1).alias(f"{m}_w{i}")
             for m, bins in (("length", M.DEFAULT_LENGTH_BINS), ("ttr", M.DEFAULT_TTR_BINS), ("nll", M.DEFAULT_NLL_BINS))
             for i in range(len(bins) - 1)]
    return lab.select("row_id", "side", "present", F.col("length.label").alias("length_label"),
                      F.col("ttr.label").alias("ttr_label"), F.col("nll.label").alias("nll_label"), *cells)


@register("m9_bin_histogram")
def q_m9(spark, root):
    pr = FX.proxy(spark, root)
    sb = pr.select(M.soft_bin("nll", VALUE_EDGES).alias("s")).select("s.label", "s.target")
    return M.bin_histogram(sb)


def _doc_length_bins(spark, root):
    """Soft bins of document lengths: equal lengths of a language are counted
    first, so each text is split once and its length binned once."""
    d = table(spark, root, "documents")
    n = d.select("lang", M.length_ttr("text")["length"].alias("_len")).groupBy("lang", "_len") \
         .agg(F.count(F.lit(1)).alias("rows"))
    return materialize(n, "length-counts").select("lang", "rows", M.soft_bin("_len", M.DEFAULT_LENGTH_BINS).alias("s")) \
        .select("lang", "rows", "s.label", "s.target")


@register("m10_distribution_distance")
def q_m10(spark, root):
    bins = _doc_length_bins(spark, root)
    per = M.bin_histogram(bins, group=["lang"], weight="rows")
    ref = M.bin_histogram(bins, group=[], weight="rows")
    return M.distribution_distance(per, ref, "lang", len(M.DEFAULT_LENGTH_BINS) - 1)


@register("m11_soft_histogram")
def q_m11(spark, root):
    li = table(spark, root, "lineitem")
    return M.soft_histogram(li, "l_quantity", [0.0, 5.0, 10.0, 25.0, 40.0, 50.0], group=["l_returnflag"])


@register("m12_vector_moments")
def q_m12(spark, root):
    # moments of standardised floats: reported to 5 decimals (summation order
    # differs between engines in the 7th digit)
    m = M.vector_moments(table(spark, root, "embeddings"))
    return m.select("label", "dim", *[F.round(x, 5).alias(x) for x in ("mean", "var", "logvar")])


@register("m13_magnitude_histogram")
def q_m13(spark, root):
    return M.magnitude_histogram(table(spark, root, "embeddings"), MAG_EDGES)


@register("m14_gaussian_kl")
def q_m14(spark, root):
    return M.gaussian_kl(M.vector_moments(table(spark, root, "embeddings")))


def vec_pairs(spark, root):
    e = table(spark, root, "embeddings")
    a = e.filter(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("long").alias("pair"),
                                                 F.col("embedding").alias("task"), F.col("label").alias("grp"))
    b = e.filter(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("long").alias("pair"),
                                                 F.col("embedding").alias("bias"))
    return a.join(b, "pair")


@register("m15_dependence_audit")
def q_m15(spark, root):
    return M.dependence_audit(vec_pairs(spark, root), min_batch=5)


@register("m16_last_n")
def q_m16(spark, root):
    ev = table(spark, root, "events").select("event_id", "event_type", "ts")
    return M.last_n(ev, 100, "event_type", ["ts", "event_id"]).select("event_id", "event_type")


# ---------------------------------------------------------------------------- T ops
@register("t1_encode")
def q_t1(spark, root):
    d = T.encode(table(spark, root, "documents").select("doc_id", "text"), "text", 256)
    return d.select("doc_id", F.array_join("ids", " ").alias("ids"), "ids_mask")


def _sft_rows(spark, root):
    r = FX.responses(spark, root)
    return r.select("row_id", F.coalesce("instruction", F.lit("")).alias("judge_prompt"),
                    F.coalesce("response_A", F.lit("")).alias("output"))


@register("t2_encode_pair")
def q_t2(spark, root):
    x = T.encode_pair(_sft_rows(spark, root), "judge_prompt", "output", 64)
    return x.select("row_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("labels", " ").alias("labels"), "prompt_overflow", "target_len")


@register("t3_label_tokens")
def q_t3(spark, root):
    x = T.label_tokens(_sft_rows(spark, root), "judge_prompt", "output", 96)
    return x.select("row_id", "target_start", F.array_join("labels", " ").alias("labels"), "truncated")


@register("t4_tag_response_tokens")
def q_t4(spark, root):
    x = P.with_span(_span_inputs(spark, root), "span_a", "content", "resp_a")
    x = P.with_span(x, "span_b", "content", "resp_b", F.col("span_a.end"))
    whole = T.tag_response_tokens(x, "content", "span_a", "span_b")
    return whole.select("id", F.array_join("response_types", "").alias("types"))


@register("t4_tag_truncated")
def q_t4t(spark, root):
    """The same with truncation to 400 tokens."""
    x = P.with_span(_span_inputs(spark, root), "span_a", "content", "resp_a")
    x = P.with_span(x, "span_b", "content", "resp_b", F.col("span_a.end"))
    cut = T.tag_response_tokens(x, "content", "span_a", "span_b", 400)
    return cut.select("id", F.array_join("response_types", "").alias("types"))


@register("t4_tag_by_ids")
def q_t4i(spark, root):
    """The fallback without offsets. Every third answer begins with a word
    that the prompt does not hold there, so its ids match from the second on."""
    x = _span_inputs(spark, root).withColumn("resp_b", F.when(
        F.col("id") % 3 == 0, F.concat(F.lit("Different "), "resp_b")).otherwise(F.col("resp_b")))
    return T.tag_by_ids(x, "content", "resp_a", "resp_b").select("id", F.array_join("response_types", "").alias("types"))


def _subwords():
    """A public byte-level vocabulary; its one control id ends and pads."""
    import public_tokenizers
    return U.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


SUBWORD_END = 50256


@register("t1_encode_subwords")
def q_t1u(spark, root):
    d = U.encode(table(spark, root, "documents").select("doc_id", "text"), "text", _subwords(), 256)
    return d.select("doc_id", F.array_join("ids", " ").alias("ids"), "ids_mask")


@register("t2_encode_pair_subwords")
def q_t2u(spark, root):
    x = U.encode_pair(_sft_rows(spark, root), "judge_prompt", "output", _subwords(), 64, SUBWORD_END, SUBWORD_END)
    return x.select("row_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("labels", " ").alias("labels"), "prompt_overflow", "target_len")


@register("t3_label_subwords")
def q_t3u(spark, root):
    x = U.label_tokens(_sft_rows(spark, root), "judge_prompt", "output", _subwords(), 96, SUBWORD_END)
    return x.select("row_id", "target_start", F.array_join("labels", " ").alias("labels"), "truncated")


@register("t4_tag_subwords")
def q_t4u(spark, root):
    x = P.with_span(_span_inputs(spark, root), "span_a", "content", "resp_a")
    x = P.with_span(x, "span_b", "content", "resp_b", F.col("span_a.end"))
    whole = U.tag_response_tokens(x, "content", "span_a", "span_b", _subwords())
    return whole.select("id", F.array_join("response_types", "").alias("types"))


def _policy_rows(spark, root):
    """48 tokens is the policy's own ``max_len``; every ninth row stands for a
    row that the encoder truncated."""
    x = T.encode_pair(_sft_rows(spark, root), "judge_prompt", "output", 48)
    return x.withColumn("batch_id", F.floor(F.col("row_id") / 4000)) \
        .withColumn("truncated", F.col("row_id") % 9 == 1) \
        .withColumn("response_types", F.transform("labels", lambda v: (v != -100).cast("int")))


@register("t5_length_policy_drop")
def q_t5(spark, root):
    rows, counts = T.apply_length_policy(_policy_rows(spark, root), "drop", 20, 48)
    return rows.select("row_id", "batch_id", F.array_join("input_ids", " ").alias("input_ids"),
                       F.array_join("labels", " ").alias("labels"))


@register("t5_length_policy_mask")
def q_t5m(spark, root):
    rows, counts = T.apply_length_policy(_policy_rows(spark, root), "mask", 20, 48)
    return rows.select("row_id", F.array_join("labels", " ").alias("labels"),
                       F.array_join("response_types", "").alias("types"))


@register("t5_length_policy_counts")
def q_t5c(spark, root):
    return T.apply_length_policy(_policy_rows(spark, root), "mask", 20, 48)[1]


@register("t6_pack_batches")
def q_t6(spark, root):
    """Whole texts; ids with gaps (every eleventh left out by the rule below)."""
    d = T.encode(_gapped_docs(spark, root), "text", None, out="input_ids")
    p = T.pack_batches(d, 8, side="left")
    return p.select("row_id", "batch_id", F.array_join("padded", " ").alias("padded"),
                    F.array_join("attention_mask", "").alias("mask"))


def _gapped_docs(spark, root):
    """Every document, under row ids that leave gaps."""
    return table(spark, root, "documents").select(
        (F.col("doc_id") + F.floor(F.col("doc_id") / 10)).alias("row_id"), "text")


@register("t6_pack_batches_max_length")
def q_t6m(spark, root):
    d = T.encode(_gapped_docs(spark, root), "text", None, out="input_ids")
    p = T.pack_batches(d, 8, side="right", max_length=40)
    return p.select("row_id", "batch_id", F.array_join("padded", " ").alias("padded"),
                    F.array_join("attention_mask", "").alias("mask"))


def _num(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    from prefeval.functions.keys import dense_index
    return dense_index(li, [], ["l_orderkey", "l_linenumber"], name="row_id")


@register("t7_shards")
def q_t7(spark, root):
    x = _num(spark, root)
    n = x.agg(F.count(F.lit(1))).scalar()
    return x.select("row_id", T.shard_contiguous(F.col("row_id"), n, 7).alias("contiguous"),
                    T.shard_strided("row_id", 7).alias("strided"))


@register("t8_merge_shards")
def q_t8(spark, root):
    x = _num(spark, root)
    expected = x.agg(F.count(F.lit(1))).scalar()      # the dataset size the shards must cover
    shards = x.select(F.col("row_id").alias("idx"), T.shard_strided("row_id", 4).alias("rank"),
                      F.lit(4).alias("world_size")).filter(~((F.col("rank") == 3) & (F.col("idx") % 10 == 3)))
    return T.merge_shards(shards, expected=expected)[1]


@register("t9_rank_align")
def q_t9(spark, root):
    x = P.with_span(_span_inputs(spark, root), "span_a", "content", "resp_a")
    x = P.with_span(x, "span_b", "content", "resp_b", F.col("span_a.end"))
    x = T.tag_response_tokens(x, "content", "span_a", "span_b")
    # *_outer + null filter: a plain (pos)explode of a computed array lets
    # Catalyst copy the whole array expression into an inferred filter
    types = x.select(F.col("id").alias("row_id"), F.posexplode_outer("response_types").alias("pos", "side")) \
        .filter(F.col("side").isNotNull())
    vals = x.select(F.col("id").alias("row_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("side"), words("resp_a").alias("w")),
        F.struct(F.lit(2).alias("side"), words("resp_b").alias("w")))).alias("s")) \
        .select("row_id", "s.side", F.posexplode_outer("s.w").alias("vpos", "word")) \
        .filter(F.col("word").isNotNull()) \
        .select("row_id", "side", "vpos", F.length("word").cast("double").alias("value"))
    return T.rank_align(types, vals)


# ---------------------------------------------------------------------------- G ops
from prefeval.operators import ledger as R  # noqa: E402
from prefeval.operators import logs as G  # noqa: E402

WEIGHT_BASE = {"click": 1.0, "view": 0.5, "purchase": 2.0, "signup": 0.0, "error": 1.0}
SCHEDULE = [(0.0, 0.0), (0.2, 0.0), (0.45, 0.2), (0.75, 1.0), (0.75, 1.5), (1.0, 1.2)]


@register("g1_ema")
def q_g1(spark, root):
    return G.ema(FX.metric_log(spark, root), decay=0.98).select("run", "metric", "step", "ema", "ema_prev")


@register("g2_spikes")
def q_g2(spark, root):
    e = G.ema(FX.metric_log(spark, root), decay=0.95)
    return G.spikes(e, threshold=300.0, multiplier=3.0).select("run", "metric", "step", "value")


@register("g2_spike_samples")
def q_g2s(spark, root):
    """The rows with the fewest label tokens in each spiking step: the log's
    spikes joined to training rows of the same run and step."""
    e = G.ema(FX.metric_log(spark, root), decay=0.95)
    hit = G.spikes(e, threshold=300.0, multiplier=3.0).select("run", "step").distinct()
    rows = _policy_rows(spark, root).select("row_id", (F.col("row_id") % 8).alias("run"),
                                            (F.floor(F.col("row_id") / 8) % 200).alias("step"),
                                            F.col("target_len").alias("label_tokens"))
    return G.fewest_labels(rows.join(hit, ["run", "step"]), k=2, keys=("run", "step"))


@register("g3_epoch_summary")
def q_g3(spark, root):
    x = FX.metric_log(spark, root).withColumn("epoch", F.floor(F.col("step") / 50).cast("long")) \
        .withColumn("dropped", F.col("value") > 250)
    return G.epoch_summary(x)


def hourly_losses(spark, root):
    ev = table(spark, root, "events")
    t = F.col("ts").cast("timestamp")
    x = ev.select((F.col("user_id") % 8).alias("run"), F.col("event_type").alias("metric"), "value",
                  ((F.dayofmonth(t) - 1) * 24 + F.hour(t)).alias("step"))
    return x.groupBy("run", "step", "metric").agg(F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n"))


def _weights(spark, root):
    return G.inverse_ema_weights(hourly_losses(spark, root), WEIGHT_BASE, keys=("run",), decay=0.9,
                                 warmup=3, min_w=0.1, max_w=5.0)


@register("g4_inverse_ema_weights")
def q_g4(spark, root):
    return _weights(spark, root)[0].select("run", "step", "metric", "weight")


@register("g4_weighted_loss")
def q_g4w(spark, root):
    return _weights(spark, root)[1]


@register("g5_throughput")
def q_g5(spark, root):
    x = table(spark, root, "events").select((F.col("user_id") % 8).alias("run"), "ts", "value")
    return G.throughput(x, keys=("run",), tokens="value", window="1 hour")


@register("g5_sliding_throughput")
def q_g5_sliding(spark, root):
    x = table(spark, root, "events").select((F.col("user_id") % 8).alias("run"), "ts", "value")
    return G.sliding_throughput(x, slide="15 minutes", panes=4)


@register("g6_interpolate_schedule")
def q_g6(spark, root):
    ev = table(spark, root, "events")
    progress = F.dayofmonth(F.col("ts").cast("timestamp")) / F.lit(30.0)
    return ev.select("event_id", G.interpolate_schedule(progress, SCHEDULE).alias("weight"))


@register("g6_schedule_table")
def q_g6_table(spark, root):
    """Each user's schedule is the user's errors: position by the day (several
    on a day are a step), value as logged; purchases and views are looked up."""
    ev = table(spark, root, "events").withColumn("day", F.dayofmonth(F.col("ts").cast("timestamp")) / F.lit(30.0))
    points = ev.filter("event_type = 'error'").select("user_id", F.col("day").alias("position"), "value", "event_id")
    rows = ev.filter("event_type <> 'error'").select("event_id", "user_id", "day")
    return G.schedule_values(rows, points, "day", keys=("user_id",), order="event_id", name="weight") \
        .select("event_id", "user_id", "weight")


# ---------------------------------------------------------------------------- R ops
def _gapped_events(spark, root):
    """Every event, under ids that leave gaps."""
    return table(spark, root, "events").withColumn("event_id", F.col("event_id") + F.floor(F.col("event_id") / 3))


@register("r1_assign_batches")
def q_r1(spark, root):
    return R.assign_batches(_gapped_events(spark, root).select("event_id"), 500, order="event_id")


@register("r2_batch_health")
def q_r2(spark, root):
    ev = _gapped_events(spark, root).select("event_id", (F.col("event_type") == "error").alias("failed"))
    return R.batch_health(R.assign_batches(ev, 20, order="event_id"))


def _latest(spark, root):
    return R.latest_status(FX.ledger(spark, root), max_wait_seconds=2 * 86400.0)


@register("r3_latest_status")
def q_r3(spark, root):
    return _latest(spark, root).select("id", "status", "output", "expired_rounds", "attempts")


@register("r4_to_resubmit")
def q_r4(spark, root):
    return R.to_resubmit(_latest(spark, root), max_rounds=3)


def _requests(spark, root):
    return table(spark, root, "customer").select(F.col("c_custkey").alias("id"))


@register("r5_completions")
def q_r5(spark, root):
    return R.completions(_requests(spark, root), _latest(spark, root))[0]


@register("r5_completion_failures")
def q_r5f(spark, root):
    return R.completions(_requests(spark, root), _latest(spark, root))[1]


@register("r6_pending")
def q_r6(spark, root):
    return R.pending(FX.ledger(spark, root))


# ---------------------------------------------------------------------------- S / K ops (round trips)
from pyspark.sql import types as _T  # noqa: E402

from prefeval.session import materialize, scratch_dir  # noqa: E402
from prefeval.sinks import files as K  # noqa: E402
from prefeval.sources import files as S  # noqa: E402
from prefeval.streaming import ops as ST  # noqa: E402

RECORD_SCHEMA = _T.StructType([
    _T.StructField("id", _T.LongType()), _T.StructField("seed", _T.IntegerType()),
    _T.StructField("verdict", _T.StringType()), _T.StructField("correct", _T.BooleanType()),
    _T.StructField("benchmark", _T.StringType()), _T.StructField("language", _T.StringType())])


def _record_rows(spark, root):
    return judge_records(spark, root).select("id", "seed", "verdict", "correct", "benchmark", "language")


@register("k1_write_jsonl")
def q_k1(spark, root):
    path = scratch_dir(spark, "k1")
    K.write_jsonl(_record_rows(spark, root), path, by=("benchmark", "language"))
    return spark.read.schema(RECORD_SCHEMA).json(path)


@register("k1_write_results")
def q_k1k(spark, root):
    """Raw and parsed lines, read back with their kind and group folders."""
    path = scratch_dir(spark, "k1k")
    records = judge_records(spark, root, keep=[*FX.RECORD_KEYS, "prompt", "answer_a", "answer_b"])
    K.write_results(records, path, by=("benchmark", "language"))
    got = spark.read.text(path)
    field = lambda n: F.get_json_object("value", f"$.{n}")
    return got.select("kind", "benchmark", "language", field("id").cast("long").alias("id"),
                      field("seed").cast("int").alias("seed"), field("verdict").alias("verdict"),
                      field("expected_verdict").alias("expected_verdict"), field("correct").alias("correct"),
                      F.md5(field("answer_a")).alias("a_hash"), F.md5(field("completion")).alias("c_hash"))


@register("k3_replace_dataset")
def q_k3(spark, root):
    path = scratch_dir(spark, "k3")
    recs = _record_rows(spark, root)
    K.replace_dataset(recs.filter(F.col("seed") == 42), path)       # an older version
    K.replace_dataset(recs, path)                                    # replaced after success
    return spark.read.parquet(path)


@register("k2_write_proxy_cache")
def q_k2(spark, root):
    path = scratch_dir(spark, "k2")
    rows = M.backfill_proxy(_resp_with_proxy(spark, root)).drop("computed", "response_A", "proxy_ppl_A")
    K.write_proxy_cache(rows, path)
    schema = _T.StructType([_T.StructField("row_id", _T.LongType()),
                            _T.StructField("proxy_length_A", _T.DoubleType()),
                            _T.StructField("proxy_ttr_A", _T.DoubleType()),
                            _T.StructField("proxy_nll_A", _T.DoubleType())])
    return spark.read.schema(schema).json(path)


@register("s2_read_jsonl")
def q_s2(spark, root):
    path = scratch_dir(spark, "s2")
    reqs = FX.requests(spark, root).select(F.col("custom_id").alias("idx"), F.col("content").alias("prompt"))
    K.write_prompt_log(reqs, path)
    # malformed and blank lines next to the good ones: skipped and counted
    bad = reqs.filter(h32("idx") % 5 == 0) \
        .select(F.concat(F.lit("{\"idx\": "), F.col("idx"), F.lit(" broken\n")).alias("value"))
    bad.write.mode("append").text(path)
    schema = _T.StructType([_T.StructField("idx", _T.StringType()), _T.StructField("prompt", _T.StringType())])
    rows, obs = S.read_jsonl(spark, path, schema, bad="skip")
    kept = scratch_dir(spark, "s2-kept")
    rows.write.parquet(kept)                          # one pass, after which the count is known
    return spark.read.parquet(kept).withColumn("malformed", F.lit(int(obs.get["malformed"])).cast("long"))


def _conversation_requests(spark, root):
    conv = table(spark, root, "conversations")
    g = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"),
        F.max(F.col("role") == "user").alias("_has_user"))
    g = g.filter("_has_user")
    msgs = F.transform("_t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return g.select(F.concat(F.lit("c-"), F.col("conv_id").cast("string")).alias("custom_id"),
                    F.struct(msgs.alias("messages")).alias("body"),
                    F.concat(F.lit("set"), (F.col("conv_id") % 2).cast("string")).alias("dataset"),
                    F.lit("high_resource_en_judgment_requests.jsonl").alias("file_name"))


@register("s3_read_judgment_requests")
def q_s3(spark, root):
    path = scratch_dir(spark, "s3")
    _conversation_requests(spark, root).write.mode("overwrite").partitionBy("dataset", "file_name").json(path)
    return S.read_judgment_requests(spark, path, datasets=["set0", "set1"])


@register("s1_read_preferences")
def q_s1(spark, root):
    folder = scratch_dir(spark, "s1")
    K.write_named_shards(FX.sections(spark, root), f"{folder}/data", prefix="train")
    return S.read_preferences(spark, folder).select("id", "orig_criteria", "output", F.md5("instruction").alias("h"))


@register("s4_available_languages")
def q_s4(spark, root):
    """A benchmark tree written from ``documents`` (one folder per language;
    one without a marker file, one hidden, one excluded), then listed."""
    folder = scratch_dir(spark, "s4")
    docs = table(spark, root, "documents").select("doc_id", "lang")
    for lang, part in {"en": "en", "fr": "fr", "de": ".hidden", "es": "translation"}.items():
        K.write_named_shards(docs.filter(F.col("lang") == lang), f"{folder}/{part}", prefix="test")
    K.write_named_shards(docs.filter(F.col("lang") == "de"), f"{folder}/unmarked", prefix="train")
    return S.available_languages(spark, folder)


SUMMARY_SCHEMA = _T.StructType([
    _T.StructField("seed", _T.IntegerType()),
    _T.StructField("benchmarks", _T.MapType(_T.StringType(), _T.MapType(_T.StringType(), _T.StructType([
        _T.StructField("total", _T.LongType()), _T.StructField("correct", _T.LongType()),
        _T.StructField("accuracy", _T.DoubleType())]))))])


@register("s5_read_seed_results")
def q_s5(spark, root):
    folder = scratch_dir(spark, "s5")
    K.write_summary(q_accuracy(spark, root), folder)
    rows, _missing = S.read_seed_results(spark, folder, [42, 43, 44, 45], schema=SUMMARY_SCHEMA)
    return rows.select("seed", F.explode("benchmarks").alias("benchmark", "langs")) \
               .select("seed", "benchmark", F.explode("langs").alias("language", "v")) \
               .select("seed", "benchmark", "language", F.col("v.total").alias("total"),
                       F.col("v.correct").alias("correct"), F.col("v.accuracy").alias("accuracy"))


@register("k5_aggregate_summary")
def q_k5(spark, root):
    """The all-seeds document with its t-tests, written and read back as rows."""
    folder = scratch_dir(spark, "k5")
    stats = E.seed_statistics(q_accuracy(spark, root))
    tests = E.compare_runs(accuracy_run(spark, root, ""), accuracy_run(spark, root, "b"))
    K.aggregate_json(stats, tests).write.mode("overwrite").text(folder)
    doc = spark.read.text(folder)
    leaf = "struct<mean:double,std:double,formatted:string>"
    parsed = doc.select(F.from_json("value", f"benchmarks map<string,map<string,{leaf}>>, "
                                             "paired_t_tests map<string,struct<p_value:double>>").alias("d"))
    means = parsed.select(F.explode("d.benchmarks").alias("benchmark", "langs")) \
        .select("benchmark", F.explode("langs").alias("language", "v")) \
        .select("benchmark", "language", F.col("v.mean").alias("mean"), F.col("v.formatted").alias("formatted"))
    names = parsed.select(F.explode("d.paired_t_tests").alias("benchmark", "t")) \
        .select("benchmark", F.lit("t-test").alias("language"), F.lit(None).cast("double").alias("mean"),
                F.lit(None).cast("string").alias("formatted"))
    return means.unionByName(names)


# ---------------------------------------------------------------------------- ST ops
@register("st1_incremental_eval")
def q_st1(spark, root):
    base = scratch_dir(spark, "st1")
    recs = _record_rows(spark, root)
    for s in FX.SEEDS:                      # three result drops arrive one after another
        recs.filter(F.col("seed") == s).write.mode("append").parquet(f"{base}/results")
        ST.incremental_eval(spark, f"{base}/results", recs.schema, f"{base}/totals", f"{base}/ckpt")
    t = ST.totals(spark, f"{base}/totals")
    return E.accuracy_from_totals(t, by=["seed"])


@register("st2_stream_ema")
def q_st2(spark, root):
    base = scratch_dir(spark, "st2")
    log = FX.metric_log(spark, root).select("run", "metric", "step", "value")
    for part in (1, 0, 2):                  # drops out of step order, each folded as it comes
        log.filter(F.col("step") % 3 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{base}/in")
        out = ST.run_to_table(spark, ST.stream_ema(stream, decay=0.98), f"{base}/out", f"{base}/ckpt")
    return out


@register("m16_stream_last_n")
def q_m16s(spark, root):
    """The events arrive in three parts, not in order of time."""
    base = scratch_dir(spark, "m16")
    ev = table(spark, root, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    for part in (1, 2, 0):
        ev.filter(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(ev.schema).parquet(f"{base}/in")
        out = ST.run_to_table(spark, ST.stream_last_n(stream, 100, "event_type", ["ts", "event_id"]),
                              f"{base}/out", f"{base}/ckpt")
    return ST.current_last_n(out, "event_type").select("event_id", "event_type")


@register("st3_stream_ledger")
def q_st3(spark, root):
    base = scratch_dir(spark, "st3")
    FX.ledger(spark, root).select("id", "ts", "status").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    return ST.run_to_table(spark, ST.stream_ledger(stream), f"{base}/out", f"{base}/ckpt")


@register("st4_stream_throughput")
def q_st4(spark, root):
    base = scratch_dir(spark, "st4")
    table(spark, root, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value") \
        .write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    return ST.run_to_table(spark, ST.stream_throughput(stream), f"{base}/out", f"{base}/ckpt")


@register("e5_accuracy_with_bias")
def q_e5b(spark, root):
    """E5 over pair records and swapped-pair records together: the pair-bias
    benchmark gets its own rows but stays out of the overall level."""
    cols = ["seed", "benchmark", "language", "correct"]
    rec = judge_records(spark, root).select(*cols).unionByName(bias_records(spark, root).select(*cols))
    return E.accuracy(rec, by=["seed"], bias_benchmarks=["judgment-requests"])
