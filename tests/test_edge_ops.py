
import math
import os

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from prefeval.functions.keys import dense_index
from prefeval.operators import clean as P
from prefeval.operators import evaluate as E
from prefeval.operators import lang as L
from prefeval.operators import ledger as R
from prefeval.operators import logs as G
from prefeval.operators import metrics as M
from prefeval.operators import tasks as J
from prefeval.operators import tokens as T


def test_parse_verdict_rules(spark):
    rows = [("x [[B]] then [[A]]", "B"), ("final [[a]]", "A"), ("no verdict", None),
            (None, None), ("[[A]] and [[b]]", "A"), ("only lower [[b]]", "B")]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select(E.parse_verdict("t").alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]
    # an empty pattern never matches
    got = df.select(E.parse_verdict("t", "[[A]]", "").alias("v")).collect()
    assert [r.v for r in got] == ["A", "A", None, None, "A", None]


def test_custom_id_edge_cases(spark):
    rows = [("high_resource-en-12-goldA", "high_resource", "en"),
            ("en_12_goldB", None, None),
            ("grp1--7-goldA", None, "de"),
            ("malformed", None, None)]
    df = spark.createDataFrame(rows, "cid string, fg string, fl string")
    out = df.select(P.parse_custom_id("cid", F.col("fg"), F.col("fl"), on_error="null").alias("p")).collect()
    assert (out[0].p.group, out[0].p.language, out[0].p.pair_id) == ("high_resource", "en", "high_resource-en-12")
    assert (out[1].p.group, out[1].p.language) == ("unknown", "en")
    assert (out[2].p.group, out[2].p.language) == ("grp1", "de")
    assert out[3].p is None
    with pytest.raises(Exception):
        df.select(P.parse_custom_id("cid")).collect()


def test_request_filename(spark):
    names = ["high_resource_en_judgment_requests.jsonl", "src1_de_x_judgment_requests.jsonl",
             "src1_judgment_requests.jsonl", "other.jsonl"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r.f) for r in df.select(P.parse_request_filename("n").alias("f")).collect()]
    assert got == [("high_resource", "en"), ("src1", "de_x"), (None, "src1"), (None, None)]


def test_template_keeps_unknown_and_does_not_refill(spark):
    df = spark.createDataFrame([("Q with {answer_a} inside", "A", "B", "en")],
                               "prompt string, answer_a string, answer_b string, language string")
    out = J.render_template(df, "{question}|{{x}}|{unknown}|{answer_a}", out="t").first().t
    assert out == "Q with {answer_a} inside|{x}|{unknown}|A"


def test_user_content_crlf_and_error(spark):
    df = J.render_user(spark.createDataFrame([("q\nline", "a", "b")], "prompt string, answer_a string, answer_b string"))
    df = df.withColumn("content", F.regexp_replace("content", "\n", "\r\n"))
    r = P.parse_user_content(df, "content").first()
    assert (r.question, r.answer_a, r.answer_b) == ("q\nline", "a", "b")
    bad = spark.createDataFrame([("nothing here",)], "content string")
    with pytest.raises(Exception):
        P.parse_user_content(bad, "content").collect()


def test_locate_span_whitespace_fallback(spark):
    df = spark.createDataFrame([("ab  cd\nef gh", "cd ef", -1), ("xx yy xx", "xx", 1)], "p string, r string, s int")
    got = P.with_span(df, "sp", "p", "r", F.col("s")).collect()
    assert (got[0].sp.start, got[0].sp.end) == (4, 9)      # 'cd\nef' found without whitespace
    assert (got[1].sp.start, got[1].sp.end) == (6, 8)      # search from start_at


def test_bucketize_and_soft_bin_edges(spark):
    edges = [0.0, 1.0, 1.0, 3.0]
    vals = [(-1.0,), (0.0,), (1.0,), (2.0,), (3.0,), (9.0,), (None,), (float("nan"),)]
    df = spark.createDataFrame(vals, "v double")
    b = [r.b for r in df.select(M.bucketize("v", edges).alias("b")).collect()]
    assert b == [0, 0, 0, 2, 2, 2, None, None]
    sb = df.select(M.soft_bin("v", edges).alias("s")).collect()
    for r in sb:
        if r.s.label != -100:
            assert abs(sum(r.s.target) - 1.0) < 1e-12          # weights sum to 1
    assert sb[6].s.label == -100 and sb[6].s.target == [0.0, 0.0, 0.0]
    assert sb[1].s.target == [1.0, 0.0, 0.0]


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 3001).alias("o"))
    a = dense_index(df, ["g"], ["o"], "rn")
    from pyspark.sql import Window
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    j = a.join(b, ["g", "o"])
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0 and j.count() == 3000


def test_ema_block_scan_equals_sequential_fold(spark):
    vals = [1.0, 2.0, float("nan"), 4.0, 5.0, float("inf"), 7.0, 8.0, 9.0, 10.0, 11.0]
    df = spark.createDataFrame([(0, "m", i, v) for i, v in enumerate(vals)], "run int, metric string, step long, value double")
    got = G.ema(df, decay=0.9, block=3).orderBy("step").collect()
    prev = None
    for r, v in zip(got, vals):
        prev = G._step(prev, v, 0.9, "restart")
        # NaN crosses the Arrow boundary as null
        got_v = float("nan") if r.ema is None else r.ema
        assert (math.isnan(prev) and math.isnan(got_v)) or (math.isinf(prev) and math.isinf(got_v)) or \
            abs(got_v - prev) < 1e-12


def test_bias_severity_pair_rules(spark):
    rows = [("p1", "A", True), ("p1", "B", True),            # human win
            ("p2", "A", False), ("p2", "B", False),          # machine win
            ("p3", None, False), ("p3", "A", True),          # null verdict: total only
            ("p4", "A", True), ("p4", "A", True), ("p4", "B", True)]   # three rows: ignored
    df = spark.createDataFrame([(i, 1, p, v, c, "en", "g") for i, (p, v, c) in enumerate(rows)],
                               "id int, seed int, pair_id string, verdict string, correct boolean, language string, group string")
    r = E.bias_severity(df).filter("scope = 'overall'").first()
    assert (r.total_pairs, r.consistent_human_win, r.consistent_machine_win) == (3, 1, 1)
    assert r.bias_severity == 0.5


def test_ttest_pvalue_closed_forms():
    for t in (0.5, 1.7, 4.2):
        assert abs(E.t_two_sided_p(t, 2.0) - (1 - t / math.sqrt(2 + t * t))) < 1e-10
        assert abs(E.t_two_sided_p(t, 1.0) - (1 - 2 / math.pi * math.atan(t))) < 1e-10


def test_ttest_zero_spread(spark):
    a = spark.createDataFrame([("b", 1, 0.5), ("b", 2, 0.6)], "benchmark string, seed int, accuracy double")
    b = spark.createDataFrame([("b", 1, 0.4), ("b", 2, 0.5)], "benchmark string, seed int, accuracy double")
    r = E.paired_ttest(a, b).first()
    assert r.t_stat == float("inf") and r.p_value == 0.0


def test_expand_seeds_rules():
    assert E.expand_seeds(explicit=[3, 1, 3, 2]) == [3, 1, 2]
    assert E.expand_seeds(base=42, n=3, step=2) == [42, 44, 46]
    with pytest.raises(ValueError):
        E.expand_seeds(explicit=[1, 1])


def test_fit_token_budget_head_tail(spark):
    df = spark.createDataFrame([(["q"] * 5, [str(i) for i in range(20)], ["b"] * 3)],
                               "q_tokens array<string>, a_tokens array<string>, b_tokens array<string>")
    r = J.fit_token_budget(df, limit=15, overhead=2).first()
    # budget = (15 - 2 - 5) // 2 = 4 -> head 2 + tail 2
    assert r.a_fit == ["0", "1", "18", "19"] and r.b_fit == ["b"] * 3 and r.truncated


def test_encode_pair_left_cut(spark):
    df = spark.createDataFrame([("p1 p2 p3 p4", "o1 o2")], "prompt string, output string")
    r = T.encode_pair(df, "prompt", "output", max_len=4).first()
    assert len(r.input_ids) == 4 and r.labels[:1] == [-100] and r.input_ids[-1] == T.EOS_ID
    assert r.target_len == 3 and r.prompt_overflow


def test_merge_shards_reports_holes(spark):
    sh = spark.createDataFrame([(i, i % 2, 2) for i in range(10) if i != 5], "idx long, rank int, world_size int")
    rep = T.merge_shards(sh, expected=10)[1].first()
    assert rep.missing_indices == 1 and rep.world_sizes == 1 and rep.missing_ranks == 0


def test_interpolate_schedule(spark):
    pts = [(0.0, 0.0), (0.5, 1.0), (0.5, 2.0), (1.0, 3.0)]
    df = spark.createDataFrame([(-1.0,), (0.25,), (0.5,), (0.75,), (2.0,)], "p double")
    got = [r.v for r in df.select(G.interpolate_schedule("p", pts).alias("v")).collect()]
    assert got == [0.0, 0.5, 1.0, 2.5, 3.0]


def test_sliding_throughput(spark):
    """Equal to counting each window's rows anew; one slide is the tumbling form."""
    rows = [("a", 1_700_000_000 + s, v) for s, v in [(0, 1.0), (1, 2.0), (59, 4.0), (60, 8.0), (119, None), (400, 16.0), (400, 16.0)]]
    rows += [(None, 1_700_000_030, 1.0), ("a", None, 5.0), ("b", 1_700_000_000, None)]
    df = spark.createDataFrame(rows, "run string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = G.sliding_throughput(df, slide="1 minute", panes=3).collect()
    want = []
    for run in ("a", "b", None):
        times = [(s, v) for r, s, v in rows if r == run and s is not None]
        for at in sorted({s // 60 * 60 - 60 * k for s, _ in times for k in range(3)}):
            held = [(s, v) for s, v in times if at <= s < at + 180]
            dt = max(max(s for s, _ in held) - min(s for s, _ in held), 1e-8)
            known = [v for _, v in held if v is not None]
            total = sum(known) if known else None
            want.append((run, at, len(held), total, len(held) / dt, None if total is None else total / dt))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    one = G.sliding_throughput(df.filter("s is not null"), slide="1 minute", panes=1)
    assert sorted(map(str, one.collect())) == sorted(map(str, G.throughput(df, window="1 minute").collect()))
    assert G.sliding_throughput(df.limit(0)).count() == 0


def test_schedule_values(spark):
    """Schedules in a table equal the same points given as literals."""
    import random
    rng = random.Random(4)
    marks = [-0.5, 0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 1.0, 1.5]
    plans = {1: [(rng.choice(marks), rng.uniform(-3, 3)) for _ in range(12)], 2: [(0.5, 7.0)],
             3: [(0.0, 0.0), (0.5, 1.0), (0.5, 2.0), (1.0, 3.0)], 4: [(0.2, 1.0), (0.2, 5.0)]}
    points = [(k, x, v, i, "y") for k, plan in plans.items() for i, (x, v) in enumerate(plan)]
    points += [(3, None, 9.0, 50, "y"), (3, 0.7, None, 51, "y"), (None, 0.5, 1.0, 52, "y")]
    points = spark.createDataFrame(points, "run long, position double, value double, point int, scale string")
    at = [None, -1.0, 0.0, 0.2, 0.25, 0.5, 0.500001, 0.75, 0.9, 1.0, 2.0, float("nan"), *[rng.random() for _ in range(30)]]
    rows = [(k, p, "x") for k in (1, 2, 3, 4, 5, None) for p in at] + [(1, 0.3, "x")] * 500     # a hot, repeated row
    rows = spark.createDataFrame(rows, "run long, p double, value string")
    got = G.schedule_values(rows, points, "p")
    assert got.columns == ["run", "p", "value", "scheduled"]
    want = rows.filter("run is null or run = 5").withColumn("scheduled", F.lit(None).cast("double"))
    for k, plan in plans.items():
        want = want.unionByName(rows.filter(F.col("run") == k).withColumn("scheduled", G.interpolate_schedule("p", plan)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert G.schedule_values(rows.limit(0), points, "p").count() == 0
    assert {r.scheduled for r in G.schedule_values(rows, points.limit(0), "p").collect()} == {None}
    with pytest.raises(ValueError, match="clash"):
        G.schedule_values(rows, points, "p", name="value")


def test_dense_index_with_outliers_and_hot_group(spark):
    # one group holds most rows, one extreme value
    vals = [(0 if i % 3 else 1, float(i) if i != 5 else 1e12) for i in range(4000)]
    df = spark.createDataFrame(vals, "g int, o double")
    a = dense_index(df, ["g"], ["o"], "rn")
    got = sorted((r.g, r.o, r.rn) for r in a.collect())
    want = []
    for g in (0, 1):
        rows = sorted(o for gg, o in vals if gg == g)
        want += [(g, o, i) for i, o in enumerate(rows)]
    assert got == sorted(want)
    # the hot group is spread: no stored partition holds much more than its share
    from glob import glob

    from prefeval.session import ensure_checkpoint_dir
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dense_index(df, ["g"], ["o"], "rn")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    folder = max(glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/prefeval-ranked-*"), key=os.path.getmtime)
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2.5 * 4000 / 8


def test_dense_index_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, o int")
    assert sorted((str(r.g), r.o, r.rn) for r in dense_index(df, ["g"], ["o"]).collect()) == [
        ("None", 1, 0), ("None", 3, 1), ("a", 2, 0)]


BLANK = "\u00a0\u3000\x1c"


def test_unicode_white_space(spark):
    one = lambda **k: spark.createDataFrame([tuple(k.values())], ", ".join(f"{n} string" for n in k))
    assert one(x=BLANK).select(P.is_missing("x").alias("m")).first().m                              # P1
    assert one(x=f"{BLANK}none{BLANK}").select(P.is_missing("x").alias("m")).first().m
    text = "".join(h + f"{BLANK}v{i}{BLANK}" for i, h in enumerate(P.SECTION_HEADERS))
    assert tuple(one(x=text).select(P.extract_sections("x").alias("s")).first().s) == ("v1", "v2", "v3")   # P4
    kept, counts = P.filter_empty(one(response_A=BLANK, response_B="b"))                            # P11
    assert kept.count() == 0 and counts.first().dropped_empty_a == 1
    sp = P.with_span(one(p=f"a{BLANK}b c", r=f"{BLANK}b\u00a0c"), "sp", "p", "r").first().sp         # P13
    assert (sp.start, sp.end) == (4, 7)
    assert one(a=f"x{BLANK}y", b="x y").select(P.contains_either("a", "b").alias("c")).first().c    # P15
    assert one(x=f"a{BLANK}b a").select(M.length_ttr("x").alias("m")).first().m["length"] == 3      # M1
    assert T.encode(one(x=BLANK), "x", 5).first().ids_mask == 0                                     # T1
    lab = M.proxy_labels(one(row_id="1", response_A=BLANK, response_B="b")).orderBy("side").collect()   # M8
    assert [r.present for r in lab] == [0, 1]
    r = spark.createDataFrame([("1", BLANK, None, None)], "row_id string, response_A string, proxy_length_A double, proxy_ttr_A double")
    assert M.backfill_proxy(r).first().computed is False                                            # M3
    t = J.render_user(one(prompt=f"{BLANK}q", answer_a="a", answer_b="b"))
    assert P.parse_user_content(t, "content").first().question == "q"                               # P7


def test_coercion_and_missing_proxy(spark):
    df = spark.createDataFrame([(True, "x")], "proxy_nll_A boolean, judge_instruction string")
    assert P.coerce_example(df).first().proxy_nll_A == 1.0
    rows = [(None, "nan"), (None, "\u3000"), (float("nan"), None), (1.0, None)]
    df = spark.createDataFrame(rows, "nll double, ppl string")
    got = [r.m for r in df.select(P.flag_missing_proxy("nll", "ppl", F.lit(None).cast("double"),
                                                       F.lit(None).cast("string"), F.lit("")).alias("m")).collect()]
    assert got == [False, True, True, False]


def test_missing_groups_from_raw(spark):
    cols = "id int, benchmark string, language string, verdict string, expected_verdict string"
    raw = spark.createDataFrame([(1, "b", "en", "A", "A"), (2, "b", "fr", "A", None), (3, "b", "fr", "B", "B")], cols)
    got = E.missing_groups(raw, None, raw)
    assert [(r.benchmark, r.language) for r in got.collect()] == [("b", "fr")]


def test_map_text_null_is_the_same_with_and_without_dedupe(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "x")], "k int, text string")
    fn = lambda pdf: pdf["text"].map(lambda t: "null" if t is None else f"<{t}>")
    a, b = (sorted((r.k, r.output) for r in L.map_text(df, fn, ["text"], ["k"], dedupe=d).collect()) for d in (True, False))
    assert a == b == [(1, "null"), (2, "<>"), (3, "<x>"), (4, "<x>")]


def test_back_translation_needs_a_language(spark):
    df = spark.createDataFrame([(1, "A", "t", "fr"), (2, "A", "t", "")], "row_id int, side string, text_eng string, lang string")
    fn = lambda pdf: pdf["lang"] + ":" + pdf["text_eng"]
    with pytest.raises(Exception, match="no language"):
        L.back_translate(df, fn).collect()
    assert [r.text_bt for r in L.back_translate(df, fn, on_missing="null").orderBy("row_id").collect()] == ["fr:t", None]


def test_length_policy_truncated_and_lost_batch(spark):
    rows = [(1, 0, [5], [5], False, 9, True, [1]), (2, 0, [6], [6], False, 9, True, [1]), (3, 1, [7], [7], False, 9, False, [2])]
    df = spark.createDataFrame(rows, "row_id int, batch_id int, input_ids array<int>, labels array<int>, prompt_overflow boolean, "
                                     "target_len int, truncated boolean, response_types array<int>")
    kept, counts = T.apply_length_policy(df, "drop", 0, 8)
    assert sorted((r.row_id, r.labels, r.response_types) for r in kept.collect()) == [(1, [-100], [0]), (3, [7], [2])]
    assert counts.first().drop_maxlen == 2
    masked = {r.row_id: (r.labels, r.response_types) for r in T.apply_length_policy(df, "mask", 0, 8)[0].collect()}
    assert masked == {1: ([-100], [0]), 2: ([-100], [0]), 3: ([7], [2])}


def test_find_subseq(spark):
    df = spark.createDataFrame([([1, 12, 2, 12, 3], [12, 3]), ([1, 2], [2, 1]), ([11, 1], [1]), ([1], [])],
                               "h array<int>, n array<int>")
    got = [r.s and tuple(r.s) for r in df.select(T.find_subseq("h", "n").alias("s")).collect()]
    assert got == [(3, 5), None, (1, 2), None]


def test_batches_by_position(spark):
    df = spark.createDataFrame([(k,) for k in (5, 900, 7, 40)], "row_id int")
    assert sorted((r.row_id, r.batch) for r in R.assign_batches(df, 2).collect()) == [(5, 0), (7, 0), (40, 1), (900, 1)]


def test_preview_span(spark):
    df = spark.createDataFrame([("0123456789\nabc", 5, 6), ("xyz", -1, -1)], "t string, a int, z int")
    got = [r.p for r in df.select(P.preview_span("t", "a", "z", 3).alias("p")).collect()]
    assert got == ["234567", "xyz"]


def test_template_with_a_lone_brace(spark):
    df = spark.createDataFrame([(None, "A")], "prompt string, answer_a string")
    t = J._compile("{ {prompt} {answer_a} {other} }", {"prompt": F.col("prompt"), "answer_a": F.col("answer_a")})
    assert df.select(t.alias("t")).first().t == "{ None A {other} }"


def test_quantile_edges_with_hot_value(spark):
    import math as _m
    values = [7.0] * 1500 + [float(i) for i in range(3000)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.edge for r in M.quantile_edges(df, "x", 10).orderBy("edge_idx").collect()]
    clean = sorted(v for v in values if v is not None and not _m.isnan(v))
    n = len(clean)
    want = [clean[0]] + [clean[min(max(int(_m.ceil(i / 10.0 * n)) - 1, 0), n - 1)] for i in range(1, 10)] + [clean[-1]]
    assert got == want


def test_user_content_with_control_characters(spark):
    base = J.render_user(spark.createDataFrame([("q", "a1", "b1"), ("q\x00odd", "a\x01", "b")],
                                               "prompt string, answer_a string, answer_b string"))
    rows = P.parse_user_content(base, "content").orderBy("prompt").collect()
    assert [(r.question, r.answer_a, r.answer_b) for r in rows] == [("q", "a1", "b1"), ("q\x00odd", "a\x01", "b")]


def test_poisson_draw_moments(spark):
    for mean in (0.0, 0.7, 12.0, 29.9, 45.0, 4000.0):
        u = (F.col("id") + 0.5) / 20000.0
        r = spark.range(20000).select(E.poisson_draw(F.lit(mean), u).alias("n")).agg(F.avg("n").alias("m"), F.var_pop("n").alias("v")).first()
        assert abs(r.m - mean) <= 0.01 * mean + 1e-9 and abs(r.v - mean) <= 0.05 * mean + 1e-9


@pytest.mark.parametrize("mode", ["restart", "skip"])
def test_fold_in_runs_equals_single_steps(mode):
    rng = np.random.default_rng(1)
    for gaps in (0.0, 0.02, 0.3):
        v = rng.normal(5, 2, 700)
        v[rng.random(700) < gaps] = rng.choice([np.nan, np.inf])
        state, want = None, []
        for x in v.tolist():
            state = G._step(state, None if mode == "skip" and math.isnan(x) else x, 0.9, mode)
            want.append(state)
        clean = lambda xs: [math.nan if x is None else x for x in xs]
        assert np.allclose(clean(G._fold(v, None, 0.9, mode)), clean(want), rtol=1e-11, equal_nan=True)
        for start in (None, 3.0):
            end = G._fold(v, start, 0.9, mode)[-1]
            got = G._apply(G._summary(v, 0.9, mode), start, mode)
            assert np.allclose(clean([got]), clean([end]), rtol=1e-11, equal_nan=True)
