"""Cleaning, predicates and parsing of text columns (P ops).

Everything is a Column expression or a DataFrame projection, so it stays
inside whole-stage codegen and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefeval.functions.text import WS, WS_CHARS, c, no_space, py_strip, squeeze, strip_chars, words
from prefeval.operators.tasks import A_END, A_START, B_END, B_START, USER_QUESTION_MARK

# ---------------------------------------------------------------------------
# Section headers of the judge prompt format and the phrases
# the cleaners remove. The parsers must see exactly these strings.
REFERENCE_HEADER = "\n###Reference Answer:"
SECTION_HEADERS = [
    "###Task Description:",
    "###The instruction to evaluate:",
    "###Response A to evaluate:",
    "###Response B to evaluate:",
    "###Evaluation Criteria:",
    "###Feedback:",
]
SECTION_MARK = "\n###"
REFERENCE_PHRASE = "a reference answer, "
CRITERIA_HEADER = "###Evaluation Criteria:\n"
REQUEST_SUFFIX = "_judgment_requests.jsonl"
NULL_WORDS = ["none", "null"]
# ---------------------------------------------------------------------------

_CRITERIA_BLOCK = r"(?s)###Evaluation Criteria:\n.*?\n\n"
_CUSTOM_ID = r"^(.+)[-_](\d+)[-_]gold([AB])$"


def lit_pattern(text: str) -> str:
    """A pattern for exactly this text."""
    return "\\Q" + text + "\\E"


# --------------------------------------------------------------------------- P1
def is_missing(col, strict: bool = True) -> Column:
    """null, NaN, blank; strict also ' none ' / 'NULL' (trimmed, any case)."""
    x = c(col)
    s = py_strip(x.cast("string"))
    miss = x.isNull() | (s == "")
    if strict:
        miss = miss | F.lower(s).isin(*NULL_WORDS)
    return F.coalesce(miss, F.lit(True))


def is_missing_number(col) -> Column:
    return c(col).isNull() | F.isnan(c(col))


# --------------------------------------------------------------------------- P2
def sample_uncriteria(df: DataFrame, n: int, seed: int, key: str = "id",
                      criteria: str = "orig_criteria") -> DataFrame:
    """Rows whose criteria is missing, in a seeded hash order, first n.

    ``orderBy(...).limit(n)`` plans as a top-n per task then one merge of
    n rows per task (TakeOrderedAndProject): no global sort. Fewer rows than
    n is not an error."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.filter(is_missing(criteria, strict=True)).orderBy(order).limit(n)


# --------------------------------------------------------------------------- P3 / P4 / P5 / P6
def strip_reference_block(col) -> Column:
    """Drop each ``\\n###Reference Answer:`` block up to the next ``\\n###`` or the end.

    The text is cut at the header; of every piece after a header only what
    follows from the next section mark on is kept. White space right after a
    header belongs to the block, even a line break before a section mark."""
    pieces = F.split(c(col), lit_pattern(REFERENCE_HEADER))

    def kept(piece):
        body = F.regexp_replace(piece, f"^{WS}+", "")
        mark = F.instr(body, SECTION_MARK)
        return F.when(mark > 0, F.substring(body, mark, F.length(body))).otherwise(F.lit(""))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), kept)
    return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))


def extract_sections(col) -> Column:
    """(instruction, response_A, response_B) stripped, or null when a header
    is absent.

    The six headers are found in order with ``locate`` (plain substring
    search, each from the end of the previous header), which is what the
    lazy section pattern matches, without running a backtracking regex four
    times over a long prompt."""
    x = c(col)
    pos = []
    prev_end = F.lit(1)
    for h in SECTION_HEADERS:
        p = F.call_function("locate", F.lit(h), x, prev_end)
        pos.append(p)
        prev_end = p + F.lit(len(h))
    ok = x.isNotNull() & (F.length(x) > 0)
    for p in pos:
        ok = ok & (p > 0)

    def body(i):
        start = pos[i] + F.lit(len(SECTION_HEADERS[i]))
        return py_strip(F.substring(x, start, pos[i + 1] - start))

    return F.when(ok, F.struct(body(1).alias("instruction"), body(2).alias("response_A"),
                               body(3).alias("response_B")))


def prepare_preferences(df: DataFrame) -> DataFrame:
    """P3 then P4; without a match fall back to the ``orig_*`` fields; the
    cleaned prompt is kept as ``judge_prompt``; null output -> ''."""
    cleaned = strip_reference_block(F.coalesce(F.col("instruction"), F.lit("")))
    x = df.withColumn("judge_prompt", cleaned).withColumn("_sec", extract_sections("judge_prompt"))

    def orig(name):
        return py_strip(F.coalesce(F.col(name), F.lit("")))

    return (x.withColumn("instruction", F.coalesce(F.col("_sec.instruction"), orig("orig_instruction")))
             .withColumn("response_A", F.coalesce(F.col("_sec.response_A"), orig("orig_response_A")))
             .withColumn("response_B", F.coalesce(F.col("_sec.response_B"), orig("orig_response_B")))
             .withColumn("output", F.coalesce(F.col("output"), F.lit("")))
             .drop("_sec"))


def clean_judge_prompt(col) -> Column:
    """Remove ``a reference answer, `` everywhere, then each criteria section
    up to its first blank line."""
    return F.regexp_replace(F.replace(c(col), F.lit(REFERENCE_PHRASE), F.lit("")), _CRITERIA_BLOCK, "")


# --------------------------------------------------------------------------- P7
def parse_user_content(df: DataFrame, col: str = "content", on_error: str = "raise") -> DataFrame:
    """question / answer_a / answer_b between the bracket markers (CRLF -> LF,
    blank ends stripped). A text without the markers in their order, or with
    something after the last one, fails the job; with ``on_error='null'`` it
    leaves nulls (quarantine by filtering them).

    The markers are looked up one after the other, each from the end of the
    one before: the question's, the start of A, the end of A with the start of
    B right behind it, and the end of B as the last thing in the text."""
    x = df.withColumn("_t", F.regexp_replace(F.replace(c(col), F.lit("\r\n"), F.lit("\n")), f"{WS}+$", ""))
    t, n = F.col("_t"), F.length("_t")
    x = x.withColumn("_q", F.instr(t, USER_QUESTION_MARK))
    x = x.withColumn("_a", F.when(F.col("_q") > 0, _locate(F.lit(A_START), t, F.col("_q") + len(USER_QUESTION_MARK))))
    x = x.withColumn("_rest", F.when(F.col("_a") > 0, F.substring(t, F.col("_a") + len(A_START), n)))
    turn = lit_pattern(A_END) + WS + "*" + lit_pattern(B_START)
    x = x.withColumn("_cut", F.regexp_extract("_rest", turn, 0))
    x = x.withColumn("_at", F.when(F.col("_cut") != "", F.instr(F.col("_rest"), F.col("_cut"))))
    x = x.withColumn("_b", F.substring("_rest", F.col("_at") + F.length("_cut"), n))
    ok = F.coalesce(F.col("_b").endswith(F.lit(B_END)), F.lit(False))
    if on_error == "raise":
        ok = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("request content lacks the answer markers")))
    x = x.withColumn("_ok", ok)

    def part(text):
        return F.when(F.col("_ok"), strip_chars(py_strip(text), "\n"))

    begin = F.col("_q") + len(USER_QUESTION_MARK)
    return (x.withColumn("question", part(F.substring(t, begin, F.col("_a") - begin)))
             .withColumn("answer_a", part(F.substring("_rest", F.lit(1), F.col("_at") - 1)))
             .withColumn("answer_b", part(F.substring("_b", F.lit(1), F.length("_b") - len(B_END))))
             .drop("_t", "_q", "_a", "_rest", "_cut", "_at", "_b", "_ok"))


# --------------------------------------------------------------------------- P8 / P9
def parse_request_filename(col) -> Column:
    """(group, lang) of ``<group>_<lang>_judgment_requests.jsonl``; ``X_resource_L``
    makes the group two parts; one part -> (null, core); other names -> nulls."""
    name = F.regexp_extract(c(col), r"([^/]*)$", 1)
    ok = name.endswith(F.lit(REQUEST_SUFFIX))
    core = F.substring(name, F.lit(1), F.length(name) - F.lit(len(REQUEST_SUFFIX)))
    parts = F.split(core, "_")
    n = F.size(parts)

    def join_from(start):
        return F.array_join(F.slice(parts, start, F.greatest(n - start + 1, F.lit(0))), "_")

    two = (n >= 3) & (F.element_at(parts, 2) == "resource")
    group = (F.when(~ok, F.lit(None).cast("string"))
              .when(two, F.concat(F.element_at(parts, 1), F.lit("_"), F.element_at(parts, 2)))
              .when(n >= 2, F.element_at(parts, 1)))
    lang = (F.when(~ok, F.lit(None).cast("string"))
             .when(two, F.nullif(join_from(3), F.lit("")))
             .when(n >= 2, F.nullif(join_from(2), F.lit("")))
             .otherwise(F.nullif(core, F.lit(""))))
    return F.struct(group.alias("fallback_group"), lang.alias("fallback_lang"))


def parse_custom_id(col, fallback_group=None, fallback_lang=None, on_error: str = "raise") -> Column:
    """``prefix[-_]idx[-_]gold[AB]`` -> struct(group, language, idx, gold, pair_id).

    group: the fallback group when the prefix starts with it plus - or _;
    else the part before the first '-'; a prefix with only '_' (or none)
    keeps the fallback group or 'unknown' and is the language itself;
    an empty language takes the fallback language or 'unknown'."""
    x = c(col).cast("string")
    fg = c(fallback_group) if fallback_group is not None else F.lit(None).cast("string")
    fl = c(fallback_lang) if fallback_lang is not None else F.lit(None).cast("string")
    ok = x.rlike(_CUSTOM_ID)
    if on_error == "raise":
        ok = F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("not of the form prefix-index-goldA or -goldB: "), x)))
    prefix = F.regexp_extract(x, _CUSTOM_ID, 1)
    idx = F.regexp_extract(x, _CUSTOM_ID, 2)
    gold = F.regexp_extract(x, _CUSTOM_ID, 3)
    has_fg = fg.isNotNull() & (F.length(fg) > 0)
    starts = has_fg & (prefix.startswith(F.concat(fg, F.lit("-"))) | prefix.startswith(F.concat(fg, F.lit("_"))))
    after_fg = F.substring(prefix, F.length(fg) + 2, F.length(prefix))
    dash = F.instr(prefix, "-")
    fg_or_unknown = F.when(has_fg, fg).otherwise(F.lit("unknown"))
    group = (F.when(starts, fg)
              .when(dash > 0, F.substring(prefix, F.lit(1), dash - 1))
              .otherwise(fg_or_unknown))
    lang0 = (F.when(starts, after_fg)
              .when(dash > 0, F.substring(prefix, dash + 1, F.length(prefix)))
              .otherwise(prefix))
    lang = F.when(F.length(lang0) > 0, lang0).otherwise(
        F.when(fl.isNotNull() & (F.length(fl) > 0), fl).otherwise(F.lit("unknown")))
    return F.when(ok, F.struct(group.alias("group"), lang.alias("language"), idx.alias("idx"),
                               gold.alias("gold"),
                               F.concat_ws("-", group, lang, idx).alias("pair_id")))


# --------------------------------------------------------------------------- P10
def coerce_optional_text(col) -> Column:
    return F.nullif(c(col).cast("string"), F.lit(""))


def coerce_optional_float(col, dtype: str = "string") -> Column:
    """Number or null (unparsable text, e.g. 'abc', becomes null; a boolean
    column gives 1.0 / 0.0)."""
    if dtype == "boolean":
        return c(col).cast("int").cast("double")
    return c(col).cast("string").try_cast("double")


def coerce_nll(nll, ppl, nll_type: str = "string", ppl_type: str = "string") -> Column:
    """nll as number, else ln(ppl) when ppl > 0, else null."""
    n = coerce_optional_float(nll, nll_type)
    p = coerce_optional_float(ppl, ppl_type)
    return F.coalesce(n, F.when(p > 0, F.log(p)))


def coerce_example(df: DataFrame) -> DataFrame:
    """Key aliases (judge_prompt|judge_instruction, instruction|prompt), empty
    text -> null, numbers coerced (bad -> null), nll from ppl when missing."""
    cols = dict(df.dtypes)

    def pick(*names):
        present = [F.col(n) for n in names if n in cols]
        return present[0] if len(present) == 1 else (F.coalesce(*present) if present else F.lit(None).cast("string"))

    out = df
    out = out.withColumn("judge_prompt", coerce_optional_text(
        F.col("judge_prompt") if "judge_prompt" in cols else pick("judge_instruction")))
    out = out.withColumn("instruction", coerce_optional_text(
        F.col("instruction") if "instruction" in cols else pick("prompt")))
    for side in ("A", "B"):
        nll = F.col(f"proxy_nll_{side}") if f"proxy_nll_{side}" in cols else F.lit(None).cast("string")
        ppl = F.col(f"proxy_ppl_{side}") if f"proxy_ppl_{side}" in cols else F.lit(None).cast("string")
        out = out.withColumn(f"proxy_nll_{side}", coerce_nll(nll, ppl, cols.get(f"proxy_nll_{side}", "string"),
                                                              cols.get(f"proxy_ppl_{side}", "string")))
        for m in ("length", "ttr"):
            name = f"proxy_{m}_{side}"
            if name in cols:
                out = out.withColumn(name, coerce_optional_float(name, cols[name]))
    return out


# --------------------------------------------------------------------------- P11 / P12
def filter_empty(df: DataFrame, require_both: bool = True, a: str = "response_A",
                 b: str = "response_B") -> tuple[DataFrame, DataFrame]:
    """Drop rows with blank A; with ``require_both`` and a B column, drop
    blank B too. Returns (kept rows, one-row counts). A is tested first, so
    a row blank on both sides counts as empty A."""
    blank_a = ~(F.coalesce(py_strip(c(a)), F.lit("")) != "")
    has_b = require_both and b in df.columns
    blank_b = ~(F.coalesce(py_strip(c(b)), F.lit("")) != "") if has_b else F.lit(False)
    reason = F.when(blank_a, F.lit("empty_a")).when(blank_b, F.lit("empty_b"))
    x = df.withColumn("_drop", reason)
    kept = x.filter(F.col("_drop").isNull()).drop("_drop")
    counts = x.agg(F.count(F.when(F.col("_drop") == "empty_a", 1)).alias("dropped_empty_a"),
                   F.count(F.when(F.col("_drop") == "empty_b", 1)).alias("dropped_empty_b"),
                   F.count(F.lit(1)).alias("total"))
    return kept, counts


def null_value(col, dtype: str = "string") -> Column:
    """null, NaN in a number column, blank text in a text column."""
    x = c(col)
    if dtype in ("double", "float"):
        return x.isNull() | F.isnan(x)
    return F.coalesce(py_strip(x) == "", F.lit(True)) if dtype == "string" else x.isNull()


def flag_missing_proxy(nll_a, ppl_a, nll_b, ppl_b, response_b, nll_type: str = "double",
                       ppl_type: str = "string") -> Column:
    """A lacks both nll and ppl, or B is present (non-blank) and lacks both."""
    miss_a = null_value(nll_a, nll_type) & null_value(ppl_a, ppl_type)
    has_b = F.coalesce(py_strip(coerce_optional_text(response_b)) != "", F.lit(False))
    miss_b = null_value(nll_b, nll_type) & null_value(ppl_b, ppl_type)
    return miss_a | (has_b & miss_b)


# --------------------------------------------------------------------------- P13
def with_span(df: DataFrame, out: str, prompt: str, response: str, start_at=None) -> DataFrame:
    """0-based [start, end) of the stripped response inside the prompt, as
    struct column ``out``: exact search from ``start_at`` (when >= 0), else
    from 0; else a whitespace-insensitive search mapped back to original
    offsets; null when absent.

    The stripped response, both exact searches and (only for rows that need
    it) the whitespace-free texts and the index map are intermediate columns,
    so each is computed once per row instead of once per reference."""
    p = F.col(prompt)
    x = (df.withColumn("_sr", py_strip(F.coalesce(F.col(response), F.lit(""))))
           .withColumn("_sa", c(start_at) if start_at is not None else F.lit(-1)))
    sr, sa = F.col("_sr"), F.col("_sa")
    x = (x.withColumn("_p1", F.when(sa >= 0, _locate(sr, p, sa + 1)).otherwise(F.lit(0)))
          .withColumn("_p2", F.instr(p, sr)))
    need = (F.length(sr) > 0) & (F.col("_p1") == 0) & (F.col("_p2") == 0)
    mapping = F.filter(F.transform(F.split(p, ""), lambda ch, i: F.when(ch.isin(*WS_CHARS), F.lit(-1)).otherwise(i)),
                       lambda i: i >= 0)
    x = (x.withColumn("_map", F.when(need, mapping))
          .withColumn("_cp", F.when(need, no_space(p)))
          .withColumn("_cr", F.when(need, no_space(sr))))
    mp = F.col("_map")
    first_at = F.array_position(F.zip_with(mp, F.array_repeat(sa, F.size(mp)), lambda m, s_: m >= s_), True)
    cstart = F.when((sa >= 0) & (first_at > 0), first_at - 1).otherwise(F.lit(0))
    x = x.withColumn("_m", F.when(need, _locate(F.col("_cr"), F.col("_cp"), cstart + 1)))
    m, cr = F.col("_m"), F.col("_cr")
    fb = F.when((F.length(cr) > 0) & (m > 0), F.struct(
        F.element_at(mp, m).alias("start"), (F.element_at(mp, m + F.length(cr) - 1) + 1).alias("end")))
    rl = F.length(sr)
    p1, p2 = F.col("_p1"), F.col("_p2")
    span = (F.when(rl == 0, F.lit(None).cast("struct<start:int,end:int>"))
             .when(p1 > 0, F.struct((p1 - 1).alias("start"), (p1 - 1 + rl).alias("end")))
             .when(p2 > 0, F.struct((p2 - 1).alias("start"), (p2 - 1 + rl).alias("end")))
             .otherwise(fb))
    return x.withColumn(out, span).drop("_sr", "_sa", "_p1", "_p2", "_map", "_cp", "_cr", "_m")


def _locate(substr: Column, s: Column, pos: Column) -> Column:
    """1-based position of substr in s at or after pos (column), 0 if absent."""
    return F.call_function("locate", substr, s, pos)


# --------------------------------------------------------------------------- P14 - P16
def section_between(text, start_marker: str, end_marker: str | None) -> Column:
    """Text between two literal markers, trimmed of space/newline/tab; a
    missing end marker runs to the end; empty -> null."""
    t = c(text)
    s = F.instr(t, start_marker)
    body_start = s + F.lit(len(start_marker))
    rest = F.substring(t, body_start, F.length(t))
    rest = F.regexp_replace(rest, r"^[ \n\r\t]+", "")
    if end_marker:
        e = F.instr(rest, end_marker)
        rest = F.when(e > 0, F.substring(rest, F.lit(1), e - 1)).otherwise(rest)
    rest = F.regexp_replace(rest, r"[ \n\r\t]+$", "")
    return F.when((s > 0) & (F.length(rest) > 0), rest)


def contains_either(a, b) -> Column:
    """After squeezing whitespace, a contains b or b contains a."""
    sa, sb = squeeze(a), squeeze(b)
    return sa.contains(sb) | sb.contains(sa)


def preview(col, n: int = 120) -> Column:
    """Newlines as a literal backslash-n, first n characters; empty -> ''."""
    return F.coalesce(F.substring(F.replace(c(col), F.lit("\n"), F.lit("\\n")), 1, n), F.lit(""))


def preview_span(col, start, end, window: int = 120) -> Column:
    """Preview of the text around [start, end): ``window`` characters on both
    sides, at most twice that in all; a missing (negative or null) place
    gives the first ``window`` characters."""
    t = c(col)
    a, z = F.coalesce(c(start), F.lit(-1)), F.coalesce(c(end), F.lit(-1))
    left = F.greatest(a - window, F.lit(0))
    right = F.least(F.length(t), z + window)
    around = F.substring(t, left + 1, F.greatest(right - left, F.lit(0)))
    return F.when((a < 0) | (z < 0), preview(t, window)).otherwise(preview(around, 2 * window))


# --------------------------------------------------------------------------- P17 / P18
def cap_rows(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """First n rows in dataset order (a top-n, not a sort)."""
    return df.orderBy(order).limit(n)


def token_count(col) -> Column:
    return F.size(words(col))


def prefilter_long(df: DataFrame, max_tokens: int, text: str = "text",
                   order: str = "row_id", k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop rows whose token count is >= max_tokens. Returns (kept, one-row
    stats with dropped / total / ratio, first k dropped rows with previews)."""
    x = df.withColumn("_ntok", token_count(text))
    long = F.col("_ntok") >= max_tokens
    kept = x.filter(~long).drop("_ntok")
    stats = x.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(long, 1)).alias("dropped")) \
             .withColumn("ratio", F.coalesce(F.try_divide(F.col("dropped").cast("double"),
                                                         F.col("total").cast("double")), F.lit(0.0)))
    sample = x.filter(long).orderBy(order).limit(k) \
              .select(order, F.col("_ntok").alias("tokens"), preview(text).alias("preview"))
    return kept, stats, sample


# --------------------------------------------------------------------------- P19
def output_to_text_typed(col, dtype: str) -> Column:
    """null -> ''; array of strings -> concatenation; other arrays -> JSON;
    else the string."""
    x = c(col)
    if dtype == "array<string>":
        return F.coalesce(F.array_join(x, ""), F.lit(""))
    if dtype.startswith("array"):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))
