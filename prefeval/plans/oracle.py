"""DuckDB SQL for the correctness oracle.

Each registered query has an independent SQL twin here. Derived fixtures
are re-built with DuckDB window functions (the plain, single-node way) so
the Spark plans are checked against a different implementation."""

from __future__ import annotations


def H(expr: str) -> str:
    """DuckDB twin of ``keys.h32``: first 8 hex digits of md5 as integer."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def H2(a: str, b: str) -> str:
    return H(f"CAST({a} AS VARCHAR) || '|' || CAST({b} AS VARCHAR)")


SEEDS = "(SELECT unnest([42, 43, 44]) AS seed)"

PAIRS = """
dl AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
good AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i
         FROM dl WHERE quality = 1),
bad AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS j
        FROM dl WHERE quality = 0),
n0 AS (SELECT lang, count(*) AS n0 FROM bad GROUP BY lang),
users AS (SELECT text AS prompt, row_number() OVER (ORDER BY conv_id, turn) - 1 AS u
          FROM conversations WHERE role = 'user'),
pairs AS (
  SELECT g.doc_id AS id, g.lang AS language, g.source AS subset,
         'bench' || CAST(CAST(regexp_extract(g.source, '(\\d+)', 1) AS INTEGER) % 2 AS VARCHAR) AS benchmark,
         us.prompt AS prompt, g.text AS chosen, b.text AS rejected
  FROM good g JOIN n0 ON g.lang = n0.lang
  JOIN bad b ON b.lang = g.lang AND b.j = g.i % n0.n0
  JOIN users us ON us.u = g.i % (SELECT count(*) FROM users)
)"""

SYSTEM_SQL = (
    "'You judge two assistant answers to one user question written in ' || {lang} || '. "
    "Prefer the answer that follows the instructions and answers the question better, "
    "and expect the answers in ' || {lang} || '. Ignore the order of the answers, their "
    "length and the names of the assistants. Explain briefly, then give your verdict "
    "exactly as \"[[A]]\" or \"[[B]]\".'"
)


def user_sql(q: str, a: str, b: str) -> str:
    nl = "chr(10)"
    return (f"'[User Question]' || {nl} || {q} || {nl} || {nl} || "
            f"'[The Start of Assistant A''s Answer]' || {nl} || {a} || {nl} || "
            f"'[The End of Assistant A''s Answer]' || {nl} || {nl} || "
            f"'[The Start of Assistant B''s Answer]' || {nl} || {b} || {nl} || "
            f"'[The End of Assistant B''s Answer]'")


def default_prompt_sql(q: str, a: str, b: str, lang: str) -> str:
    return SYSTEM_SQL.format(lang=lang) + " || chr(10) || chr(10) || " + user_sql(q, a, b)


TASKS = PAIRS + f""",
seeded AS (SELECT p.*, s.seed, ({H2('s.seed', 'p.id')} % 2 = 1) AS swapped
           FROM pairs p CROSS JOIN {SEEDS} s),
tasks AS (
  SELECT id, language, subset, benchmark, prompt, seed, swapped,
         CASE WHEN swapped THEN rejected ELSE chosen END AS answer_a,
         CASE WHEN swapped THEN chosen ELSE rejected END AS answer_b,
         CASE WHEN swapped THEN 'B' ELSE 'A' END AS expected_verdict
  FROM seeded)"""

def stub_judge_sql(src: str = "tasks", out: str = "completions", salt: str = "") -> str:
    key = H(f"'{salt}' || CAST(seed AS VARCHAR) || '|' || CAST(id AS VARCHAR)")
    return f"""
{out}_j AS (
  SELECT t.*,
         CASE WHEN length(answer_a) >= length(answer_b) THEN 'A' ELSE 'B' END AS _better,
         {key} % 10 AS _k
  FROM {src} t),
{out} AS (
  SELECT *,
    CASE WHEN _k = 0 THEN 'Both answers have merits; no decision.'
         WHEN _k = 1 THEN 'Assessment done. final verdict: [[' || lower(_better) || ']]'
         WHEN _k = 2 THEN 'Weighing [[' || CASE WHEN _better = 'A' THEN 'B' ELSE 'A' END
                          || ']] against [[' || _better || ']]: the second wins.'
         ELSE 'Assessment done. Final verdict: [[' || _better || ']]' END AS completion
  FROM {out}_j)"""


STUB_JUDGE_OLD = f"""
judged AS (
  SELECT t.*,
         CASE WHEN length(answer_a) >= length(answer_b) THEN 'A' ELSE 'B' END AS _better,
         {H2('seed', 'id')} % 10 AS _k
  FROM tasks t),
completions AS (
  SELECT *,
    CASE WHEN _k = 0 THEN 'Both answers have merits; no decision.'
         WHEN _k = 1 THEN 'Assessment done. final verdict: [[' || lower(_better) || ']]'
         WHEN _k = 2 THEN 'Weighing [[' || CASE WHEN _better = 'A' THEN 'B' ELSE 'A' END
                          || ']] against [[' || _better || ']]: the second wins.'
         ELSE 'Assessment done. Final verdict: [[' || _better || ']]' END AS completion
  FROM judged)"""


def verdict_sql(text: str, pa: str = "[[A]]", pb: str = "[[B]]") -> str:
    ia = f"instr({text}, '{pa}')" if pa else "0"
    ib = f"instr({text}, '{pb}')" if pb else "0"
    la = f"instr(lower({text}), '{pa.lower()}')" if pa else "0"
    lb = f"instr(lower({text}), '{pb.lower()}')" if pb else "0"
    xa = f"(CASE WHEN {ia} = 0 AND {ib} = 0 THEN {la} ELSE {ia} END)"
    xb = f"(CASE WHEN {ia} = 0 AND {ib} = 0 THEN {lb} ELSE {ib} END)"
    return (f"(CASE WHEN {text} IS NULL THEN NULL WHEN {xa} = 0 AND {xb} = 0 THEN NULL "
            f"WHEN {xa} > 0 AND {xb} > 0 THEN CASE WHEN {xa} < {xb} THEN 'A' ELSE 'B' END "
            f"WHEN {xa} > 0 THEN 'A' ELSE 'B' END)")


STUB_JUDGE = stub_judge_sql()

RECORDS = TASKS + "," + STUB_JUDGE + f""",
parsed AS (SELECT *, {verdict_sql('completion')} AS verdict FROM completions),
records AS (SELECT *, (verdict IS NOT DISTINCT FROM expected_verdict) AS correct FROM parsed)"""


ACCURACY = "WITH " + RECORDS + """
SELECT seed,
       CASE WHEN grouping(benchmark) = 1 THEN '_overall' ELSE benchmark END AS benchmark,
       CASE WHEN grouping(language) = 1 THEN '_overall' ELSE language END AS language,
       count(*)::BIGINT AS total, count_if(correct)::BIGINT AS correct,
       count_if(correct) / count(*) AS accuracy
FROM records
GROUP BY GROUPING SETS ((seed, benchmark, language), (seed, benchmark), (seed))"""


def lit(text: str) -> str:
    """A SQL string literal; newlines as chr(10)."""
    parts = ["'" + x.replace("'", "''") + "'" for x in text.split("\n")]
    return " || chr(10) || ".join(parts)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def records_sql(salt: str, prefix: str) -> str:
    """CTEs ``{prefix}records`` for a stub judge run with the given salt (needs TASKS)."""
    return stub_judge_sql("tasks", f"{prefix}completions", salt) + f""",
{prefix}parsed AS (SELECT *, {verdict_sql('completion')} AS verdict FROM {prefix}completions),
{prefix}records AS (SELECT *, (verdict IS NOT DISTINCT FROM expected_verdict) AS correct FROM {prefix}parsed)"""


def accuracy_sql(src: str, out: str) -> str:
    return f"""{out} AS (
SELECT seed,
       CASE WHEN grouping(benchmark) = 1 THEN '_overall' ELSE benchmark END AS benchmark,
       CASE WHEN grouping(language) = 1 THEN '_overall' ELSE language END AS language,
       count(*)::BIGINT AS total, count_if(correct)::BIGINT AS correct,
       count_if(correct) / count(*) AS accuracy
FROM {src}
GROUP BY GROUPING SETS ((seed, benchmark, language), (seed, benchmark), (seed)))"""


# ---------------------------------------------------------------------------- J ops
J3 = "WITH " + TASKS + """
SELECT id, 'Question (' || language || ' to ' || language || '): ' || prompt || chr(10)
  || '{kept braces} A: ' || answer_a || chr(10) || 'B: ' || answer_b || chr(10)
  || 'Unknown stays: {rubric}' || chr(10) || 'Prompt again: ' || prompt AS text
FROM tasks WHERE seed = 42"""


def _rubric_texts():
    from prefeval.operators.tasks import format_rubric
    from prefeval.plans.queries import RUBRICS
    return [format_rubric(r) for r in RUBRICS]


def sha_mod_sql(text: str, n: int) -> str:
    return (f"list_reduce(list_transform(string_split(sha256({text}), ''), lambda d: ('0x' || d)::BIGINT), "
            f"lambda a, d: (a * 16 + d) % {n}, 0::BIGINT)")


def rubric_sql(idcol: str = "id", seed: str = "'42:' || ") -> str:
    rs = _rubric_texts()
    arr = "[" + ", ".join(lit(r) for r in rs) + "]"
    idx = sha_mod_sql(f"{seed}CAST({idcol} AS VARCHAR)", len(rs))
    return f"CAST({idx} AS INTEGER) AS rubric_index, list_extract({arr}, CAST({idx} AS INTEGER) + 1) AS rubric"


J4 = "WITH " + PAIRS + f"\nSELECT id, {rubric_sql()} FROM pairs"
J4U = "WITH " + PAIRS + f"\nSELECT id, {rubric_sql(seed='')} FROM pairs"


def template_type_sql(category: str, subset: str) -> str:
    from prefeval.plans.queries import TEMPLATE_KEYS
    raw = (f"coalesce(CASE WHEN length({category}) > 0 THEN {category} END, "
           f"CASE WHEN length({subset}) > 0 THEN {subset} END, '')")
    src = f"lower({strip_sql(raw)})"
    whens = [f"WHEN contains({src}, 'chat') THEN 'general'"]
    whens += [f"WHEN {src} = '{k}' THEN '{k}'" for k in TEMPLATE_KEYS]
    whens += [f"WHEN contains({src}, '{k}') THEN '{k}'" for k in TEMPLATE_KEYS
              if k not in ("schema", "tags", "general")]
    return "CASE " + " ".join(whens) + " ELSE 'general' END"


DOC_CATS = """doc_cats AS (
  SELECT doc_id, lang, source AS subset,
         CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Chat ' || lang WHEN 2 THEN lang ELSE '' END AS category
  FROM documents)"""

J5 = "WITH " + DOC_CATS + f"\nSELECT doc_id, {template_type_sql('category', 'subset')} AS template_type FROM doc_cats"


def _j6():
    from prefeval.operators.tasks import ANSWER_A_HEADING, ANSWER_B_HEADING, RUBRIC_DEFAULT_TAGS, format_rubric
    from prefeval.plans.queries import RUBRIC_TEMPLATE
    tpl = RUBRIC_TEMPLATE
    keys = list(tpl.keys())
    tags = dict(RUBRIC_DEFAULT_TAGS)
    tags.update(tpl.get("tags") or {})
    msg = tpl.get("instruction_msg") or tags["instruction_msg"]
    types = [k for k in keys if isinstance(tpl.get(k), dict) and k != "tags"]
    gschema = str(tpl.get("schema", {}))
    src = "lower(" + strip_sql("coalesce(CASE WHEN length(subset) > 0 THEN subset END, '')") + ")"
    whens = [f"WHEN contains({src}, 'chat') THEN 'general'"]
    whens += [f"WHEN {src} = '{k}' THEN '{k}'" for k in keys]
    whens += [f"WHEN contains({src}, '{k}') THEN '{k}'" for k in keys if k not in ("schema", "tags", "general")]
    ttype = "CASE " + " ".join(whens) + " ELSE 'general' END"
    task = "CASE " + " ".join(f"WHEN template_type = '{k}' THEN {lit(str(tpl[k].get('task_description', '')))}"
                              for k in types) + " ELSE '' END"
    schema = "CASE " + " ".join(f"WHEN template_type = '{k}' THEN {lit(str(tpl[k].get('schema') or gschema))}"
                                for k in types) + f" ELSE {lit(gschema)} END"
    rub = []
    for k in types:
        lst = [format_rubric(r) for r in (tpl[k].get("rubric_list") or [])]
        if not lst:
            rub.append(f"WHEN template_type = '{k}' THEN ''")
        else:
            arr = "[" + ", ".join(lit(r) for r in lst) + "]"
            idx = sha_mod_sql("'42:' || CAST(id AS VARCHAR)", len(lst))
            rub.append(f"WHEN template_type = '{k}' THEN list_extract({arr}, CAST({idx} AS INTEGER) + 1)")
    rubric = "CASE " + " ".join(rub) + " ELSE '' END"
    system = (f"{lit('# ' + msg + chr(10))} || {task} || {lit(chr(10) * 2 + '# ' + tags['evaluation_rubric_tag'] + chr(10))}"
              f" || {rubric} || {lit(chr(10) * 2 + '# ' + tags['response_format_tag'] + chr(10) * 2)} || {schema}")
    user = (f"{lit('# ' + tags['input_tag'] + chr(10))} || prompt || {lit(chr(10) * 2 + ANSWER_A_HEADING + chr(10))}"
            f" || answer_a || {lit(chr(10) * 2 + ANSWER_B_HEADING + chr(10))} || answer_b"
            f" || {lit(chr(10) * 2 + '# ' + tags['your_response_tag'] + chr(10))}")
    return "WITH " + TASKS + f""",
typed AS (SELECT *, {ttype} AS template_type FROM tasks WHERE seed = 42)
SELECT id, template_type, {system} || chr(10) || chr(10) || {user} AS judge_prompt FROM typed"""


J6 = _j6()


def keep_sql(arr: str, budget: str) -> str:
    head = f"({budget}) // 2"
    tail = f"(({budget}) - ({budget}) // 2)"
    return (f"(CASE WHEN {budget} <= 0 THEN {arr}[1:0] WHEN len({arr}) <= {budget} THEN {arr} "
            f"WHEN {budget} < 4 THEN {arr}[1:{budget}] "
            f"ELSE list_concat({arr}[1:{head}], {arr}[len({arr}) - {tail} + 1:]) END)")


J7 = "WITH " + PAIRS + f""",
tok AS (SELECT id, {words_sql('prompt')} AS q, {words_sql('chosen')} AS a, {words_sql('rejected')} AS b FROM pairs),
t1 AS (SELECT *, 40 + len(q) + len(a) + len(b) AS len0, (40 + len(q) + len(a) + len(b)) > 600 AS over FROM tok),
t2 AS (SELECT *, CASE WHEN over AND 40 + len(q) > 600 THEN {keep_sql('q', '560')} ELSE q END AS q_fit FROM t1),
t3 AS (SELECT *, CAST(floor(greatest(600 - (40 + len(q_fit)), 0) / 2) AS INTEGER) AS budget FROM t2),
t4 AS (SELECT *, CASE WHEN over THEN {keep_sql('a', 'budget')} ELSE a END AS a_fit,
                 CASE WHEN over THEN {keep_sql('b', 'budget')} ELSE b END AS b_fit FROM t3)
SELECT id, len(q_fit)::INTEGER AS q_n, len(a_fit)::INTEGER AS a_n, len(b_fit)::INTEGER AS b_n,
       least(40 + len(q_fit) + len(a_fit) + len(b_fit), 600)::INTEGER AS prompt_tokens, over AS truncated,
       (40 + len(q_fit) + len(a_fit) + len(b_fit)) > 600 AS cut_whole,
       array_to_string(a_fit, ' ') AS a_text, array_to_string(b_fit, ' ') AS b_text
FROM t4"""

USER_RE = ("(?s)\\[User Question\\]\\s*(.*?)\\s*\\[The Start of Assistant A''s Answer\\]\\s*(.*?)\\s*"
           "\\[The End of Assistant A''s Answer\\]\\s*\\[The Start of Assistant B''s Answer\\]\\s*(.*?)\\s*"
           "\\[The End of Assistant B''s Answer\\]\\s*$")
CID_RE = "^(.+)[-_](\\d+)[-_]gold([AB])$"

REQUESTS = PAIRS + f""",
req0 AS (SELECT p.*, CASE WHEN language = 'en' THEN 'high_resource' ELSE 'low_resource' END AS grp,
         unnest(CASE WHEN id % 2 = 0 THEN ['A', 'B'] WHEN {H('id')} % 2 = 0 THEN ['A'] ELSE ['B'] END) AS gold
         FROM pairs p),
req1 AS (SELECT *, CASE WHEN gold = 'A' THEN chosen ELSE rejected END AS ans_a,
                   CASE WHEN gold = 'A' THEN rejected ELSE chosen END AS ans_b FROM req0),
requests AS (
  SELECT grp || '-' || language || '-' || CAST(id AS VARCHAR) || '-gold' || gold AS custom_id,
         {user_sql('prompt', 'ans_a', 'ans_b')} AS content,
         'set' || substr(benchmark, 6, 1) AS dataset,
         grp || '_' || language || '_judgment_requests.jsonl' AS file_name,
         id * 2 + CASE WHEN gold = 'B' THEN 1 ELSE 0 END AS row_id
  FROM req1)"""


def fallback_sql(fname: str) -> str:
    name = f"regexp_extract({fname}, '([^/]*)$', 1)"
    core = f"substr({name}, 1, length({name}) - 24)"
    parts = f"string_split({core}, '_')"
    ok = f"ends_with({name}, '_judgment_requests.jsonl')"
    two = f"(len({parts}) >= 3 AND {parts}[2] = 'resource')"
    g = (f"CASE WHEN NOT {ok} THEN NULL WHEN {two} THEN {parts}[1] || '_' || {parts}[2] "
         f"WHEN len({parts}) >= 2 THEN {parts}[1] END")
    lng = (f"CASE WHEN NOT {ok} THEN NULL WHEN {two} THEN nullif(array_to_string({parts}[3:], '_'), '') "
           f"WHEN len({parts}) >= 2 THEN nullif(array_to_string({parts}[2:], '_'), '') "
           f"ELSE nullif({core}, '') END")
    return g, lng


def custom_id_sql(cid: str, fg: str, fl: str) -> dict:
    prefix = f"regexp_extract({cid}, '{CID_RE}', 1)"
    idx = f"regexp_extract({cid}, '{CID_RE}', 2)"
    gold = f"regexp_extract({cid}, '{CID_RE}', 3)"
    ok = f"regexp_matches({cid}, '{CID_RE}')"
    has_fg = f"({fg} IS NOT NULL AND length({fg}) > 0)"
    starts = f"({has_fg} AND (starts_with({prefix}, {fg} || '-') OR starts_with({prefix}, {fg} || '_')))"
    dash = f"instr({prefix}, '-')"
    grp = (f"CASE WHEN {starts} THEN {fg} WHEN {dash} > 0 THEN substr({prefix}, 1, {dash} - 1) "
           f"WHEN {has_fg} THEN {fg} ELSE 'unknown' END")
    lang0 = (f"CASE WHEN {starts} THEN substr({prefix}, length({fg}) + 2) "
             f"WHEN {dash} > 0 THEN substr({prefix}, {dash} + 1) ELSE {prefix} END")
    lang = (f"CASE WHEN length({lang0}) > 0 THEN {lang0} WHEN {fl} IS NOT NULL AND length({fl}) > 0 "
            f"THEN {fl} ELSE 'unknown' END")
    return {
        "group": f"CASE WHEN {ok} THEN {grp} END",
        "language": f"CASE WHEN {ok} THEN {lang} END",
        "idx": f"CASE WHEN {ok} THEN {idx} END",
        "gold": f"CASE WHEN {ok} THEN {gold} END",
        "pair_id": f"CASE WHEN {ok} THEN ({grp}) || '-' || ({lang}) || '-' || {idx} END",
    }


_fg, _fl = fallback_sql("file_name")
_cid = custom_id_sql("custom_id", "fallback_group", "fallback_lang")

PREQ = REQUESTS + f""",
preq0 AS (
  SELECT custom_id, row_id, dataset, file_name,
         trim(regexp_extract(replace(content, chr(13) || chr(10), chr(10)), '{USER_RE}', 1), chr(10)) AS question,
         trim(regexp_extract(replace(content, chr(13) || chr(10), chr(10)), '{USER_RE}', 2), chr(10)) AS answer_a,
         trim(regexp_extract(replace(content, chr(13) || chr(10), chr(10)), '{USER_RE}', 3), chr(10)) AS answer_b,
         {_fg} AS fallback_group, {_fl} AS fallback_lang
  FROM requests),
preq AS (
  SELECT custom_id, row_id, dataset, file_name, question, answer_a, answer_b,
         {_cid['group']} AS grp, {_cid['language']} AS sample_language, {_cid['idx']} AS idx,
         {_cid['gold']} AS gold, {_cid['pair_id']} AS pair_id
  FROM preq0),
marked AS (SELECT *, count(DISTINCT gold) OVER (PARTITION BY pair_id) > 1 AS has_pair FROM preq),
swaps0 AS (SELECT *, unnest(CASE WHEN has_pair THEN [0] ELSE [1, 2] END) AS copy FROM marked),
swaps AS (
  SELECT CASE copy WHEN 0 THEN custom_id WHEN 1 THEN custom_id || '-orig' ELSE custom_id || '-swap' END AS id,
         pair_id, grp, sample_language, dataset AS language, 'judgment-requests' AS benchmark, gold,
         CASE WHEN copy = 0 THEN gold = 'B' ELSE copy = 2 END AS swapped,
         CASE WHEN copy = 2 THEN CASE WHEN gold = 'A' THEN 'B' ELSE 'A' END ELSE gold END AS expected_verdict,
         CASE WHEN copy = 2 THEN answer_b ELSE answer_a END AS answer_a,
         CASE WHEN copy = 2 THEN answer_a ELSE answer_b END AS answer_b
  FROM swaps0)"""

J8 = "WITH " + PREQ + "\nSELECT custom_id, pair_id, has_pair FROM marked"
J9 = "WITH " + PREQ + """
SELECT id, pair_id, swapped, expected_verdict, md5(answer_a) AS a_hash, md5(answer_b) AS b_hash FROM swaps"""
J10 = "WITH " + PREQ + """,
firsts AS (SELECT file_name, coalesce(pair_id, custom_id) AS _pair, min(row_id) AS _first FROM preq GROUP BY 1, 2),
top AS (SELECT file_name, _pair FROM (
          SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY _first, _pair) AS r FROM firsts) WHERE r <= 25)
SELECT custom_id, file_name FROM preq p
WHERE EXISTS (SELECT 1 FROM top t WHERE t.file_name = p.file_name AND t._pair = coalesce(p.pair_id, p.custom_id))"""
J11 = """SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 30"""
J1 = "WITH " + TASKS + "\nSELECT id, seed, swapped, expected_verdict FROM tasks"
J2 = "WITH " + TASKS + f"\nSELECT id, seed, {default_prompt_sql('prompt', 'answer_a', 'answer_b', 'language')} AS judge_prompt FROM tasks"
J12 = "WITH " + TASKS + f"""
SELECT id AS request_id, 'task_' || CAST(id AS VARCHAR) AS custom_id,
  CAST(json_object('model', 'judge-model', 'input', json_object(
    'prompt', {default_prompt_sql('prompt', 'answer_a', 'answer_b', 'language')},
    'max_tokens', 512, 'max_new_tokens', 512, 'max_completion_tokens', 512,
    'temperature', 0.0, 'seed', 42)) AS VARCHAR) AS payload
FROM tasks WHERE seed = 42"""

# ---------------------------------------------------------------------------- E ops
E4R = "WITH " + RECORDS + f""",
raw AS (SELECT benchmark, language, CASE WHEN {H2('seed', 'id')} % 97 = 0 THEN NULL ELSE expected_verdict END AS ev
        FROM records WHERE language <> 'de')
SELECT DISTINCT benchmark, language FROM pairs
EXCEPT SELECT DISTINCT benchmark, language FROM records WHERE language = 'de'
EXCEPT SELECT benchmark, language FROM raw GROUP BY ALL HAVING bool_and(ev IS NOT NULL)"""
E1 = "WITH " + RECORDS + "\nSELECT id, seed, completion, verdict FROM records"
E2 = "WITH " + RECORDS + "\nSELECT id, seed, verdict, expected_verdict, correct FROM records"
E3 = "WITH " + RECORDS + f""",
raw AS (SELECT id, seed, benchmark, language, verdict,
               CASE WHEN {H2('seed', 'id')} % 97 = 0 THEN NULL ELSE expected_verdict END AS expected_verdict
        FROM records),
rc AS (SELECT *, CASE WHEN expected_verdict IS NOT NULL
                      THEN verdict IS NOT DISTINCT FROM expected_verdict END AS correct FROM raw),
okg AS (SELECT seed, benchmark, language FROM rc GROUP BY ALL HAVING bool_and(correct IS NOT NULL))
SELECT id, seed, benchmark, language, correct FROM rc
WHERE (seed, benchmark, language) IN (SELECT (seed, benchmark, language) FROM okg)"""
E4 = "WITH " + RECORDS + """
SELECT DISTINCT benchmark, language FROM pairs
EXCEPT SELECT DISTINCT benchmark, language FROM records WHERE language <> 'de'"""


def _horner_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for k in coefficients[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def _e6():
    # Acklam's coefficients, as in the engine
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
    tail = lambda p: f"({_horner_sql(c, f'sqrt(-2.0 * ln({p}))')} / ({_horner_sql(d, f'sqrt(-2.0 * ln({p}))')} * sqrt(-2.0 * ln({p})) + 1.0))"
    r = "((u - 0.5) * (u - 0.5))"
    z = (f"CASE WHEN u < 0.02425 THEN {tail('u')} WHEN u > 0.97575 THEN -{tail('(1.0 - u)')} "
         f"ELSE {_horner_sql(a, r)} * (u - 0.5) / ({_horner_sql(b, r)} * {r} + 1.0) END")
    key = H("'7|' || CAST(rep AS VARCHAR) || '|' || side || '|' || CAST(seed AS VARCHAR) || '|' || benchmark || '|' || language")
    return "WITH " + RECORDS + f""",
n AS (SELECT seed, benchmark, language, count(correct) AS n, count(*) FILTER (WHERE correct) AS k FROM records GROUP BY ALL),
x AS (SELECT seed, benchmark, language, rep, 'right' AS side, k::DOUBLE AS mean FROM n, range(0, 200) t(rep)
      UNION ALL SELECT seed, benchmark, language, rep, 'wrong', (n - k)::DOUBLE FROM n, range(0, 200) t(rep)),
xu AS (SELECT *, ({key} + 0.5) / 4294967296.0 AS u FROM x),
grid AS (SELECT mean, sum(exp(-mean + CASE WHEN j = 0 THEN 0 ELSE j * ln(mean) END - lgamma(j + 1)))
                        OVER (PARTITION BY mean ORDER BY j) AS cdf
         FROM (SELECT DISTINCT mean FROM xu WHERE mean > 0 AND mean <= 30.0), range(0, 120) t(j)),
few AS (SELECT xu.seed, benchmark, language, rep, side, count(*) FILTER (WHERE cdf <= u) AS draw
        FROM xu JOIN grid ON grid.mean = xu.mean GROUP BY ALL),
many AS (SELECT seed, benchmark, language, rep, side,
                CASE WHEN mean = 0 THEN 0 ELSE greatest(floor(mean + z * sqrt(mean) + (z * z - 1) / 6 + 0.5), 0) END AS draw
         FROM (SELECT *, {z} AS z FROM xu) WHERE mean = 0 OR mean > 30.0),
reps AS (SELECT seed, benchmark, language, rep, sum(draw) FILTER (WHERE side = 'right') AS sv, sum(draw) AS sw
         FROM (SELECT * FROM few UNION ALL SELECT * FROM many) GROUP BY ALL),
m AS (SELECT *, coalesce(sv / nullif(sw, 0), 0.0) AS mean FROM reps),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed, benchmark, language ORDER BY mean, rep) - 1 AS r FROM m)
SELECT seed, benchmark, language, max(CASE WHEN r = 5 THEN mean END) AS ci_low,
       max(CASE WHEN r = 194 THEN mean END) AS ci_high
FROM rk GROUP BY ALL"""


E6 = _e6()


def seed_stats_sql(src: str, groups: str, value: str, total: str | None) -> str:
    ft = f", arg_min({total}, seed) AS first_total" if total else ""
    return f"""SELECT {groups}, avg({value}) AS mean, coalesce(stddev_samp({value}), 0.0) AS std,
       count(*) AS n_seeds,
       array_to_string(list_transform(list({value} ORDER BY seed), lambda v: printf('%.6f', v)), ',') AS "values"
       {ft}, printf('%.4f ± %.4f', avg({value}), coalesce(stddev_samp({value}), 0.0)) AS formatted
FROM {src} GROUP BY {groups}"""


E7 = "WITH " + RECORDS + ", " + accuracy_sql("records", "acc") + "\n" + \
    seed_stats_sql("acc", "benchmark, language", "accuracy", "total")


def ttest_sql(a: str, b: str, keys: str, alpha: float = 0.05) -> str:
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"x.{k.strip()} AS {k.strip()}" for k in keys.split(","))
    return f"""j AS (SELECT {sel}, x.seed, x.accuracy - y.accuracy AS d FROM {a} x JOIN {b} y
              ON {on} AND x.seed = y.seed
              WHERE x.accuracy IS NOT NULL AND y.accuracy IS NOT NULL AND NOT isnan(x.accuracy) AND NOT isnan(y.accuracy)),
g AS (SELECT {keys}, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM j GROUP BY {keys}),
t AS (SELECT *, CASE WHEN n < 2 THEN 'NaN'::DOUBLE
                     WHEN sd = 0 THEN CASE WHEN mean_diff <> 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END
                     ELSE mean_diff / (sd / sqrt(n)) END AS t_stat FROM g)
SELECT {keys}, n, mean_diff, t_stat,
  CASE WHEN n < 2 THEN 'NaN'::DOUBLE
       WHEN sd = 0 THEN CASE WHEN mean_diff <> 0 THEN 0.0 ELSE 1.0 END
       WHEN n - 1 = 1 THEN 1 - 2 / pi() * atan(abs(t_stat))
       WHEN n - 1 = 2 THEN 1 - abs(t_stat) / sqrt(2 + t_stat * t_stat)
       END AS p_value,
  (CASE WHEN n < 2 THEN 'NaN'::DOUBLE
       WHEN sd = 0 THEN CASE WHEN mean_diff <> 0 THEN 0.0 ELSE 1.0 END
       WHEN n - 1 = 1 THEN 1 - 2 / pi() * atan(abs(t_stat))
       WHEN n - 1 = 2 THEN 1 - abs(t_stat) / sqrt(2 + t_stat * t_stat)
       END) < {alpha} AS significant
FROM t"""


RUNS = TASKS + ",\n" + records_sql("", "a_") + ",\n" + records_sql("b", "b_") + ",\n" + \
    accuracy_sql("a_records", "acc_a") + ",\n" + accuracy_sql("b_records", "acc_b")
E8 = "WITH " + RUNS + ",\n" + ttest_sql("acc_a", "acc_b", "benchmark, language")
E13 = "WITH " + RUNS + """,
oa AS (SELECT * FROM acc_a WHERE language = '_overall'),
ob AS (SELECT * FROM acc_b WHERE language = '_overall'),
""" + ttest_sql("oa", "ob", "benchmark")

BIAS = PREQ + f""",
bseeded AS (SELECT s.*, sd.seed FROM swaps s CROSS JOIN {SEEDS} sd),
""" + stub_judge_sql("bseeded", "bcompletions") + f""",
brecords AS (SELECT *, {verdict_sql('completion')} AS verdict,
                    ({verdict_sql('completion')} IS NOT DISTINCT FROM expected_verdict) AS correct
             FROM bcompletions),
b0 AS (SELECT seed, coalesce(pair_id, id) AS pair, verdict IS NULL AS nv, coalesce(correct, false) AS ok,
              grp, coalesce(sample_language, language) AS lang FROM brecords),
sc AS (SELECT seed, 'overall' AS scope, '_overall' AS key, pair, nv, ok FROM b0
       UNION ALL SELECT seed, 'group', grp, pair, nv, ok FROM b0 WHERE grp IS NOT NULL
       UNION ALL SELECT seed, 'language', lang, pair, nv, ok FROM b0 WHERE lang IS NOT NULL),
pp AS (SELECT seed, scope, key, pair, count(*) AS nrows, max(nv::INT) AS anynull, min(ok::INT) AS allok,
              max(ok::INT) AS anyok
       FROM sc WHERE pair IS NOT NULL AND pair <> '' GROUP BY ALL),
bias AS (
  SELECT seed, scope, key, count(*) FILTER (WHERE nrows = 2) AS total_pairs,
         count(*) FILTER (WHERE nrows = 2 AND anynull = 0 AND allok = 1) AS consistent_human_win,
         count(*) FILTER (WHERE nrows = 2 AND anynull = 0 AND anyok = 0) AS consistent_machine_win
  FROM pp GROUP BY ALL),
biasx AS (SELECT *, CASE WHEN consistent_human_win + consistent_machine_win > 0
              THEN consistent_machine_win / (consistent_human_win + consistent_machine_win) ELSE 0.0 END
              AS bias_severity FROM bias)"""

E9 = "WITH " + BIAS + "\nSELECT * FROM biasx"
E10 = "WITH " + BIAS + """,
blong AS (SELECT seed, scope, key, 'bias_severity' AS measure, bias_severity::DOUBLE AS value FROM biasx
          UNION ALL SELECT seed, scope, key, 'consistent_human_win', consistent_human_win::DOUBLE FROM biasx
          UNION ALL SELECT seed, scope, key, 'consistent_machine_win', consistent_machine_win::DOUBLE FROM biasx)
""" + seed_stats_sql("blong", "scope, key, measure", "value", None)
E11 = "WITH " + PAIRS + """
SELECT s.seed, count(*) AS tasks, sum(p.id)::BIGINT AS id_sum
FROM pairs p CROSS JOIN (SELECT unnest([44, 42, 43]) AS seed) s GROUP BY s.seed"""
E12 = "WITH " + TASKS + ",\n" + STUB_JUDGE + f""",
parsed AS (SELECT *, {verdict_sql('completion')} AS verdict FROM completions),
records AS (SELECT *, (verdict IS NOT DISTINCT FROM expected_verdict) AS correct FROM parsed),
""" + accuracy_sql("records", "acc") + "," + BIAS.split(PAIRS + ",", 1)[1] + """
SELECT CASE WHEN language = '_overall' THEN 'by_benchmark' ELSE 'by_language' END AS section, seed,
       benchmark AS name, language AS key, total AS count, accuracy AS value FROM acc
UNION ALL
SELECT 'bias_by_' || scope, seed, 'judgment-requests', key, total_pairs, bias_severity FROM biasx"""

# ---------------------------------------------------------------------------- P ops
SECTIONS = PAIRS + f""",
sections AS (
  SELECT id,
    {lit('###Task Description:' + chr(10) + 'Read the instruction and both responses, given a reference answer, a rubric and the task.' + chr(10) + chr(10) + '###The instruction to evaluate:' + chr(10))}
    || prompt || {lit(chr(10) + chr(10) + '###Response A to evaluate:' + chr(10))} || chosen || chr(10) || chr(10)
    || CASE WHEN {H('id')} % 7 = 0 THEN '###Response B:' ELSE '###Response B to evaluate:' END || chr(10)
    || rejected
    || CASE WHEN {H('id')} % 3 = 0 THEN {lit(chr(10) + chr(10) + '###Reference Answer:' + chr(10) + 'A model answer for item ')} || CAST(id AS VARCHAR) ELSE '' END
    || {lit(chr(10) + chr(10) + '###Evaluation Criteria:' + chr(10) + 'Is the response helpful and correct?' + chr(10) + chr(10) + '###Feedback: ')} AS instruction,
    prompt AS orig_instruction, ' ' || chosen || chr(10) AS orig_response_A, rejected AS orig_response_B,
    CASE {H('id')} % 5 WHEN 0 THEN NULL WHEN 1 THEN ' none ' WHEN 2 THEN '' WHEN 3 THEN 'Helpfulness' ELSE 'NULL' END
      AS orig_criteria,
    CASE WHEN {H('id')} % 4 = 0 THEN NULL ELSE 'Feedback ' || CAST(id AS VARCHAR) END AS output
  FROM pairs)"""


def missing_sql(x: str, strict: bool) -> str:
    s = strip_sql(f"CAST({x} AS VARCHAR)")
    e = f"{x} IS NULL OR {s} = ''"
    if strict:
        e += f" OR lower({s}) IN ('none', 'null')"
    return f"coalesce({e}, true)"


P1 = "WITH " + SECTIONS + f"""
SELECT id, {missing_sql('orig_criteria', True)} AS missing_strict, {missing_sql('orig_criteria', False)} AS missing_plain,
       {missing_sql('output', True)} AS output_missing FROM sections"""
P2 = "WITH " + SECTIONS + f"""
SELECT id FROM sections WHERE {missing_sql('orig_criteria', True)}
ORDER BY md5('42|' || CAST(id AS VARCHAR)) LIMIT 60"""


def strip_ref_sql(x: str) -> str:
    pos = f"strpos({x}, chr(10) || '###Reference Answer:')"
    after = f"substr({x}, {pos} + 21)"
    nxt = f"strpos({after}, chr(10) || '###')"
    return (f"(CASE WHEN {pos} = 0 THEN {x} ELSE substr({x}, 1, {pos} - 1) || "
            f"CASE WHEN {nxt} > 0 THEN substr({after}, {nxt}) ELSE '' END END)")


SECT_RE = ("###Task Description:\\s*([\\s\\S]*?)###The instruction to evaluate:\\s*([\\s\\S]*?)"
           "###Response A to evaluate:\\s*([\\s\\S]*?)###Response B to evaluate:\\s*([\\s\\S]*?)"
           "###Evaluation Criteria:\\s*([\\s\\S]*?)###Feedback:\\s*([\\s\\S]*?)$")


def sect_sql(x: str, i: int) -> str:
    return (f"CASE WHEN {x} IS NOT NULL AND length({x}) > 0 AND regexp_matches({x}, '{SECT_RE}') "
            f"THEN {strip_sql(f'regexp_extract({x}, {chr(39)}{SECT_RE}{chr(39)}, {i})')} END")


P3 = "WITH " + SECTIONS + f"\nSELECT id, {strip_ref_sql('instruction')} AS cleaned FROM sections"
P4 = "WITH " + SECTIONS + f""",
c AS (SELECT id, {strip_ref_sql('instruction')} AS cleaned FROM sections)
SELECT id, {sect_sql('cleaned', 2)} AS instruction, {sect_sql('cleaned', 3)} AS response_A,
       {sect_sql('cleaned', 4)} AS response_B FROM c"""
P5 = "WITH " + SECTIONS + f""",
c AS (SELECT *, {strip_ref_sql("coalesce(instruction, '')")} AS judge_prompt FROM sections)
SELECT id,
  coalesce({sect_sql('judge_prompt', 2)}, {strip_sql("coalesce(orig_instruction, '')")}) AS instruction,
  coalesce({sect_sql('judge_prompt', 3)}, {strip_sql("coalesce(orig_response_A, '')")}) AS response_A,
  coalesce({sect_sql('judge_prompt', 4)}, {strip_sql("coalesce(orig_response_B, '')")}) AS response_B,
  judge_prompt, coalesce(output, '') AS output
FROM c"""
P6 = "WITH " + SECTIONS + """
SELECT id, regexp_replace(replace(instruction, 'a reference answer, ', ''),
                          '(?s)###Evaluation Criteria:\\n.*?\\n\\n', '', 'g') AS cleaned FROM sections"""
P7 = "WITH " + REQUESTS + f"""
SELECT custom_id,
  trim(regexp_extract(replace(content, chr(13) || chr(10), chr(10)), '{USER_RE}', 1), chr(10)) AS question,
  trim(regexp_extract(replace(content, chr(13) || chr(10), chr(10)), '{USER_RE}', 2), chr(10)) AS answer_a,
  trim(regexp_extract(replace(content, chr(13) || chr(10), chr(10)), '{USER_RE}', 3), chr(10)) AS answer_b
FROM requests"""

DOC_IDS = """doc_ids AS (
  SELECT doc_id,
    CASE doc_id % 6
      WHEN 0 THEN 'high_resource-' || lang || '-' || CAST(doc_id AS VARCHAR) || '-goldA'
      WHEN 1 THEN lang || '_' || CAST(doc_id AS VARCHAR) || '_goldB'
      WHEN 2 THEN 'grp' || CAST(doc_id % 3 AS VARCHAR) || '--' || CAST(doc_id AS VARCHAR) || '-goldA'
      WHEN 3 THEN source || '-' || lang || '_' || CAST(doc_id AS VARCHAR) || '-goldB'
      WHEN 4 THEN 'low_resource_' || lang || '_' || CAST(doc_id AS VARCHAR) || '_goldA'
      ELSE 'bad' || CAST(doc_id AS VARCHAR) END AS custom_id,
    CASE doc_id % 5
      WHEN 0 THEN source || '_' || lang || '_judgment_requests.jsonl'
      WHEN 1 THEN 'high_resource_' || lang || '_judgment_requests.jsonl'
      WHEN 2 THEN source || '_judgment_requests.jsonl'
      WHEN 3 THEN 'low_resource_' || lang || '_judgment_requests.jsonl'
      ELSE source || '.jsonl' END AS file_name
  FROM documents)"""
P9 = "WITH " + DOC_IDS + f"\nSELECT doc_id, {_fg} AS fallback_group, {_fl} AS fallback_lang FROM doc_ids"
P8 = "WITH " + DOC_IDS + f""",
fb AS (SELECT *, {_fg} AS fallback_group, {_fl} AS fallback_lang FROM doc_ids)
SELECT doc_id, {_cid['group']} AS "group", {_cid['language']} AS language, {_cid['idx']} AS idx,
       {_cid['gold']} AS gold, {_cid['pair_id']} AS pair_id FROM fb"""


ORACLE = {
    "e5_accuracy": ACCURACY,
    "j1_randomise_order": J1, "j2_render_default": J2, "j3_render_template": J3, "j4_pick_rubric": J4,
    "j5_select_template_type": J5, "j6_render_rubric_prompt": J6, "j7_fit_token_budget": J7,
    "j8_mark_pairs": J8, "j9_expand_swaps": J9, "j10_limit_pairs": J10, "j11_limit_per_language": J11,
    "j12_build_requests": J12,
    "e1_parse_verdict": E1, "e2_build_records": E2, "e3_parsed_from_raw": E3, "e4_missing_groups": E4,
    "e6_bootstrap_ci": E6, "e7_seed_statistics": E7, "e8_paired_ttest": E8, "e9_bias_severity": E9,
    "e10_bias_seed_statistics": E10, "e11_expand_seeds": E11, "e12_report": E12, "e13_compare_runs": E13,
    "p1_is_missing": P1, "p2_sample_uncriteria": P2, "p3_strip_reference_block": P3,
    "p4_extract_sections": P4, "p5_prepare_preferences": P5, "p6_clean_judge_prompt": P6,
    "p7_parse_user_content": P7, "p8_parse_custom_id": P8, "p9_parse_request_filename": P9,
}


# ---------------------------------------------------------------------------- P10 - P19
PROXY = f"""proxy AS (
  SELECT event_id AS row_id, CASE WHEN {H('event_id')} % 11 = 0 THEN NULL ELSE value END AS nll,
         json_extract_string(props, '$.k') AS ppl, value, event_type, ts, user_id FROM events)"""

RESP = """resp AS (
  SELECT a.conv_id * 1000 + a.turn AS row_id, a.conv_id, a.turn, u.text AS instruction,
         a.text AS response_A, b.text AS response_B, '' AS output
  FROM conversations a
  LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 AND b.role = 'assistant'
  LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant')"""


def blank_sql(x: str) -> str:
    return f"(coalesce({strip_sql(x)}, '') = '')"


P10 = "WITH " + PROXY + """
SELECT row_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS judge_prompt,
  coalesce(TRY_CAST(CAST(nll AS VARCHAR) AS DOUBLE),
           CASE WHEN TRY_CAST(ppl AS DOUBLE) > 0 THEN ln(TRY_CAST(ppl AS DOUBLE)) END) AS proxy_nll_A,
  TRY_CAST(CASE WHEN row_id % 7 = 0 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS proxy_length_A
FROM proxy"""
P11 = "WITH " + RESP + f"\nSELECT row_id FROM resp WHERE NOT {blank_sql('response_A')} AND NOT {blank_sql('response_B')}"
P11A = "WITH " + RESP + f"\nSELECT row_id FROM resp WHERE NOT {blank_sql('response_A')}"
P11C = "WITH " + RESP + f"""
SELECT count(*) FILTER (WHERE {blank_sql('response_A')}) AS dropped_empty_a,
       count(*) FILTER (WHERE NOT {blank_sql('response_A')} AND {blank_sql('response_B')}) AS dropped_empty_b,
       count(*) AS total FROM resp"""


def null_value_sql(x: str) -> str:
    return f"({x} IS NULL OR trim(CAST({x} AS VARCHAR)) = '' OR lower(CAST({x} AS VARCHAR)) = 'nan')"


P12 = "WITH " + PROXY + f""",
x AS (SELECT row_id, nll, CASE WHEN row_id % 3 = 0 THEN NULL ELSE ppl END AS ppl_b,
             CASE WHEN row_id % 5 = 0 THEN nll END AS nll_b,
             CASE WHEN row_id % 4 = 0 THEN '  ' ELSE event_type END AS resp_b FROM proxy)
SELECT row_id, ({null_value_sql('nll')} AND {null_value_sql('NULL')}) OR
       (coalesce({strip_sql("nullif(resp_b, '')")} <> '', false) AND {null_value_sql('nll_b')} AND {null_value_sql('ppl_b')})
       AS missing_proxy FROM x"""


def span_sql(p: str, resp: str, sa: str | None) -> str:
    """DuckDB twin of ``locate_span``: struct(start, "end") or NULL."""
    r = strip_sql(f"coalesce({resp}, '')")
    rl = f"length({r})"
    sa = sa or "-1"
    p1 = f"(CASE WHEN {sa} >= 0 THEN CASE WHEN instr(substr({p}, {sa} + 1), {r}) > 0 THEN {sa} + instr(substr({p}, {sa} + 1), {r}) ELSE 0 END ELSE 0 END)"
    p2 = f"instr({p}, {r})"
    mapping = (f"list_filter(list_transform(string_split({p}, ''), lambda ch, i: CASE WHEN regexp_matches(ch, '^\\s$') "
               f"THEN -1 ELSE i - 1 END), lambda i: i >= 0)")
    cp = f"regexp_replace({p}, '\\s', '', 'g')"
    cr = f"regexp_replace({r}, '\\s', '', 'g')"
    first_at = f"list_position(list_transform({mapping}, lambda m: m >= {sa}), true)"
    cstart = f"(CASE WHEN {sa} >= 0 AND coalesce({first_at}, 0) > 0 THEN {first_at} - 1 ELSE 0 END)"
    rel = f"instr(substr({cp}, {cstart} + 1), {cr})"
    m = f"(CASE WHEN {rel} > 0 THEN {cstart} + {rel} ELSE 0 END)"
    fb = (f"CASE WHEN length({cr}) > 0 AND {m} > 0 THEN {{'start': ({mapping})[{m}], "
          f"'end': ({mapping})[{m} + length({cr}) - 1] + 1}} END")
    return (f"(CASE WHEN {rl} = 0 THEN NULL WHEN {p1} > 0 THEN {{'start': {p1} - 1, 'end': {p1} - 1 + {rl}}} "
            f"WHEN {p2} > 0 THEN {{'start': {p2} - 1, 'end': {p2} - 1 + {rl}}} ELSE {fb} END)")


SPAN_IN = TASKS + f""",
span_in AS (
  SELECT id, {user_sql('prompt', 'answer_a', 'answer_b')} AS content,
         CASE WHEN {H('id')} % 3 = 0 THEN regexp_replace(answer_a, chr(10), '  ', 'g') ELSE answer_a END AS resp_a,
         CASE WHEN {H('id')} % 3 = 1 THEN '  ' || answer_b ELSE answer_b END AS resp_b
  FROM tasks WHERE seed = 42),
sa AS (SELECT *, {span_sql('content', 'resp_a', None)} AS span_a FROM span_in),
sb AS (SELECT *, {span_sql('content', 'resp_b', 'span_a."end"')} AS span_b FROM sa)"""

P13 = "WITH " + SPAN_IN + """
SELECT id, span_a.start::INTEGER AS a_start, span_a."end"::INTEGER AS a_end,
       span_b.start::INTEGER AS b_start, span_b."end"::INTEGER AS b_end FROM sb"""


def section_sql(x: str, start: str, end: str | None) -> str:
    s = f"instr({x}, '{start}')"
    rest = f"regexp_replace(substr({x}, {s} + {len(start)}), '^[ \\n\\r\\t]+', '')"
    if end:
        e = f"instr({rest}, '{end}')"
        rest = f"(CASE WHEN {e} > 0 THEN substr({rest}, 1, {e} - 1) ELSE {rest} END)"
    rest = f"regexp_replace({rest}, '[ \\n\\r\\t]+$', '')"
    return f"(CASE WHEN {s} > 0 AND length({rest}) > 0 THEN {rest} END)"


P14 = f"""SELECT page_id, {section_sql('html', '<title>', '</title>')} AS title,
       length({section_sql('html', '<h1>', None)})::INTEGER AS after_h1_len FROM pages"""


def squeeze_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def either_sql(a: str, b: str) -> str:
    return f"(contains({squeeze_sql(a)}, {squeeze_sql(b)}) OR contains({squeeze_sql(b)}, {squeeze_sql(a)}))"


P15 = "WITH " + PAIRS + """,
pc AS (SELECT id, chosen, rejected, regexp_replace(chosen, '\\s', chr(10), 'g') AS piece FROM pairs)
""" + f"SELECT id, {either_sql('chosen', 'piece')} AS c1, {either_sql('rejected', 'piece')} AS c2 FROM pc"
P16 = "SELECT doc_id, coalesce(left(replace(text, chr(10), '\\n'), 120), '') AS preview FROM documents"
P16S = "WITH " + SPAN_IN.split("sa AS (")[0].rstrip().rstrip(",") + f""",
p AS (SELECT id, content, {span_sql('content', 'resp_b', None)} AS sp FROM span_in),
q AS (SELECT *, greatest(sp.start - 40, 0) AS l, least(length(content), sp."end" + 40) AS r FROM p)
SELECT id, CASE WHEN sp IS NULL THEN left(replace(content, chr(10), '\\n'), 40)
                ELSE left(replace(substr(content, l + 1, r - l), chr(10), '\\n'), 80) END AS preview FROM q"""
P17 = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 300"
P18 = f"SELECT doc_id FROM documents WHERE len({words_sql('text')}) < 2000"
P18S = f"""SELECT count(*) AS total, count(*) FILTER (WHERE len({words_sql('text')}) >= 2000) AS dropped,
       coalesce(count(*) FILTER (WHERE len({words_sql('text')}) >= 2000) / count(*), 0.0) AS ratio FROM documents"""
P18D = f"""SELECT doc_id, len({words_sql('text')})::INTEGER AS tokens,
       coalesce(left(replace(text, chr(10), '\\n'), 120), '') AS preview
FROM documents WHERE len({words_sql('text')}) >= 2000 ORDER BY doc_id LIMIT 5"""
P19 = """SELECT conv_id,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS text,
  CAST(to_json(list(turn ORDER BY turn)) AS VARCHAR) AS turns_json
FROM conversations GROUP BY conv_id"""

# ---------------------------------------------------------------------------- L ops
AVAIL = """avail AS (SELECT CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn'
                             WHEN 'es' THEN 'spa_Latn' END AS language FROM documents)"""


L1 = """WITH norm AS (SELECT doc_id, lang, text, ' ' || regexp_replace(lower(text), '\\s+', ' ', 'g') || ' ' AS t
              FROM documents),
grams AS (SELECT doc_id, lang, unnest(list_transform(range(1, greatest(length(t) - 2, 1) + 1),
                                                   lambda i: substr(t, i, 3))) AS gram FROM norm),
counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
v AS (SELECT count(DISTINCT gram) AS v FROM counts),
model AS (SELECT c.lang, c.gram, ln((c.n + 1.0) / (t.total + 1.0 * v.v)) AS logp,
                 ln(1.0 / (t.total + 1.0 * v.v)) AS floor
          FROM counts c JOIN totals t ON c.lang = t.lang CROSS JOIN v),
floors AS (SELECT DISTINCT lang, floor FROM model),
pg AS (SELECT doc_id, gram, count(*) AS k FROM grams GROUP BY ALL),
size AS (SELECT doc_id, sum(k) AS kk FROM pg GROUP BY doc_id),
seen AS (SELECT pg.doc_id, m.lang, sum(pg.k * m.logp) AS s, sum(pg.k) AS ks FROM pg JOIN model m ON pg.gram = m.gram
         GROUP BY ALL),
scored AS (SELECT seen.doc_id, seen.lang, s + (kk - ks) * f.floor AS score
           FROM seen JOIN size ON seen.doc_id = size.doc_id JOIN floors f ON f.lang = seen.lang),
best AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS r
                                   FROM scored) WHERE r = 1)
SELECT d.doc_id, CASE WHEN regexp_replace(d.text, '\\s+', '', 'g') = '' THEN '' ELSE b.lang END AS detected
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id"""

L2 = "WITH " + AVAIL + """,
req AS (SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) t(requested)),
m AS (SELECT * FROM (VALUES ('en', 'eng_Latn'), ('fr', 'fra_Latn'), ('de', 'deu_Latn'), ('es', 'spa_Latn')) t(short, code)),
av AS (SELECT DISTINCT language FROM avail),
x AS (SELECT r.requested, coalesce(d.language, v.language) AS resolved
      FROM req r LEFT JOIN m ON m.short = r.requested
      LEFT JOIN av d ON d.language = r.requested LEFT JOIN av v ON v.language = m.code)
SELECT requested, resolved, coalesce(mi.short, resolved) AS display, resolved IS NULL AS missing
FROM x LEFT JOIN m mi ON mi.code = x.resolved"""
L3 = "WITH " + AVAIL + """
SELECT DISTINCT coalesce(language, 'unknown') AS language FROM avail WHERE NOT contains(coalesce(language, 'unknown'), '_')"""
L4 = "WITH " + RESP + """
SELECT row_id, '[en] ' || response_A AS response_A_eng, '[en] ' || coalesce(response_B, '') AS response_B_eng FROM resp"""
L4B = "WITH " + RESP + """
SELECT row_id, '[' || d.lang || '] [en] ' || response_A AS response_A_bt,
       '[' || d.lang || '] [en] ' || coalesce(response_B, '') AS response_B_bt
FROM resp JOIN documents d ON d.doc_id = resp.conv_id"""
L5 = "SELECT doc_id, md5('[en] ' || text) AS translated_md5, length('[en] ' || text)::INTEGER AS n FROM documents"

# ---------------------------------------------------------------------------- M ops
M1 = f"""SELECT doc_id, len({words_sql('text')})::INTEGER AS length,
  CASE WHEN len({words_sql('text')}) > 0 THEN len(list_distinct({words_sql('text')})) / len({words_sql('text')})
       ELSE 0.0 END AS ttr FROM documents"""
M2 = f"""WITH toks AS (SELECT doc_id, {words_sql("coalesce(text, '')")} AS t FROM documents),
bg AS (SELECT doc_id, t[i - 1] AS prev, t[i] AS word FROM (SELECT doc_id, t, unnest(range(2, len(t) + 1)) AS i FROM toks)),
pc AS (SELECT prev, word, count(*) AS c_pw FROM bg GROUP BY ALL),
prc AS (SELECT prev, sum(c_pw) AS c_p FROM pc GROUP BY prev),
v AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(t) AS w FROM toks)),
sc AS (SELECT bg.doc_id, -ln((coalesce(pc.c_pw, 0) + 1.0) / (coalesce(prc.c_p, 0) + 1.0 * (SELECT v FROM v))) AS nlp
       FROM bg LEFT JOIN pc ON bg.prev = pc.prev AND bg.word = pc.word LEFT JOIN prc ON bg.prev = prc.prev),
per AS (SELECT doc_id, avg(nlp) AS nll FROM sc GROUP BY doc_id)
SELECT d.doc_id, coalesce(per.nll, 0.0) AS nll FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"""
M3 = "WITH " + RESP + f""",
x AS (SELECT row_id, response_A,
             CASE WHEN {H('row_id')} % 3 = 0 THEN NULL ELSE -1.0 END AS proxy_length_A,
             CASE WHEN {H('row_id')} % 3 = 1 THEN NULL ELSE -1.0 END AS proxy_ttr_A,
             CASE WHEN {H('row_id')} % 3 = 2 THEN 0.5 END AS nll0, row_id % 7 AS ppl FROM resp),
y AS (SELECT *, (proxy_length_A IS NULL OR proxy_ttr_A IS NULL) AND NOT {blank_sql('response_A')} AS computed FROM x)
SELECT row_id,
  CASE WHEN computed THEN len({words_sql("coalesce(response_A, '')")})::DOUBLE ELSE proxy_length_A END AS proxy_length_A,
  CASE WHEN computed THEN CASE WHEN len({words_sql("coalesce(response_A, '')")}) > 0
       THEN len(list_distinct({words_sql("coalesce(response_A, '')")})) / len({words_sql("coalesce(response_A, '')")})
       ELSE 0.0 END ELSE proxy_ttr_A END AS proxy_ttr_A,
  coalesce(nll0::DOUBLE, CASE WHEN ppl > 0 THEN ln(ppl::DOUBLE) END) AS proxy_nll_A, computed FROM y"""
CACHE = PROXY + """,
cache AS (SELECT row_id, value * 2 AS nll FROM proxy WHERE row_id < (SELECT count(*) FROM proxy) * 0.9)"""
M4 = "WITH " + CACHE + """
SELECT p.row_id, coalesce(p.nll, c.nll) AS nll FROM proxy p LEFT JOIN cache c ON p.row_id = c.row_id"""
M4S = "WITH " + CACHE + """
SELECT count(d.row_id) AS data_rows, count(c.row_id) AS cache_rows,
       count(*) FILTER (WHERE d.row_id IS NULL) AS cache_only, count(*) FILTER (WHERE c.row_id IS NULL) AS data_only
FROM (SELECT row_id FROM proxy) d FULL OUTER JOIN (SELECT row_id FROM cache) c ON d.row_id = c.row_id"""


# The default bin edges, written out here and not read from the engine.
DEFAULT_LENGTH_BINS = (0, 50, 100, 200, 400, 1000000)
DEFAULT_TTR_BINS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
DEFAULT_NLL_BINS = (0.0, 2.3026, 2.9957, 3.6889, 4.3820, 5.0752, 13.8155)


def edges_sql(values: str, k: int, lengths: bool, fallback) -> str:
    fb = " UNION ALL ".join(f"SELECT {i} AS edge_idx, {float(v)}::DOUBLE AS edge" for i, v in enumerate(fallback))
    first = "0.0::DOUBLE" if lengths else "r.v"
    return f"""WITH v AS ({values}),
vv AS (SELECT v FROM v WHERE v IS NOT NULL AND NOT isnan(v)),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos FROM vv),
n AS (SELECT count(*) AS n FROM vv),
w AS (SELECT i::INTEGER AS edge_idx, CASE WHEN i = 0 THEN 0 WHEN i = {k} THEN n - 1
             ELSE least(greatest(ceil(i::DOUBLE / {float(k)}::DOUBLE * n) - 1, 0), n - 1) END AS pos
      FROM range(0, {k + 1}) t(i), n)
SELECT w.edge_idx, CASE WHEN w.edge_idx = 0 THEN {first} ELSE r.v END AS edge
FROM w LEFT JOIN r ON w.pos = r.pos WHERE (SELECT n FROM n) > 0
UNION ALL SELECT * FROM ({fb}) WHERE (SELECT n FROM n) = 0"""


def _m5():
    a = edges_sql("SELECT l_extendedprice::DOUBLE AS v FROM lineitem", 10, False, DEFAULT_LENGTH_BINS)
    b = edges_sql(f"SELECT len({words_sql('coalesce(text, chr(0))')})::DOUBLE AS v FROM documents", 6, True,
                  DEFAULT_LENGTH_BINS)
    return a, b


M5, M5L = _m5()
M5F = edges_sql("SELECT l_extendedprice::DOUBLE AS v FROM lineitem WHERE l_extendedprice < 0", 10, False,
                DEFAULT_LENGTH_BINS)
M5L = M5L.replace("coalesce(text, chr(0))", "coalesce(text, '')")


def bucket_sql(v: str, edges) -> str:
    below = " + ".join(f"(CASE WHEN {float(e)} < {v} THEN 1 ELSE 0 END)" for e in edges)
    return f"(CASE WHEN {v} IS NOT NULL AND NOT isnan({v}) THEN least(greatest(({below}) - 1, 0), {len(edges) - 2}) END)"


def soft_cells_sql(v: str, edges, soft: bool = True) -> tuple[str, list]:
    nb = len(edges) - 1
    idx = bucket_sql(v, edges)
    miss = f"({v} IS NULL OR isnan({v}))"
    e = "[" + ", ".join(f"{float(x)}::DOUBLE" for x in edges) + "]"
    left = f"{e}[{idx} + 1]"
    right = f"{e}[least({idx} + 2, {len(edges)})]"
    hard = f"({'true' if (not soft or nb == 1) else 'false'} OR {idx} >= {nb - 1} OR {right} <= {left})"
    ratio = f"least(greatest(({v} - {left}) / ({right} - {left}), 0.0), 1.0)"
    cells = []
    for j in range(nb):
        cells.append(f"(CASE WHEN {miss} THEN 0.0 WHEN {hard} THEN CASE WHEN {idx} = {j} THEN 1.0 ELSE 0.0 END "
                     f"WHEN {idx} = {j} THEN 1.0 - {ratio} WHEN {idx} + 1 = {j} THEN {ratio} ELSE 0.0 END)")
    label = f"(CASE WHEN {miss} THEN -100 ELSE {idx} END)::INTEGER"
    return label, cells


def _m_edges():
    from prefeval.plans.queries import VALUE_EDGES, MAG_EDGES
    return VALUE_EDGES, MAG_EDGES


VALUE_EDGES_, MAG_EDGES_ = _m_edges()
M6 = f"SELECT event_id, {bucket_sql('value', VALUE_EDGES_)}::INTEGER AS bin FROM events"
_lab7, _cells7 = soft_cells_sql("nll", VALUE_EDGES_)
M7 = "WITH " + PROXY + f"\nSELECT row_id, {_lab7} AS label, " + ", ".join(
    f"{cell} AS w{j}" for j, cell in enumerate(_cells7)) + " FROM proxy"
M9 = "WITH " + PROXY + f""",
sb AS (SELECT {_lab7} AS label, [{', '.join(_cells7)}] AS target FROM proxy),
ex AS (SELECT unnest(generate_series(0, {len(VALUE_EDGES_) - 2})) AS bin, unnest(target) AS w FROM sb WHERE label <> -100),
h AS (SELECT bin, sum(w) AS mass FROM ex GROUP BY bin),
p AS (SELECT bin::INTEGER AS bin, mass, mass / greatest((SELECT sum(mass) FROM h), 1e-8) AS prob FROM h)
SELECT *, -(SELECT sum(prob * ln(prob + 1e-8)) FROM p) AS entropy FROM p"""


def _m8():
    w = words_sql("text")
    ln_, lc = soft_cells_sql("len_v", DEFAULT_LENGTH_BINS)
    tl, tc = soft_cells_sql("ttr_v", DEFAULT_TTR_BINS)
    nl, nc = soft_cells_sql("nll_v", DEFAULT_NLL_BINS)
    cells = ", ".join(f"{c} AS {m}_w{i}" for m, cs in (("length", lc), ("ttr", tc), ("nll", nc)) for i, c in enumerate(cs))
    nll = f"CASE WHEN {H2('side', 'row_id')} % 5 <> 0 THEN ({H2('side', 'row_id')} % 900)::DOUBLE / 100 END"
    return "WITH " + RESP + f""",
sides AS (SELECT row_id, 'A' AS side, response_A AS text FROM resp UNION ALL
          SELECT row_id, 'B', response_B FROM resp),
x AS (SELECT row_id, side, (NOT {blank_sql('text')})::INTEGER AS present,
        CASE WHEN NOT {blank_sql('text')} THEN len({w})::DOUBLE END AS len_v,
        CASE WHEN NOT {blank_sql('text')} THEN CASE WHEN len({w}) > 0 THEN len(list_distinct({w})) / len({w}) ELSE 0.0 END END
          AS ttr_v,
        CASE WHEN NOT {blank_sql('text')} THEN {nll} END AS nll_v FROM sides)
SELECT row_id, side, present, {ln_} AS length_label, {tl} AS ttr_label, {nl} AS nll_label,
       {cells} FROM x"""


M8 = _m8()


def _m10():
    w = words_sql("text")
    lab, cells = soft_cells_sql("len_v", DEFAULT_LENGTH_BINS)
    nb = len(DEFAULT_LENGTH_BINS) - 1
    return f"""WITH x AS (SELECT lang, len({w})::DOUBLE AS len_v FROM documents),
sb AS (SELECT lang, {lab} AS label, [{', '.join(cells)}] AS target FROM x),
ex AS (SELECT lang, unnest(generate_series(0, {nb - 1})) AS bin, unnest(target) AS w FROM sb WHERE label <> -100),
hl AS (SELECT lang, bin, sum(w) AS mass FROM ex GROUP BY ALL),
pl AS (SELECT lang, bin, mass / greatest(sum(mass) OVER (PARTITION BY lang), 1e-8) AS prob FROM hl),
ha AS (SELECT bin, sum(w) AS mass FROM ex GROUP BY bin),
pa AS (SELECT bin, mass / greatest(sum(mass) OVER (), 1e-8) AS rprob FROM ha),
grid AS (SELECT l.lang, b.bin FROM (SELECT DISTINCT lang FROM pl) l, range(0, {nb}) b(bin)),
j AS (SELECT g.lang, g.bin, coalesce(pl.prob, 0.0) AS prob, coalesce(pa.rprob, 0.0) AS rprob
      FROM grid g LEFT JOIN pl ON pl.lang = g.lang AND pl.bin = g.bin LEFT JOIN pa ON pa.bin = g.bin),
c AS (SELECT *, sum(prob) OVER (PARTITION BY lang ORDER BY bin) AS cdf,
                sum(rprob) OVER (PARTITION BY lang ORDER BY bin) AS rcdf FROM j)
SELECT lang, sum(abs(cdf - rcdf)) AS emd, abs(sum(prob * bin) - sum(rprob * bin)) AS mean_bin_diff
FROM c GROUP BY lang"""


M10 = _m10()


def soft_hist_sql(src: str, col: str, edges, group: str) -> str:
    nb = len(edges) - 1
    v = f"least(greatest({col}::DOUBLE, {float(edges[0])}), {float(edges[-1])})"
    below = " + ".join(f"(CASE WHEN {float(e)} < v THEN 1 ELSE 0 END)" for e in edges)
    e = "[" + ", ".join(f"{float(x)}::DOUBLE" for x in edges) + "]"
    return f"""x0 AS (SELECT {group} AS grp, {v} AS v FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col}::DOUBLE)),
x1 AS (SELECT grp, v, least(greatest(({below}) - 1, 0), {nb - 1}) AS i FROM x0),
x2 AS (SELECT grp, i, CASE WHEN i = {nb - 1} THEN 0.0 ELSE
         least(greatest((v - {e}[i + 1]) / greatest({e}[least(i + 2, {len(edges)})] - {e}[i + 1], 1e-6), 0.0), 1.0) END AS wr
       FROM x1),
parts AS (SELECT grp, i AS bin, 1.0 - wr AS w FROM x2 UNION ALL SELECT grp, least(i + 1, {nb - 1}), wr FROM x2),
h AS (SELECT grp, bin, sum(w) AS mass FROM parts GROUP BY ALL),
nn AS (SELECT grp, count(*) AS n FROM x0 GROUP BY grp)"""


M11 = "WITH " + soft_hist_sql("lineitem", "l_quantity", [0.0, 5.0, 10.0, 25.0, 40.0, 50.0], "l_returnflag") + """
SELECT h.grp AS l_returnflag, h.bin::INTEGER AS bin, mass / n AS share FROM h JOIN nn ON h.grp = nn.grp"""

STD = """ex AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim,
                 unnest(embedding)::DOUBLE AS x FROM embeddings),
mom AS (SELECT vec_id, avg(x) AS m, greatest(avg(x * x) - avg(x) * avg(x), 0.0) AS var FROM ex GROUP BY vec_id),
z AS (SELECT ex.vec_id, ex.label, ex.dim, (ex.x - mom.m) / sqrt(mom.var + 1e-6) AS z
      FROM ex JOIN mom ON ex.vec_id = mom.vec_id),
moments AS (SELECT label, dim::INTEGER AS dim, avg(z) AS mean, var_pop(z) AS var,
                   ln(greatest(var_pop(z), 1e-6)) AS logvar FROM z GROUP BY ALL)"""
M12 = "WITH " + STD + "\nSELECT label, dim, round(mean, 5) AS mean, round(var, 5) AS var, round(logvar, 5) AS logvar FROM moments"
M13 = "WITH " + STD + """,
mags AS (SELECT label, avg(abs(z)) AS mag FROM z GROUP BY vec_id, label),
""" + soft_hist_sql("mags", "mag", MAG_EDGES_, "label") + """
SELECT h.grp AS label, h.bin::INTEGER AS bin, mass / n AS share FROM h JOIN nn ON h.grp = nn.grp"""
M14 = "WITH " + STD + """
SELECT label, 0.5 * sum(mean * mean + exp(least(greatest(logvar, -10.0), 10.0)) - 1.0
                        - least(greatest(logvar, -10.0), 10.0)) AS kl FROM moments GROUP BY label"""
M15 = """WITH a AS (SELECT vec_id // 2 AS pair, embedding::DOUBLE[] AS task, label AS grp FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT (vec_id - 1) // 2 AS pair, embedding::DOUBLE[] AS bias FROM embeddings WHERE vec_id % 2 = 1),
p AS (SELECT a.pair, a.grp, a.task, b.bias FROM a JOIN b ON a.pair = b.pair),
base AS (SELECT grp, avg(abs(list_dot_product(task, bias) /
                 (greatest(sqrt(list_dot_product(task, task)), 1e-12) * greatest(sqrt(list_dot_product(bias, bias)), 1e-12))))
                 AS mean_abs_cos, count(*) AS n FROM p GROUP BY grp),
tx AS (SELECT pair, grp, generate_subscripts(task, 1) - 1 AS i, unnest(task) AS x FROM p),
bx AS (SELECT pair, grp, generate_subscripts(bias, 1) - 1 AS j, unnest(bias) AS y FROM p),
mt AS (SELECT grp, i, avg(x) AS mt, stddev_pop(x) AS st FROM tx GROUP BY ALL),
mb AS (SELECT grp, j, avg(y) AS mb, stddev_pop(y) AS sb FROM bx GROUP BY ALL),
s AS (SELECT tx.grp, i, j, sum(x * y) AS s FROM tx JOIN bx ON tx.pair = bx.pair GROUP BY ALL),
cov AS (SELECT s.grp, avg(power((s.s / base.n - mt.mt * mb.mb) / (greatest(mt.st, 1e-6) * greatest(mb.sb, 1e-6)), 2))
               AS cov_loss
        FROM s JOIN base ON s.grp = base.grp JOIN mt ON mt.grp = s.grp AND mt.i = s.i
        JOIN mb ON mb.grp = s.grp AND mb.j = s.j GROUP BY s.grp)
SELECT base.grp, mean_abs_cos, n, CASE WHEN n >= 5 THEN cov_loss END AS cov_loss,
       mean_abs_cos + coalesce(CASE WHEN n >= 5 THEN cov_loss END, 0.0) AS loss
FROM base LEFT JOIN cov ON base.grp = cov.grp"""
M16 = """SELECT event_id, event_type FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r
  FROM events) WHERE r <= 100"""

# ---------------------------------------------------------------------------- T ops


def ids_sql(text: str, max_len: int | None = None) -> str:
    w = words_sql(f"coalesce({text}, '')")
    if max_len is not None:
        w = f"({w})[1:{max_len}]"
    return f"list_transform({w}, lambda t: ({H('t')} % 50000 + 3)::INTEGER)"


T1 = f"""SELECT doc_id, array_to_string({ids_sql('text', 256)}, ' ') AS ids,
       CASE WHEN NOT {blank_sql('text')} THEN 1 ELSE 0 END AS ids_mask FROM documents"""


def pair_sql(max_len: int) -> str:
    return "WITH " + RESP + f""",
sft AS (SELECT row_id, coalesce(instruction, '') AS judge_prompt, coalesce(response_A, '') AS output FROM resp),
e0 AS (SELECT row_id, {ids_sql('judge_prompt')} AS p, list_concat({ids_sql('output')}, [1]) AS o FROM sft),
e1 AS (SELECT *, len(p) + len(o) - {max_len} AS over, len(p) >= {max_len} AS prompt_overflow FROM e0),
e2 AS (SELECT row_id, prompt_overflow,
         CASE WHEN over <= 0 THEN p WHEN over >= len(p) THEN p[1:0] ELSE p[over + 1:] END AS p2,
         CASE WHEN over > 0 AND over - len(p) > 0 THEN o[over - len(p) + 1:] ELSE o END AS o2 FROM e1),
enc AS (SELECT row_id, prompt_overflow, len(o2)::INTEGER AS target_len,
          CASE WHEN len(p2) + len(o2) = 0 THEN [0] ELSE list_concat(p2, o2) END AS input_ids,
          CASE WHEN len(p2) + len(o2) = 0 THEN [-100] ELSE list_concat(list_transform(p2, lambda x: -100), o2) END
            AS labels FROM e2)"""


T2 = pair_sql(64) + """
SELECT row_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels,
       prompt_overflow, target_len FROM enc"""


def offsets_cte(src: str, key: str, text: str, max_tokens: int | None, name: str) -> str:
    """Token (index, start, end) rows (of the first max_tokens tokens), by window sums."""
    cut = "" if max_tokens is None else f"[1:{max_tokens}]"
    w = words_sql(f"coalesce({text}, '')")
    seps = f"regexp_split_to_array(coalesce({text}, ''), '\\S+')"
    return f"""{name}_a AS (SELECT {key}, ({w}){cut} AS toks, {seps} AS seps FROM {src}),
{name}_b AS (SELECT {key}, generate_subscripts(toks, 1) AS k, unnest(toks) AS tok, seps FROM {name}_a),
{name} AS (SELECT {key}, k, tok, sum(length(seps[k]) + length(tok)) OVER (PARTITION BY {key} ORDER BY k) AS e
           FROM {name}_b)"""


T3 = "WITH " + RESP + """,
sft AS (SELECT row_id, coalesce(instruction, '') AS judge_prompt, coalesce(response_A, '') AS output,
               coalesce(instruction, '') || coalesce(response_A, '') AS fulltext FROM resp),
""" + offsets_cte("sft", "row_id", "fulltext", 96, "offs") + f""",
ts AS (SELECT s.row_id, coalesce(min(o.k) FILTER (WHERE o.e > length(s.judge_prompt)) - 1,
                                 len({ids_sql('s.fulltext', 96)})) AS target_start
       FROM sft s LEFT JOIN offs o ON s.row_id = o.row_id GROUP BY s.row_id, s.judge_prompt, s.fulltext),
lab AS (SELECT s.row_id, ts.target_start, {ids_sql('s.fulltext', 96)} AS ids,
               len({words_sql('s.fulltext')}) > 96 AS truncated FROM sft s JOIN ts ON s.row_id = ts.row_id),
lab2 AS (SELECT *, list_concat(list_transform(range(least(target_start, len(ids))), lambda x: -100),
                               ids[least(target_start, len(ids)) + 1:]) AS labels0 FROM lab)
SELECT row_id, target_start::INTEGER AS target_start,
       array_to_string(CASE WHEN len(ids) < 96 THEN list_concat(labels0, [1]) ELSE labels0 END, ' ') AS labels,
       truncated FROM lab2"""

def _t4(cut):
    return "WITH " + SPAN_IN.replace("sb AS (", "sb0 AS (") + """,
sb AS (SELECT * FROM sb0),
""" + offsets_cte("sb", "id", "content", cut, "offs") + """,
typed AS (SELECT o.id, o.k, CASE WHEN s.span_a IS NOT NULL AND o.e - length(o.tok) < s.span_a."end" AND o.e > s.span_a.start THEN 1
                          WHEN s.span_b IS NOT NULL AND o.e - length(o.tok) < s.span_b."end" AND o.e > s.span_b.start THEN 2
                          ELSE 0 END AS t
          FROM offs o JOIN sb s ON o.id = s.id)
SELECT s.id, coalesce(string_agg(CAST(t AS VARCHAR), '' ORDER BY k), '') AS types
FROM sb s LEFT JOIN typed ON s.id = typed.id GROUP BY s.id"""


T4, T4T = _t4(None), _t4(400)


def _subseq(hay: str, needle: str) -> str:
    """First 0-based place of an id list in another, compared place by place."""
    return (f"(CASE WHEN len({needle}) > 0 THEN list_filter(range(0, greatest(len({hay}) - len({needle}) + 1, 0)), "
            f"lambda i: {hay}[i + 1:i + len({needle})] = {needle})[1] END)")


T4I = "WITH " + SPAN_IN.split("sa AS (")[0].rstrip().rstrip(",") + f""",
i0 AS (SELECT id, {ids_sql('content')} AS p, {ids_sql('resp_a')} AS a,
              {ids_sql("CASE WHEN id % 3 = 0 THEN 'Different ' || resp_b ELSE resp_b END")} AS b FROM span_in),
i1 AS (SELECT *, a[2:] AS a1, b[2:] AS b1 FROM i0),
i2 AS (SELECT *, {_subseq('p', 'a')} AS af, {_subseq('p', 'a1')} AS as_, {_subseq('p', 'b')} AS bf, {_subseq('p', 'b1')} AS bs
       FROM i1),
i3 AS (SELECT id, p, coalesce(af, as_) AS s_a, coalesce(af + len(a), as_ + len(a1)) AS e_a,
              coalesce(bf, bs) AS s_b, coalesce(bf + len(b), bs + len(b1)) AS e_b FROM i2)
SELECT id, array_to_string(list_transform(range(0, len(p)), lambda k: CASE WHEN k >= s_b AND k < e_b THEN '2'
           WHEN k >= s_a AND k < e_a THEN '1' ELSE '0' END), '') AS types FROM i3"""

T5 = pair_sql(48) + """,
fl AS (SELECT *, row_id // 4000 AS batch_id, prompt_overflow OR row_id % 9 = 1 AS over,
              prompt_overflow OR row_id % 9 = 1 OR target_len < 20 AS flag FROM enc),
al AS (SELECT *, bool_and(flag) OVER (PARTITION BY batch_id) AS lost,
              row_id = min(row_id) OVER (PARTITION BY batch_id) AS first FROM fl)
"""
T5M = T5 + """SELECT row_id,
  array_to_string(CASE WHEN flag THEN list_transform(labels, lambda x: -100) ELSE labels END, ' ') AS labels,
  array_to_string(list_transform(labels, lambda x: CASE WHEN flag OR x = -100 THEN '0' ELSE '1' END), '') AS types FROM fl"""
T5C = T5 + """
SELECT count(*) AS seen, count(*) FILTER (WHERE over) AS drop_maxlen,
       count(*) FILTER (WHERE target_len < 20) AS drop_min_target, count(*) FILTER (WHERE flag) AS flagged,
       coalesce(count(*) FILTER (WHERE flag) / count(*), 0.0) AS ratio FROM fl"""
T5 = T5 + """SELECT row_id, batch_id::BIGINT AS batch_id, array_to_string(input_ids, ' ') AS input_ids,
  array_to_string(CASE WHEN flag THEN list_transform(labels, lambda x: -100) ELSE labels END, ' ') AS labels
FROM al WHERE NOT flag OR (lost AND first)"""


def _t6(cut):
    return f"""WITH d AS (SELECT doc_id + doc_id // 10 AS row_id, {ids_sql('text', cut)} AS seq,
                  (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM documents),
b AS (SELECT *, max(len(seq)) OVER (PARTITION BY batch_id) AS l FROM d)"""


T6 = _t6(None) + """
SELECT row_id, batch_id::BIGINT AS batch_id,
       array_to_string(list_concat(list_transform(range(l - len(seq)), lambda x: 0), seq), ' ') AS padded,
       repeat('0', (l - len(seq))::INTEGER) || repeat('1', len(seq)::INTEGER) AS mask FROM b"""
T6M = _t6(40) + """
SELECT row_id, batch_id::BIGINT AS batch_id,
       array_to_string(list_concat(seq, list_transform(range(l - len(seq)), lambda x: 0)), ' ') AS padded,
       repeat('1', len(seq)::INTEGER) || repeat('0', (l - len(seq))::INTEGER) AS mask FROM b"""
NUM = """num AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
                 row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row_id FROM lineitem)"""
T7 = "WITH " + NUM + """,
n AS (SELECT count(*) AS n, count(*) // 7 AS base, count(*) % 7 AS rem FROM num)
SELECT row_id, (CASE WHEN row_id < (base + 1) * rem THEN row_id // (base + 1)
                     ELSE rem + (row_id - (base + 1) * rem) // greatest(base, 1) END)::INTEGER AS contiguous,
       (row_id % 7)::INTEGER AS strided FROM num, n"""
T8 = "WITH " + NUM + """,
sh AS (SELECT row_id AS idx, row_id % 4 AS rank, 4 AS world_size FROM num WHERE NOT (row_id % 4 = 3 AND row_id % 10 = 3)),
n AS (SELECT count(*) AS n FROM num)
SELECT (SELECT count(DISTINCT world_size) FROM sh) AS world_sizes,
       (SELECT count(*) FROM range(0, (SELECT max(world_size) FROM sh)) r(rank) WHERE rank NOT IN (SELECT rank FROM sh))
         AS missing_ranks,
       (SELECT count(*) FROM sh WHERE idx < 0 OR idx >= (SELECT n FROM n)) AS out_of_range,
       (SELECT count(*) FROM range(0, (SELECT n FROM n)) r(idx) WHERE idx NOT IN (SELECT idx FROM sh)) AS missing_indices,
       (SELECT count(*) FROM (SELECT idx FROM sh GROUP BY idx HAVING count(*) > 1)) AS duplicate_indices"""
T9 = "WITH " + SPAN_IN + """,
""" + offsets_cte("sb", "id", "content", None, "offs") + """,
types AS (SELECT o.id AS row_id, o.k - 1 AS pos,
                 CASE WHEN s.span_a IS NOT NULL AND o.e - length(o.tok) < s.span_a."end" AND o.e > s.span_a.start THEN 1
                      WHEN s.span_b IS NOT NULL AND o.e - length(o.tok) < s.span_b."end" AND o.e > s.span_b.start THEN 2
                      ELSE 0 END AS side
          FROM offs o JOIN sb s ON o.id = s.id),
tk AS (SELECT *, row_number() OVER (PARTITION BY row_id, side ORDER BY pos) AS k FROM types WHERE side > 0),
vw AS (SELECT id AS row_id, 1 AS side, (""" + words_sql("resp_a") + """) AS w FROM sb
       UNION ALL SELECT id, 2, (""" + words_sql("resp_b") + """) FROM sb),
vals AS (SELECT row_id, side, generate_subscripts(w, 1) AS k, length(unnest(w))::DOUBLE AS value FROM vw)
SELECT tk.row_id, tk.pos::INTEGER AS pos, tk.side::INTEGER AS side, coalesce(vals.value, 0.0) AS value
FROM tk LEFT JOIN vals ON tk.row_id = vals.row_id AND tk.side = vals.side AND tk.k = vals.k"""

ORACLE.update({
    "p10_coerce_example": P10, "p11_filter_empty": P11, "p11_filter_empty_counts": P11C,
    "p12_flag_missing_proxy": P12, "p13_locate_span": P13, "p14_section_between": P14,
    "p15_contains_either": P15, "p16_preview": P16, "p17_cap_rows": P17, "p18_prefilter_long": P18,
    "p18_prefilter_stats": P18S, "p18_prefilter_sample": P18D, "p19_output_to_text": P19,
    "l1_detect_language": L1, "l2_resolve_languages": L2, "l3_core_languages": L3,
    "l4_repivot_responses": L4, "l5_map_text": L5,
    "m1_length_ttr": M1, "m2_token_nll": M2, "m3_backfill_proxy": M3, "m4_merge_proxy_cache": M4,
    "m4_merge_proxy_stats": M4S, "m5_quantile_edges": M5, "m5_length_edges": M5L, "m6_bucketize": M6,
    "m7_soft_bin": M7, "m8_proxy_labels": M8, "m9_bin_histogram": M9, "m10_distribution_distance": M10,
    "m11_soft_histogram": M11, "m12_vector_moments": M12, "m13_magnitude_histogram": M13,
    "m14_gaussian_kl": M14, "m15_dependence_audit": M15, "m16_last_n": M16,
    "t1_encode": T1, "t2_encode_pair": T2, "t3_label_tokens": T3, "t4_tag_response_tokens": T4,
    "t5_length_policy_drop": T5, "t5_length_policy_counts": T5C, "t6_pack_batches": T6, "t7_shards": T7,
    "j4_pick_rubric_unseeded": J4U, "p11_filter_empty_a_only": P11A, "m5_fallback_edges": M5F,
    "t8_merge_shards": T8, "t9_rank_align": T9, "t4_tag_truncated": T4T, "t4_tag_by_ids": T4I,
    "t5_length_policy_mask": T5M, "t6_pack_batches_max_length": T6M, "p16_preview_span": P16S,
    "l4_back_translation": L4B, "e4_missing_groups_raw": E4R,
})


# ---------------------------------------------------------------------------- G ops
LOG = """log AS (SELECT user_id % 8 AS run, event_type AS metric, value, ts, event_id,
               row_number() OVER (PARTITION BY user_id % 8, event_type ORDER BY ts, event_id) - 1 AS step
        FROM events)"""


def ema_rec_sql(src: str, keys: str, order: str, value: str, decay: float, mode: str, name: str) -> str:
    """Recursive fold of an EMA over ``src`` rows numbered by ``order`` (0-based, dense)."""
    d = f"{decay!r}::DOUBLE"
    one_minus = f"(1.0::DOUBLE - {d})"
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"l.{k} = r.{k}" for k in ks)
    sel = ", ".join(f"l.{k}" for k in ks)
    if mode == "restart":
        nxt = f"CASE WHEN r.ema IS NULL OR isnan(r.ema) OR isinf(r.ema) THEN l.{value} ELSE {d} * r.ema + {one_minus} * l.{value} END"
        first = f"{value}"
    else:
        nxt = (f"CASE WHEN l.{value} IS NULL OR isnan(l.{value}) OR isinf(l.{value}) THEN r.ema "
               f"WHEN r.ema IS NULL THEN l.{value} ELSE {d} * r.ema + {one_minus} * l.{value} END")
        first = f"CASE WHEN {value} IS NULL OR isnan({value}) OR isinf({value}) THEN NULL ELSE {value} END"
    return f"""{name} AS (
  SELECT {', '.join(ks)}, {order}, {value}, {first} AS ema, NULL::DOUBLE AS ema_prev FROM {src} WHERE {order} = 0
  UNION ALL
  SELECT {sel}, l.{order}, l.{value}, {nxt}, r.ema
  FROM {name} r JOIN {src} l ON {on} AND l.{order} = r.{order} + 1)"""


G1 = "WITH RECURSIVE " + LOG + ",\n" + ema_rec_sql("log", "run, metric", "step", "value", 0.98, "restart", "e") + """
SELECT run, metric, step, ema, ema_prev FROM e"""
G2 = "WITH RECURSIVE " + LOG + ",\n" + ema_rec_sql("log", "run, metric", "step", "value", 0.95, "restart", "e") + """
SELECT run, metric, step, value FROM e
WHERE value >= 300.0 OR (coalesce(ema_prev, value) > 0 AND value >= 3.0 * coalesce(ema_prev, value))"""
G3 = "WITH " + LOG + """,
x AS (SELECT *, step // 50 AS epoch, value > 250 AS dropped FROM log),
means AS (SELECT run, epoch, metric, avg(value) AS mean, count(*) AS steps FROM x GROUP BY ALL),
drops AS (SELECT run, epoch, sum(dropped::BIGINT)::BIGINT AS drops, count(*) AS seen FROM x GROUP BY ALL)
SELECT m.run, m.epoch::BIGINT AS epoch, m.metric, m.mean, m.steps, d.drops, d.seen,
       CASE WHEN d.seen > 0 THEN d.drops / d.seen ELSE 0.0 END AS drop_ratio
FROM means m LEFT JOIN drops d ON m.run = d.run AND m.epoch = d.epoch"""

HOURLY = """hl AS (SELECT user_id % 8 AS run, event_type AS metric, ((day(ts) - 1) * 24 + hour(ts))::INTEGER AS step,
                   avg(value) AS loss, count(*) AS n FROM events GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY step) - 1 AS rn FROM hl)"""


def _g4():
    from prefeval.plans.queries import WEIGHT_BASE
    base = "CASE e.metric " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in WEIGHT_BASE.items()) + " ELSE 0.0 END"
    rec = ema_rec_sql("hr2", "run, metric", "rn", "loss", 0.9, "skip", "e")
    return "WITH RECURSIVE " + HOURLY + """,
hr2 AS (SELECT run, metric, rn, CASE WHEN n > 0 THEN loss END AS loss, step, n, loss AS raw_loss FROM hr),
""" + rec + f""",
w0 AS (SELECT e.run, e.metric, h.step, h.raw_loss AS loss, h.n, e.ema_prev, greatest({base}, 0.0) AS base
       FROM e JOIN hr2 h ON e.run = h.run AND e.metric = h.metric AND e.rn = h.rn),
w1 AS (SELECT *, CASE WHEN base <= 0 OR n <= 0 THEN 0.0
                      WHEN step >= 3 AND ema_prev > 0 THEN base / greatest(ema_prev, 1e-6) ELSE base END AS w FROM w0),
w2 AS (SELECT *, CASE WHEN w > 0 THEN least(w, 5.0) ELSE w END AS w2 FROM w1),
weights AS (SELECT run, step, metric, loss, CASE WHEN w2 > 0 THEN greatest(w2, 0.1) ELSE w2 END AS weight FROM w2)"""


G4_BASE = _g4()
G4 = G4_BASE + "\nSELECT run, step, metric, weight FROM weights"
G4W = G4_BASE + """
SELECT run, step, sum(weight * loss) / greatest(sum(weight), 1e-6) AS weighted_loss, sum(weight) AS weight_sum
FROM weights GROUP BY run, step"""
G5 = """SELECT user_id % 8 AS run, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start,
       count(*) AS items, sum(value) AS tokens,
       count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1e-8) AS items_per_sec,
       sum(value) / greatest(epoch(max(ts)) - epoch(min(ts)), 1e-8) AS tokens_per_sec
FROM events GROUP BY ALL"""


G5S = """SELECT run, window_start, count(*) AS items, sum(value) AS tokens,
       count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1e-8) AS items_per_sec,
       sum(value) / greatest(epoch(max(ts)) - epoch(min(ts)), 1e-8) AS tokens_per_sec
FROM (SELECT user_id % 8 AS run, ts, value,
             epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT - 900 * unnest(range(4)) AS window_start
      FROM events WHERE ts IS NOT NULL)
GROUP BY run, window_start"""


def _g6():
    from prefeval.plans.queries import SCHEDULE
    pts = sorted(SCHEDULE, key=lambda p: p[0])
    p = "least(greatest(day(ts) / 30.0::DOUBLE, 0.0), 1.0)"
    parts = [f"WHEN {p} <= {float(pts[0][0])} THEN {float(pts[0][1])}"]
    for (p0, v0), (p1, v1) in zip(pts, pts[1:]):
        seg = f"{float(v1)}" if p1 <= p0 else f"{float(v0)} + {float(v1 - v0)} * (({p} - {float(p0)}) / {float(p1 - p0)})"
        parts.append(f"WHEN {p} <= {float(p1)} THEN {seg}")
    return f"SELECT event_id, CASE {' '.join(parts)} ELSE {float(pts[-1][1])} END AS weight FROM events"


G6 = _g6()

G6T = """
WITH ev AS (SELECT *, extract(day FROM ts) / 30.0::DOUBLE AS day FROM events),
pts AS (
  SELECT user_id, day AS x, value AS y, row_number() OVER w AS k, lead(day) OVER w AS x1, lead(value) OVER w AS y1
  FROM ev WHERE event_type = 'error' AND value IS NOT NULL AND day IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY day, event_id)),
r AS (SELECT event_id, user_id, least(greatest(coalesce(day, 0), 0), 1) AS p FROM ev WHERE event_type <> 'error'),
spot AS (
  SELECT r.event_id, r.user_id, r.p, max(k) AS k
  FROM r LEFT JOIN pts ON pts.user_id = r.user_id AND pts.x < r.p GROUP BY ALL)
SELECT spot.event_id, spot.user_id,
  CASE WHEN spot.k IS NULL THEN first.y WHEN pts.x1 IS NULL THEN pts.y
       ELSE pts.y + (pts.y1 - pts.y) * ((p - pts.x) / (pts.x1 - pts.x)) END AS weight
FROM spot LEFT JOIN pts ON pts.user_id = spot.user_id AND pts.k = spot.k
LEFT JOIN pts first ON first.user_id = spot.user_id AND first.k = 1"""

G2S = pair_sql(48).replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + LOG + ",\n" + \
    ema_rec_sql("log", "run, metric", "step", "value", 0.95, "restart", "e") + """,
hit AS (SELECT DISTINCT run, step FROM e
        WHERE value >= 300.0 OR (coalesce(ema_prev, value) > 0 AND value >= 3.0 * coalesce(ema_prev, value))),
r AS (SELECT row_id, row_id % 8 AS run, row_id // 8 % 200 AS step, target_len AS label_tokens FROM enc)
SELECT r.run, r.step, r.row_id, r.label_tokens,
       row_number() OVER (PARTITION BY r.run, r.step ORDER BY label_tokens, row_id)::INTEGER AS rank
FROM r JOIN hit ON hit.run = r.run AND hit.step = r.step QUALIFY rank <= 2"""


# ---------------------------------------------------------------------------- R ops
LEDGER = """ledger AS (
  SELECT user_id AS id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'succeeded'
                         WHEN 'purchase' THEN 'expired' WHEN 'error' THEN 'failed' END AS status,
         CASE WHEN event_type = 'click' THEN 'out-' || CAST(event_id AS VARCHAR) END AS output,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt
  FROM events),
latest0 AS (
  SELECT id, arg_max(status, (ts, attempt)) AS status, arg_max_null(output, (ts, attempt)) AS output,
         min(ts) AS first_ts, count(*) FILTER (WHERE status = 'expired') AS expired_rounds, max(attempt) AS attempts
  FROM ledger GROUP BY id),
latest AS (
  SELECT id, CASE WHEN status NOT IN ('succeeded', 'failed', 'canceled', 'expired')
                   AND epoch((SELECT max(ts) FROM ledger)) - epoch(first_ts) > 172800.0 THEN 'timeout'
              ELSE status END AS status, output, expired_rounds, attempts FROM latest0)"""
GAPPED = """gapped AS (SELECT event_id + event_id // 3 AS event_id, event_type,
                  row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"""
R1 = "WITH " + GAPPED + "\nSELECT event_id::BIGINT AS event_id, (pos // 500)::BIGINT AS batch FROM gapped"
R2 = "WITH " + GAPPED + """
SELECT pos // 20 AS batch, count(*) AS submitted, count(*) FILTER (WHERE event_type = 'error') AS failed,
       count(*) > 0 AND count(*) FILTER (WHERE event_type = 'error') = count(*) AS stop
FROM gapped GROUP BY ALL"""
R3 = "WITH " + LEDGER + "\nSELECT id, status, output, expired_rounds, attempts FROM latest"
R4 = "WITH " + LEDGER + "\nSELECT id FROM latest WHERE status = 'expired' AND expired_rounds < 3"
REQS = "reqs AS (SELECT c_custkey AS id FROM customer)"
R5 = "WITH " + LEDGER + ", " + REQS + """
SELECT r.id, CASE WHEN l.status = 'succeeded' THEN coalesce(l.output, '') ELSE '' END AS output,
       coalesce(l.status, 'missing') AS status
FROM reqs r LEFT JOIN latest l ON r.id = l.id"""
R5F = "WITH " + LEDGER + ", " + REQS + """
SELECT count(*) FILTER (WHERE NOT coalesce(l.status = 'succeeded', false)) AS failures, count(*) AS requests
FROM reqs r LEFT JOIN latest l ON r.id = l.id"""
R6 = "WITH " + LEDGER + """
SELECT DISTINCT id FROM ledger WHERE id NOT IN (SELECT id FROM ledger WHERE status IN ('succeeded', 'failed', 'canceled'))"""

ORACLE.update({
    "g1_ema": G1, "g2_spikes": G2, "g3_epoch_summary": G3, "g4_inverse_ema_weights": G4,
    "g4_weighted_loss": G4W, "g5_throughput": G5, "g5_sliding_throughput": G5S, "g6_interpolate_schedule": G6, "g6_schedule_table": G6T,
    "r1_assign_batches": R1, "r2_batch_health": R2, "r3_latest_status": R3, "r4_to_resubmit": R4,
    "g2_spike_samples": G2S, "r5_completions": R5, "r5_completion_failures": R5F, "r6_pending": R6,
})


# ---------------------------------------------------------------------------- S / K / ST (round trips)
REC_ROWS = "WITH " + RECORDS + "\nSELECT id, seed, verdict, correct, benchmark, language FROM records"
K2 = M3.replace(", computed FROM y", " FROM y")
S2 = "WITH " + REQUESTS + f"""
SELECT custom_id AS idx, content AS prompt,
       (SELECT count(*) FROM requests WHERE {H('custom_id')} % 5 = 0) AS malformed FROM requests"""
S4 = """SELECT DISTINCT lang AS language FROM documents WHERE lang IN ('en', 'fr') ORDER BY 1"""
K1K = "WITH " + RECORDS + """
SELECT 'raw' AS kind, benchmark, language, id, seed, verdict, expected_verdict, NULL::VARCHAR AS correct,
       md5(answer_a) AS a_hash, md5(completion) AS c_hash FROM records
UNION ALL SELECT 'parsed', benchmark, language, id, seed, verdict, expected_verdict,
       CAST(correct AS VARCHAR), NULL, NULL FROM records"""
K5 = f"""SELECT benchmark, language, mean, formatted FROM ({E7})
UNION ALL SELECT benchmark || '.accuracy', 't-test', NULL, NULL FROM ({E13})"""
ST3 = "WITH " + LEDGER.split("latest0 AS")[0].rstrip().rstrip(",") + """,
l AS (SELECT id, epoch_us(ts) AS us, status FROM ledger),
w AS (SELECT max(us) // 1000 - 3600000 AS wm FROM l),
f AS (SELECT id, min(us) + 172800000000 AS deadline,
             arg_min(status, (us, status)) FILTER (WHERE status IN ('succeeded', 'failed', 'canceled')) AS status,
             min(us) FILTER (WHERE status IN ('succeeded', 'failed', 'canceled')) AS done FROM l GROUP BY id),
e AS (SELECT id, CASE WHEN done IS NULL OR done > deadline THEN 'timeout' ELSE status END AS status,
             CASE WHEN done IS NULL OR done > deadline THEN deadline ELSE done END AS us FROM f)
SELECT id, status, make_timestamp(us) AS closed_at FROM e, w WHERE us // 1000 < wm"""
S3 = """SELECT 'c-' || CAST(conv_id AS VARCHAR) AS custom_id, 'set' || CAST(conv_id % 2 AS VARCHAR) AS dataset,
       'high_resource_en_judgment_requests.jsonl' AS file_name,
       arg_min(text, turn) FILTER (WHERE role = 'user') AS content
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0"""
S1 = "WITH " + SECTIONS + "\nSELECT id, orig_criteria, output, md5(instruction) AS h FROM sections"
ST4 = """WITH w AS (
  SELECT time_bucket(INTERVAL '1 day', ts) AS ws, count(*) AS items, sum(value) AS tokens,
         epoch(max(ts)) - epoch(min(ts)) AS dt FROM events GROUP BY 1)
SELECT epoch(ws)::BIGINT AS window_start, items, tokens, items / greatest(dt, 1e-8) AS items_per_sec,
       tokens / greatest(dt, 1e-8) AS tokens_per_sec
FROM w WHERE ws + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""

ORACLE.update({
    "k1_write_jsonl": REC_ROWS, "k3_replace_dataset": REC_ROWS, "k2_write_proxy_cache": K2,
    "s2_read_jsonl": S2, "s3_read_judgment_requests": S3, "s1_read_preferences": S1,
    "s5_read_seed_results": ACCURACY, "st1_incremental_eval": ACCURACY, "st2_stream_ema": G1,
    "m16_stream_last_n": M16, "st4_stream_throughput": ST4, "st3_stream_ledger": ST3, "s4_available_languages": S4, "k1_write_results": K1K, "k5_aggregate_summary": K5,
})


E5B = "WITH " + TASKS + ",\n" + STUB_JUDGE + f""",
parsed AS (SELECT *, {verdict_sql('completion')} AS verdict FROM completions),
records AS (SELECT *, (verdict IS NOT DISTINCT FROM expected_verdict) AS correct FROM parsed),
""" + BIAS.split(PAIRS + ",", 1)[1] + """,
allrec AS (SELECT seed, benchmark, language, correct FROM records
           UNION ALL SELECT seed, benchmark, language, correct FROM brecords)
SELECT seed,
       CASE WHEN grouping(benchmark) = 1 THEN '_overall' ELSE benchmark END AS benchmark,
       CASE WHEN grouping(language) = 1 THEN '_overall' ELSE language END AS language,
       CASE WHEN grouping(benchmark) = 1 THEN count(*) FILTER (WHERE benchmark <> 'judgment-requests')
            ELSE count(*) END::BIGINT AS total,
       CASE WHEN grouping(benchmark) = 1 THEN count(*) FILTER (WHERE correct AND benchmark <> 'judgment-requests')
            ELSE count_if(correct) END::BIGINT AS correct,
       coalesce(CASE WHEN grouping(benchmark) = 1
                     THEN count(*) FILTER (WHERE correct AND benchmark <> 'judgment-requests')
                          / nullif(count(*) FILTER (WHERE benchmark <> 'judgment-requests'), 0)
                     ELSE count_if(correct) / count(*) END, 0.0) AS accuracy
FROM allrec
GROUP BY GROUPING SETS ((seed, benchmark, language), (seed, benchmark), (seed))"""

ORACLE["e5_accuracy_with_bias"] = E5B

# The white space of Python's ``str.split`` (Unicode), spelled out
# for the regexes above, which are written with the short ``\\s``.
WHITE = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ORACLE = {k: v.replace("[\\s\\S]", "(?s:.)").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
          for k, v in ORACLE.items()}
