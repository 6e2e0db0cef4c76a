import hashlib
import re

import pytest
from pyspark.sql import functions as F

from prefeval.llm.fim import digests, fill_in_middle, parts, restore, split_output

TEXTS = ["", None, "one line", "a\n", "a\nb\n\n\nc", "\n\n\n", "x\r\ny z\u0085w\n\U0001f600\U0001f600\nend", "holds <P> it\nb",
         "<S", "almost <M\n>\nS>", "$1 \\1 $name {2}\n\\E\\Q\n$0", "long " * 30_000, "line\n" * 60_000, "tie\n" * 2, "tie\n" * 2]


def plain(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (100, 100)])
def test_against_plain_version(spark, rate, spm):
    rows = [(1000 * k + i, t, "clash") for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc\n", "x"), (5, "a\nb", "y"), (5, "a\nb", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    formed = fill_in_middle(df, rate=rate, spm=spm)
    cut = parts(split_output())
    got = formed.select("doc_id", "n", "form", F.length(cut["prefix"]), F.length(cut["middle"]), "output",
                        restore().alias("back"), "text").collect()
    want = sorted(str((k, *plain(k, t, rate=rate, spm=spm), t or "")) for k, t, _ in rows)
    assert sorted(str((*r[:6], r.back)) for r in got) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashed = []
    for k, t, _ in rows:
        p = plain(k, t, rate=rate, spm=spm)
        hashed.append(str((k, *p[:4], sha(p[4]), sha(t or ""))))
    assert sorted(str(tuple(r)) for r in digests(formed).collect()) == sorted(hashed)


def test_other_units_and_markers(spark):
    """Words as units, markers with regex characters; columns carried along."""
    df = spark.createDataFrame([(k, "ab cd  ef gh", k) for k in range(50)], "doc_id long, text string, extra long")
    marks = ("[pre]$1", "\\suf|", "(mid)")
    got = fill_in_middle(df, unit=r"[^ ]++ ++|[^ ]++", markers=marks, carry=("extra",)) \
        .withColumn("back", restore(markers=marks)).collect()
    assert {r.n for r in got} == {4} and all(r.back == r.text and r.extra == r.doc_id for r in got)
    assert all(r.output.startswith(marks[1] if r.form == "spm" else marks[0]) for r in got)
    with pytest.raises(ValueError, match="clash"):
        fill_in_middle(df, carry=("n",))


def test_empty_table(spark):
    assert digests(fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = digests(fill_in_middle(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
