"""Fill-in-the-middle transformation by one counted-quantifier match per row.

A text is a run of units (by default lines with their ends). ``regexp_count``
gives their number n; two hash draws cut it after a and b units. Each row gets
its own pattern ``(unit{a}+)(unit{b-a}+)(.*)``, anchored at both ends, whose
three groups are prefix, middle and suffix, and its own replacement, so that
one match rewrites the text to its output form. The quantifiers are
possessive: Java runs them as a loop without a stack frame or a way back per
unit, so a text of any number of units is matched in linear time.

Forms: ``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P prefix M
middle, ``plain`` is the text itself. A text that holds a marker stays plain,
so an output can be split at its markers and the text rebuilt from it alone.

Everything is a column expression: no shuffle, no Python, nothing kept.

Edge cases: a null text is the empty text, and the empty text is plain; a null
id draws as the empty id; every row is transformed by itself, so repeated rows
give equal rows; an empty table gives no rows; of the other columns only those
named in ``carry`` are kept, and their names may not be those of the result
(ValueError).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"[^\n]*+\n|[^\n]++"
MARKERS = ("<P>", "<S>", "<M>")
RESULT = ("doc_id", "text", "n", "form", "output")


def draws(id_col, seed: int) -> list[Column]:
    """h1 to h4: unsigned 32-bit integers out of the sha256 of ``seed:id``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = LINE, rate: int = 100, spm: int = 50,
                   markers: tuple = MARKERS, id_col: str = "doc_id", text_col: str = "text",
                   carry: tuple = ()) -> DataFrame:
    """doc_id, text (null: empty), n, form, output of every row.

    ``unit`` is a regular expression that never matches the empty text and cuts
    every text without a rest; ``rate`` per cent of the texts are transformed,
    ``spm`` per cent of those with the suffix first."""
    if clash := set(carry) & {*RESULT, "_a", "_b", "_h3", "_h4"}:
        raise ValueError(f"carried columns clash with the result: {sorted(clash)}")
    p, s, m = markers
    h1, h2, h3, h4 = draws(id_col, seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       h1.alias("_a"), h2.alias("_b"), h3.alias("_h3"), h4.alias("_h4"), *carry)
    n = F.regexp_count("text", F.lit(unit)).cast("long")
    holds = F.lit(False)
    for mark in markers:
        holds = holds | F.contains("text", F.lit(mark))
    form = F.when((F.length("text") == 0) | holds | (F.col("_h3") % 100 >= rate), "plain") \
        .when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("n", n)
    one, two = F.col("_a") % (F.col("n") + 1), F.col("_b") % (F.col("n") + 1)
    rows = rows.withColumns({"form": form, "_a": F.least(one, two), "_b": F.greatest(one, two)})
    group = f"((?:{unit}){{"
    pattern = F.concat(F.lit(r"(?s)\A" + group), F.col("_a").cast("string"),
                       F.lit("}+)" + group), (F.col("_b") - F.col("_a")).cast("string"), F.lit(r"}+)(.*)\z"))
    quote = [re.sub(r"([\\$])", r"\\\1", mark) for mark in markers]
    replacement = F.when(F.col("form") == "spm", F.lit(f"{quote[1]}$3{quote[0]}$1{quote[2]}$2")) \
        .otherwise(F.lit(f"{quote[0]}$1{quote[1]}$3{quote[2]}$2"))
    output = F.when(F.col("form") == "plain", F.col("text")) \
        .otherwise(F.regexp_replace("text", pattern, replacement))
    return rows.withColumn("output", output).select(*RESULT, *carry)


def split_output(output="output", markers: tuple = MARKERS) -> Column:
    """An output cut at its markers: an empty text, then the three pieces."""
    return F.split(output, "|".join(re.escape(mark) for mark in markers), -1)


def parts(cut: Column, form="form") -> dict[str, Column]:
    """prefix, middle, suffix (null if plain) out of ``split_output``."""
    form = F.col(form) if isinstance(form, str) else form
    whole = form != "plain"
    at = lambda psm, spm: F.when(whole, F.when(form == "spm", F.get(cut, F.lit(spm))).otherwise(F.get(cut, F.lit(psm))))
    return {"prefix": at(1, 2), "middle": at(3, 3), "suffix": at(2, 1)}


def restore(output="output", form="form", markers: tuple = MARKERS) -> Column:
    """The text that an output of this form was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    found = parts(split_output(output, markers), form)
    return F.when(form == "plain", output).otherwise(F.concat(found["prefix"], found["middle"], found["suffix"]))


def digests(formed: DataFrame, markers: tuple = MARKERS) -> DataFrame:
    """Counts and digests of ``fill_in_middle``'s rows, read from the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    held = formed.select("doc_id", "n", "form", "output", split_output(markers=markers).alias("cut"))
    held = held.select("doc_id", "n", "form", "output", *[c.alias(k) for k, c in parts(F.col("cut")).items()])
    rebuilt = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix"))
    return held.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
                       F.length("middle").cast("long").alias("middle_chars"),
                       sha(F.col("output")).alias("output_sha256"), sha(rebuilt).alias("restored_sha256"))
