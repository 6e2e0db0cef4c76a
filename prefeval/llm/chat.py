"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It
is rendered for every turn prefix: if an output extends the one before it, the
added part is the new turn's span; if not, the template rewrites history. A
turn's text is found inside its span by rendering the prefix with two probe
texts that differ in every character and comparing from both ends. For a
template that rewrites history, spans come from probing each turn in the
whole conversation.

``marked`` is the library's template. It marks turns and escapes its control
strings inside roles and texts; ``unescape`` undoes that exactly.

Edge cases: null roles and texts are empty; turns are taken by (turn, role,
text), so ties and repeated rows have a fixed order and all count; a null
conversation id is a conversation; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import slices

CONTROL = ("<s>", "</s>", "[INST", "[/INST]")
OPEN, AFTER_ROLE, CLOSE = "<s>[INST ", "]\n", "\n[/INST]</s>"
PROBES = ("0", "1")


def escape(text: str) -> str:
    """Double every backslash, then break each control string with a single one."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked(turns: list) -> str:
    return "".join([f"{OPEN}{escape(r)}{AFTER_ROLE}{escape(t)}{CLOSE}" for r, t in turns])


def common_prefix(a: str, b: str) -> int:
    """By halving; every comparison is one memory compare."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def text_place(turns: list, k: int, render) -> tuple[int, int]:
    """(characters before, characters after) turn k's text in the output."""
    x, y = (render([*turns[:k], (turns[k][0], p), *turns[k + 1:]]) for p in PROBES)
    return common_prefix(x, y), common_prefix(x[::-1], y[::-1])


def locate(turns: list, render) -> tuple[str, list, int]:
    """(output, per turn [start, end, text_start, text_end], first turn whose
    rendering changed what stood before it, or -1)."""
    out, spans, rewrites = render([]), [], -1
    for k in range(len(turns)):
        now = render(turns[:k + 1])
        if not now.startswith(out):
            rewrites = k
            break
        before, after = text_place(turns[:k + 1], k, render)
        spans.append([len(out), len(now), before, len(now) - after])
        out = now
    if rewrites >= 0:
        out, spans = render(turns), []
        for k in range(len(turns)):
            before, after = text_place(turns, k, render)
            spans.append([before, len(out) - after, before, len(out) - after])
    return out, spans, rewrites


def format_conversations(turns: DataFrame, render=marked, trained=("assistant",), id_col: str = "conv_id") -> DataFrame:
    """id, formatted text, spans (array of [start, end, text_start, text_end,
    trained]) in code points, and ``rewrites_at`` (-1: history is kept)."""
    src = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    src = src.select(id_col, F.col("turns.role").alias("role"), F.col("turns.text").alias("text"))
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, formatted string, spans array<array<int>>, rewrites_at int"

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    out, spans, at = locate(list(zip(roles, texts)), render)
                    rows.append((out, [[*s, int(r in trained)] for s, r in zip(spans, roles)], at))
                out, spans, at = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(out, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                     pa.array(at, pa.int32())], names=[id_col, "formatted", "spans", "rewrites_at"])

    return src.mapInArrow(run, schema)


def read_back(out: str, spans: list) -> list:
    """(role, text, trained) of each turn, parsed from ``marked`` output."""
    return [(unescape(out[a + len(OPEN):t - len(AFTER_ROLE)]), unescape(out[t:u]), bool(m)) for a, _, t, u, m in spans]


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all
    read back from the formatted texts and their spans."""
    src = formatted.select(id_col, "formatted", "spans", "rewrites_at")
    schema = (f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_turns long, turns_sha256 string, "
              "loss_chars long, loss_sha256 string, formatted_chars long, rewrites_at int")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for out, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    turns = read_back(out, spans)
                    said = "".join([f"{r}\n{t}\n" for r, t, _ in turns]).encode()
                    loss = "".join([t for _, t, m in turns if m])
                    rows.append((len(turns), hashlib.sha256(said).hexdigest(), len(loss),
                                 hashlib.sha256(loss.encode()).hexdigest(), len(out)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)], batch.column(3)],
                    names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
                           "rewrites_at"])

    return src.mapInArrow(run, schema)
