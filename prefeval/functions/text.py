"""Column-level text helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The characters Python's ``str.strip`` / ``split`` and Unicode
# ``\s`` take as white space (Java's plain ``\s`` knows only the ASCII ones).
WS_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_IN = "".join(f"\\x{{{a:x}}}" if a == z else f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in WS_RANGES)
WS, NON_WS = f"[{_IN}]", f"[^{_IN}]"
WS_CHARS = [chr(k) for a, z in WS_RANGES for k in range(a, z + 1)]


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(c(col), f"^{WS}+|{WS}+$", "")


def no_space(col) -> Column:
    return F.regexp_replace(c(col), WS, "")


def strip_chars(col, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a literal set of characters."""
    cls = "".join("\\" + ch if ch in "\\^]-[" else ch for ch in chars)
    cls = cls.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return F.regexp_replace(c(col), f"^[{cls}]+|[{cls}]+$", "")


def words(col) -> Column:
    """Whitespace tokens (Python ``str.split()`` for the regex whitespace
    set): every run of non-whitespace, found by one regex scan - no blank
    ends to filter, no per-token lambda."""
    # runs of printable ASCII take one range test a character, the rest the full class
    return F.regexp_extract_all(c(col), F.lit(f"(?:[!-~]++|{NON_WS})++"), 0)


def squeeze(col) -> Column:
    """Collapse every whitespace run to one space."""
    return F.regexp_replace(c(col), WS + "+", " ")


def repeat_for(value, arr) -> Column:
    """``value`` repeated once per element of ``arr``.

    Zipping an array with this lets a lambda read an outer value without
    naming the outer expression inside the lambda: Catalyst inlines outer
    columns into lambda bodies, where they would be re-evaluated per element."""
    return F.array_repeat(c(value), F.size(c(arr)))


def count_below(edges: list, v) -> Column:
    """Number of literal edges strictly below v (v evaluated once)."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    flags = F.zip_with(e, F.array_repeat(c(v), len(edges)), lambda x, y: (x < y).cast("int"))
    return F.aggregate(flags, F.lit(0), lambda a, b: a + b)
