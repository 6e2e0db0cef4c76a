"""Secret scan: fixed patterns, widened by a linear-chain conditional random field.

Base spans come from three patterns (assignments, access keys, long hex runs).
A random field tags every token of a text as secret begin (B), inside (I) or
outside (O) from the token's shape, its neighbours and features of the whole
file; tagged spans that touch no base span are added as kind ``crf``. It is
trained on the base spans as noisy labels, over windows of at most ``sample``
documents picked by a hash of the id: every window around a base span (up to
``PER_DOC`` a document) and one other window of every eighth document.

Decoding is exact Viterbi over whole texts. A token whose outside score leads
by more than any change of its two transitions could win back is outside in
every best path, so only the stretches between such tokens need the recursion.

Edge cases: null text is the empty text with no spans; positions are code
points, ends exclusive; repeated rows are scanned each by itself; without any
base span in the sample nothing is added; an empty table gives no rows; other
columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_text, no_cycles, sample_ids, slices, worker_cache

KINDS = ("assign", "access", "hex", "crf")
# Base patterns, the group that holds the secret, its least length.
BASE = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    (re.compile("[0-9a-f]+"), 0, 32),
)
LONG_HEX = re.compile("[0-9a-f]{32}")
HEX_ONLY = re.compile("[0-9a-fA-F]+").fullmatch
MARKS = set("+/=-._")
TOKEN = re.compile(r"\w+|[^\w\s]")
NAMES = {"password", "passwd", "pwd", "secret", "token", "api", "apikey", "api_key", "key", "auth", "bearer",
         "credential", "credentials", "access", "private"}
OWN, NEAR, FILE = 22, 10, 4
CACHE_TOKENS = 300_000
PER_DOC = 8
SIDE = 20
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself), by start, then kind."""
    out = []
    for kind, (pattern, group, least) in enumerate(BASE):
        # what a match needs at least, found faster than by its pattern
        if not ("=" in text or ":" in text, "AKIA" in text, LONG_HEX.search(text))[kind]:
            continue
        out += [(m.start(), kind, m.end(), m.start(group)) for m in pattern.finditer(text)
                if m.end(group) - m.start(group) >= least]
    return sorted(out)


def kind_of(token: str):
    """Tokens of one kind have the same features: plain words up to 15 letters
    by length, case and alphabet; any other token is its own kind."""
    if len(token) < 16 and token.isalpha() and token.lower() not in NAMES:
        return (len(token), token.islower(), token.isupper(), token.isascii(), HEX_ONLY(token) is not None)
    return token


def shape(token: str) -> tuple[list, list]:
    """(own features, features as a neighbour) of a token. How letters mix
    (turns, entropy) is measured where digits occur or from 16 characters on."""
    n = len(token)
    digits = sum(map(str.isdigit, token))
    lower, upper = token.islower(), token.isupper()
    letters = digits < n and any(map(str.isalpha, token))
    turns = entropy = 0.0
    if digits or n >= 16:
        turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(token, token[1:])) / max(1, n - 1)
        entropy = -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))
    word = token[0].isalnum() or token[0] == "_"
    hexa = HEX_ONLY(token) is not None
    own = [1.0, word, n <= 3, 4 <= n <= 7, 8 <= n <= 15, 16 <= n <= 31, n >= 32, digits > 0, digits == n,
           letters and not lower and not upper, upper and digits > 0, lower and not digits, upper and not digits,
           digits > 0 and letters, hexa, hexa and n >= 16, turns, entropy / 4, entropy > 3.2,
           not token.isascii(), token in MARKS, not word]
    near = [1.0, token.lower() in NAMES, token == "=", token == ":", token in "\"'", not word, token in MARKS,
            digits > 0 and letters and n >= 8, n >= 16, word and lower and not digits]
    return own, near


def file_features(tokens: list[str], spans: int) -> np.ndarray:
    n = max(1, len(tokens))
    return np.array([np.log1p(spans) / 3, tokens.count("=") / n * 10,
                     sum(map(tokens.count, "{};")) / n * 10, np.log1p(n) / 10])


class Field:
    """Weights: own and neighbour features per tag, file features, transitions."""

    SIZES = (OWN * 3, NEAR * 3, NEAR * 3, NEAR * 3, FILE * 3, 9)

    def __init__(self, flat: np.ndarray):
        cut = np.split(flat, np.cumsum(self.SIZES)[:-1])
        self.own, self.prev, self.prev2, self.next = (c.reshape(-1, 3) for c in cut[:4])
        self.file, self.move = cut[4].reshape(-1, 3), cut[5].reshape(3, 3)
        # the most that outside can lose in its two transitions to another tag
        into, out_of = self.move - self.move[:, [O]], self.move - self.move[[O]]
        self.most = max(max(0.0, into[:, x].max()) + max(0.0, out_of[x].max()) for x in (B, I)) + 1e-9

    def tables(self, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Per token the score parts (own, as previous, as last but one, as next)."""
        return np.concatenate([own @ self.own, near @ self.prev, near @ self.prev2, near @ self.next], axis=1)

    def emissions(self, parts: np.ndarray, file: np.ndarray) -> np.ndarray:
        e = parts[:, :3] + file @ self.file
        e[1:] += parts[:-1, 3:6]
        e[2:] += parts[:-2, 6:9]
        e[:-1] += parts[1:, 9:12]
        return e

    def viterbi(self, e: np.ndarray, before: int = -1, after: int = -1) -> list[int]:
        """Best tags; ``before`` and ``after`` are the known tags around, if any."""
        best = e[0] + (self.move[before] if before >= 0 else 0)
        back = []
        for row in e[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        if after >= 0:
            best = best + self.move[:, after]
        tags = [int(best.argmax())]
        for pointers in reversed(back):
            tags.append(int(pointers[tags[-1]]))
        return tags[::-1]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi over the whole sequence, run only where it can matter."""
        tags = np.zeros(len(e), np.int8)
        open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.most)
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                a, z = run[0], run[-1] + 1
                tags[a:z] = self.viterbi(e[a:z], O if a else -1, O if z < len(e) else -1)
        return tags


def windows_of(text: str, doc: int) -> list[tuple[list, list, list]]:
    """Training windows (tokens, tags, file features) of one text."""
    found = list(TOKEN.finditer(text))
    if not found:
        return []
    tokens = [m[0] for m in found]
    spans = base_spans(text)
    tags = [O] * len(tokens)
    starts = np.array([m.start() for m in found])
    centres = []
    for _, _, end, secret in spans:
        a, z = np.searchsorted(starts, [secret, end])
        if a < z and tags[a] == O:
            tags[a:z] = [B] + [I] * (z - a - 1)
            centres.append(int(a))
    if doc % 8 == 0:
        centres.append(doc // 8 % len(tokens))
    file = file_features(tokens, len(spans)).tolist()
    return [(tokens[max(0, c - SIDE):c + SIDE], tags[max(0, c - SIDE):c + SIDE], file) for c in centres[:PER_DOC]]


def train_field(windows: list, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximise the conditional likelihood by Adam; forward and backward sums
    run over all windows at once."""
    n, length = len(windows), max(len(w[0]) for w in windows)
    cache = {t: shape(t) for w in windows for t in w[0]}
    own, near = np.zeros((n, length, OWN)), np.zeros((n, length + 3, NEAR))   # near: two before, one after
    tags, real = np.zeros((n, length), int), np.zeros((n, length), bool)
    file = np.array([w[2] for w in windows])
    for i, (tokens, marks, _) in enumerate(windows):
        own[i, :len(tokens)] = [cache[t][0] for t in tokens]
        near[i, 2:2 + len(tokens)] = [cache[t][1] for t in tokens]
        tags[i, :len(tokens)], real[i, :len(tokens)] = marks, True
    x = np.concatenate([own, near[:, 1:-2], near[:, :-3], near[:, 3:], np.repeat(file[:, None], length, axis=1)], axis=2)
    x[~real] = 0
    flat_x = x.reshape(n * length, -1)
    gold = np.eye(3)[tags] * real[:, :, None]
    moves = real[:, 1:]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    width = x.shape[2]
    flat = np.zeros(width * 3 + 9)
    m = v = np.zeros_like(flat)
    for t in range(1, steps + 1):
        w, move = flat[:-9].reshape(width, 3), flat[-9:].reshape(3, 3)
        e = (flat_x @ w).reshape(n, length, 3)
        lse = lambda s, axis: np.log(np.exp(s - s.max(axis=axis, keepdims=True)).sum(axis=axis)) + s.max(axis=axis)
        fwd, bwd = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        fwd[:, 0] = e[:, 0]
        for k in range(1, length):
            step = lse(fwd[:, k - 1, :, None] + move, 1) + e[:, k]
            fwd[:, k] = np.where(real[:, k, None], step, fwd[:, k - 1])
        for k in range(length - 2, -1, -1):
            step = lse(move + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
            bwd[:, k] = np.where(real[:, k + 1, None], step, 0)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        g_move = (pair * moves[:, :, None, None]).sum(axis=(0, 1)) - gold_moves
        g = np.append((flat_x.T @ (p - gold).reshape(-1, 3)).ravel(), g_move.ravel()) / n + decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Field(flat)


def train(docs: DataFrame, sample: int = 20_000) -> Field | None:
    """A field from a bounded sample of documents; None without a base span."""
    ids = sample_ids(docs, sample, 23)
    number = F.xxhash64(F.col("doc_id"), F.lit(29)).bitwiseAND(F.lit((1 << 40) - 1))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                got = [w for k, t in zip(batch.column(0).to_pylist(), as_text(batch.column(1))) for w in windows_of(t, k)]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w[0] for w in got], pa.list_(pa.string())), pa.array([w[1] for w in got], pa.list_(pa.int32())),
                         pa.array([w[2] for w in got], pa.list_(pa.float64()))], names=["tokens", "tags", "file"])

    rows = docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"]) \
        .select(number.alias("number"), "text").mapInArrow(run, "tokens array<string>, tags array<int>, file array<double>")
    windows = sorted((tuple(r.tokens), tuple(r.tags), tuple(r.file)) for r in rows.collect())
    return train_field(windows) if any(B in w[1] for w in windows) else None


class Parts:
    """Score parts of distinct tokens, as rows of one growing matrix."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self):
        self.rows: dict = {}          # token -> row of the table
        self.kinds: dict = {}         # kind -> row
        self.table = np.empty((4096, 12))

    def of(self, tokens: list) -> np.ndarray:
        new = set(tokens).difference(self.rows)
        if new:
            if len(self.rows) + len(new) > CACHE_TOKENS and self.rows:
                self.clear()
                new = set(tokens)
            kinds = {t: kind_of(t) for t in new}
            first = {k: t for t, k in kinds.items() if k not in self.kinds}
            at = len(self.kinds)
            while at + len(first) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            if first:
                own, near = (np.array(f, float) for f in zip(*map(shape, first.values())))
                self.table[at:at + len(first)] = self.field.tables(own, near)
                self.kinds.update(zip(first, range(at, at + len(first))))
            self.rows.update({t: self.kinds[k] for t, k in kinds.items()})
        return self.table[[self.rows[t] for t in tokens]]


def field_spans(text: str, spans: list, parts: Parts, least: int) -> list[tuple[int, int, int, int]]:
    """Tagged spans of ``least`` characters or more that touch no base span."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    tags = parts.field.decode(parts.field.emissions(parts.of(tokens), file_features(tokens, len(spans))))
    if not tags.any():
        return []
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    out = []
    for i in np.flatnonzero(tags):
        start, end = places[i]
        if tags[i] == I and i and tags[i - 1] != O and out:
            out[-1] = (out[-1][0], 3, end, out[-1][0])
        else:
            out.append((start, 3, end, start))
    return [s for s in out if s[2] - s[0] >= least and not any(s[0] < b[2] and b[0] < s[2] for b in spans)]


def mapped(docs: DataFrame, field: Field | None, carry: list, least: int, columns: str, of) -> DataFrame:
    """``carry`` columns and what ``of`` makes of each text and its spans (all
    in one pass: a second Python step would need a second set of workers)."""
    src = docs.select(F.col("text").alias("_text"), *dict.fromkeys(carry))
    model = docs.sparkSession.sparkContext.broadcast(field)
    version = zlib.crc32(np.concatenate([field.own.ravel(), field.move.ravel()]).tobytes()) if field else 0

    def run(batches):
        parts = worker_cache(f"secret parts {version}", lambda: Parts(model.value) if model.value else None)
        with no_cycles():
            for whole in batches:
                for batch in slices(whole):
                    rows = []
                    for text in batch.column(0).to_pylist():
                        spans = base_spans(text or "")
                        if parts:
                            spans = sorted(spans + field_spans(text or "", spans, parts, least))
                        rows.append((text, spans))
                    yield of(batch, rows)

    fields = src.drop("_text").schema.simpleString()[7:-1]
    return src.mapInArrow(run, ",".join([f for f in (fields, columns) if f]))


def scan(docs: DataFrame, field: Field | None, least: int = 8, carry: tuple = ("doc_id",)) -> DataFrame:
    """``carry`` columns and the text's spans (kind, start, end), by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(batch, rows):
        spans = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z, _ in s] for _, s in rows]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, kind)], names=[*batch.schema.names[1:], "spans"])

    return mapped(docs, field, list(carry), least, "spans:array<struct<kind:string,start:bigint,end:bigint>>", listed)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans and all spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                          joined(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list, mark: str) -> str:
    """The text with every span (overlaps taken together) replaced."""
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, field: Field | None, mark: str = "[secret]", least: int = 8) -> DataFrame:
    """The table with every span of its texts replaced by ``mark``, and n_chars
    counted anew where it exists."""
    names = docs.columns
    rest = [n for n in names if n != "text"]

    def replaced(batch, rows):
        texts = [t if t is None else redacted(t, s, mark) for t, s in rows]
        held = dict(zip(batch.schema.names, batch.columns))
        if "n_chars" in held:
            held["n_chars"] = pa.array([len(t or "") for t in texts], held["n_chars"].type)
        return pa.RecordBatch.from_arrays([*[held[n] for n in rest], pa.array(texts, pa.string())], names=[*rest, "text"])

    return mapped(docs, field, rest, least, "text:string", replaced).select(*names)
