"""Byte-pair encoding by an automaton compiled from the merge list.

The automaton starts as one state with a loop per byte token. Each merge
(u, v), in rank order, applies one gadget: the state after u loses its arc v,
and every state that has an arc u gets an arc uv into the (former) state after
v. A word's encoding is the one path from the start whose arc labels spell it.

State after a token depends on the token alone, so states are named by tokens.
Instead of copying arc lists, the compiled form keeps what each gadget did
(``left``, ``right``, ``born`` per token; the removed arc per pair); an arc is
resolved once by following the gadgets back and then stays in the transition
table. Decoding emits the labels of the arcs.

Edge cases: null text is the empty text and gives no ids; control tokens of the
vocabulary found in a text become their own id, as in the tokenizers library;
repeated rows are coded each by itself; an empty table gives no rows; other
columns, whatever their names, are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_text, no_cycles, slices, worker_cache

TABLE_ARCS = 2_000_000
CACHE_WORDS = 350_000
LONG_WORD = 64
# Fixed value: the pre-split pattern of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks whose letters and digits are the same in every Unicode version in use;
# a text with anything else is pre-split by the library.
SETTLED = regex.compile("[\t-\r\x20-ɏΑ-ΡΣ-ϿА-я‐-‧‰-⁞€™]*")


def byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary file: itself
    if it is a printable Latin-1 character, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """Deterministic automaton over tokens, with a trie of their bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.label = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.emit = self.label | {i: t.encode() for t, i in self.special.items()}
        self.token = {b: i for i, b in self.label.items()}
        self.left, self.right, self.born, self.removed = {}, {}, {}, {}
        for rank, (u, v) in enumerate(spec["model"]["merges"]):
            self.gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.longest = max(map(len, self.token))
        self.table: dict[tuple[int, int], bool] = {}

    def gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        self.removed[u, v] = rank
        self.left[uv], self.right[uv], self.born[uv] = u, v, rank

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc ``token`` after ``state``."""
        known = self.table.get((state, token))
        if known is None:
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
            known = self.table[state, token] = self._resolve(state, token)
        return known

    def _resolve(self, a: int, b: int) -> bool:
        """Follow the gadgets back in time: the younger of the two tokens got
        its arcs from its left part (as a label) or right part (as a state)
        when it was born; an arc is gone if its removal came before that."""
        until = len(self.removed)
        while True:
            if self.removed.get((a, b), until) < until:
                return False
            old_a, old_b = self.born.get(a, -1), self.born.get(b, -1)
            if old_a < 0 and old_b < 0:
                return True
            if old_b >= old_a:
                # the merge that bore b also removed its own arc: count it
                until, b = old_b + 1, self.left[b]
            else:
                until, a = old_a, self.right[a]

    def encode(self, word: bytes) -> list[int]:
        """The path spelling ``word``: at each place the longest token whose
        arc exists, going back when a state has no way on. A state that
        failed at a place is marked, so the work is linear in the word."""
        n, path, ends, state, at, size = len(word), [], [], None, 0, self.longest
        dead = set()
        token, longest, arc = self.token, self.longest, self.arc
        while at < n:
            for k in range(min(size, n - at), 0, -1):
                t = token.get(word[at:at + k])
                if t is not None and (state is None or arc(state, t)) and (at + k, t) not in dead:
                    path.append(t)
                    ends.append(k)
                    state, at, size = t, at + k, longest
                    break
            else:
                dead.add((at, path.pop()))
                k = ends.pop()
                at, size = at - k, k - 1
                state = path[-1] if path else None
        return path

    def decode(self, ids) -> bytes:
        return b"".join([self.emit[i] for i in ids])


class Words(dict):
    """word -> (decimal ids each followed by a comma, number of ids, bytes
    emitted), each encoded once while in use: when full, words not met since
    the last time are forgotten."""

    def __init__(self, auto: MergeAutomaton):
        self.auto, self.older = auto, {}

    def __missing__(self, word: str) -> tuple:
        made = self.older.get(word)
        if made is None:
            ids = self.auto.encode(word.encode())
            made = ("".join([f"{i}," for i in ids]), len(ids), self.auto.decode(ids))
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made


class Coder:
    """Texts to ids: control tokens, pre-split, automaton per distinct word."""

    def __init__(self, path: str):
        self.auto = MergeAutomaton(path)
        self.words = regex.compile(SPLIT).findall
        self.control = regex.compile("(" + "|".join(map(regex.escape, self.auto.special)) + ")") \
            if self.auto.special else None
        self.known = Words(self.auto)
        self.library = None

    def pre_split(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.words(text)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel
            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[tuple]:
        out, known = [], self.known
        for k, run in enumerate(self.control.split(text) if self.control else [text]):
            if k % 2:
                i = self.auto.special[run]
                out.append((f"{i},", 1, self.auto.emit[i]))
            elif run:
                out += [known[w] for w in self.pre_split(run)]
        return out

    def ids(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0][:-1].split(",") if i]

    def digest(self, text: str) -> tuple[int, str, str]:
        parts = self.parts(text)
        ids = "".join([p[0] for p in parts])[:-1]
        raw = b"".join([p[2] for p in parts])
        return (sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) and the decoded text of every row."""
    return _mapped(docs, path, id_col, text_col, "ids array<int>, decoded string",
                   lambda coder, t: (i := coder.ids(t), coder.auto.decode(i).decode("utf-8", "replace")))


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda coder, t: coder.digest(t))


def _mapped(docs, path, id_col, text_col, columns, of):
    src = docs.select(F.col(id_col), F.col(text_col))
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, {columns}"
    kinds = [pa.list_(pa.int32()), pa.string()] if "array" in columns else [pa.int64(), pa.string(), pa.string()]
    names = [id_col, *[c.split()[0] for c in columns.split(", ")]]

    def run(batches):
        coder = worker_cache("bpe " + path, lambda: Coder(path))
        with no_cycles():
            for whole in batches:
                for batch in slices(whole):
                    rows = list(zip(*[of(coder, t) for t in as_text(batch.column(1))]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), *[pa.array(c, k) for c, k in zip(rows, kinds)]], names=names)

    return src.mapInArrow(run, schema)
