"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces (those of lower-case letters, and
every single letter). Each language has a probability per piece. A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; a text's is the product over its words. Piece probabilities are
learned by expectation maximisation (forward and backward) over word counts of
at most ``sample`` documents per language, whole texts, picked by a hash of
their id; each round is a Spark job that returns one count per piece.

Scoring reads every whole text. Each distinct word is computed once per worker
while in use, for all languages at once, in numpy over many words.

Edge cases: a null text or one without a letter is ``und`` with score 0; a
null language or id teaches nothing; with no language learned every row is ``und``;
runs of over ``RUN`` letters are scored in parts of that length, and no run
underflows (sums are divided by their maximum as they go); repeated rows
count as often as they stand; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_text, bounded_rows, fold_of, materialize, slices, worker_cache, worker_release

DENSE = 255               # letters of the vocabulary, by use, whose steps are a table; those of rarer ones are searched
RUN = 400
SCALE = 8.0               # per letter, keeps products over short words in range
EVERY = 8                 # letters after which sums are divided by the largest that is still to be used
CACHE_WORDS = 300_000
LATIN = re.compile("[a-zA-ZªµºÀ-ÖØ-öø-ÿ]+").findall
ANY = regex.compile(r"\p{L}+").findall


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    low = text.lower()
    try:
        low.encode("latin-1")
        runs = LATIN(low)
    except UnicodeEncodeError:
        runs = ANY(low)
    if any([len(r) > RUN for r in runs]):
        runs = [r[i:i + RUN] for r in runs for i in range(0, len(r), RUN)]
    return runs


def load_pieces(path: str) -> list[str]:
    """Pieces of lower-case letters, with the word start mark kept."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in found if p.lower() == p and regex.fullmatch(r"▁?\p{L}*", p) and p)


def rescale(sums: np.ndarray) -> np.ndarray:
    """Divides ``sums`` by their maximum over the first axis, in place; returns its log."""
    top = sums.max(axis=0)
    sums /= top
    return np.log(top)


class Lattice:
    """The pieces as a table trie, and forward / backward sums over words."""

    def __init__(self, pieces: list[str]):
        use = Counter(c for p in pieces for c in p)
        letters = [c for c, _ in sorted(use.items(), key=lambda x: (-x[1], x[0]))]
        self.code = {c: k + 1 for k, c in enumerate(letters)}        # 0 is any other letter
        self.pieces = sorted(set(pieces) | set(letters)) + ["￿"]       # the last: any other letter
        step, piece, rare = [np.zeros(DENSE + 1, np.int32)] * 2, [0, 0], {}       # state 0: none, 1: root
        step[1] = step[1].copy()
        for k, p in enumerate(self.pieces):
            at = 1
            for c in p:
                c = self.code.get(c, 0)
                to = step[at][c] if c <= DENSE else rare.get(at * len(use) + c, 0)
                if not to:
                    to = len(step)
                    if c <= DENSE:
                        step[at][c] = to
                    else:
                        rare[at * len(use) + c] = to
                    step.append(np.zeros(DENSE + 1, np.int32))
                    piece.append(0)
                at = to
            piece[at] = k + 1
        self.step, self.piece = np.stack(step), np.array(piece, np.int32)
        # steps by rare letters: sorted keys state * letters + code, closed by one that no step has
        self.keys = np.array([*sorted(rare), np.iinfo(np.int64).max])
        self.after = np.array([*(rare[x] for x in sorted(rare)), 0], np.int32)
        self.depth = max(map(len, self.pieces))

    def matrix(self, words: list[str]) -> np.ndarray:
        """Letter codes, one row per word; all of one length."""
        get = self.code.get
        return np.array([[get(c, 0) for c in "▁" + w] for w in words], np.int32)

    def follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after a letter, 0 where no piece goes on."""
        if code.max() <= DENSE:
            return self.step[state, code]
        far = code > DENSE
        out = self.step[state, np.where(far, 0, code)]
        key = state[far].astype(np.int64) * len(self.code) + code[far]
        at = np.searchsorted(self.keys, key)
        out[far] = np.where(self.keys[at] == key, self.after[at], 0)
        return out

    def matches(self, m: np.ndarray, start: int):
        """(rows, end, pieces) of all pieces from ``start``."""
        rows, state = np.arange(len(m)), np.ones(len(m), np.int32)
        for end in range(start + 1, min(start + self.depth, m.shape[1]) + 1):
            state = self.follow(state, m[rows, end - 1])
            alive = state > 0
            if not alive.all():
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    return
            piece = self.piece[state]
            hit = piece > 0
            if hit.any():
                yield (rows, end, piece) if hit.all() else (rows[hit], end, piece[hit])

    def weights(self, p: np.ndarray) -> np.ndarray:
        """(pieces + 1, languages): probabilities scaled by length, row 0 is no piece."""
        size = np.array([len(x) for x in self.pieces])
        return np.vstack([np.zeros((1, p.shape[1])), p * SCALE ** size[:, None]])

    def forward(self, m: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of every beginning, and the logs of what they were divided by."""
        alpha = np.zeros((m.shape[1] + 1, len(m), w.shape[1]))
        shift = np.zeros_like(alpha)
        alpha[0] = 1.0
        for start in range(m.shape[1]):
            if start and start % EVERY == 0:
                shift[start:] += rescale(alpha[start:start + self.depth])
            for rows, end, piece in self.matches(m, start):
                alpha[end, rows] += alpha[start, rows] * w[piece]
        return alpha, shift

    def log_probability(self, words: list[str], w: np.ndarray) -> np.ndarray:
        """(words, languages): log of the sum over all segmentations."""
        out = np.empty((len(words), w.shape[1]))
        by = np.array([len(x) for x in words])
        for n in np.unique(by):
            every = np.flatnonzero(by == n)
            for at in np.array_split(every, -(-len(every) * (n + 1) // 400_000)):
                m = self.matrix([words[i] for i in at])
                alpha, shift = self.forward(m, w)
                out[at] = np.log(alpha[-1]) + shift[-1] - (n + 1) * np.log(SCALE)
        return out

    def expected(self, words: list[str], counts: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (w: one language)."""
        total = np.zeros(len(w))
        by = np.array([len(x) for x in words])
        for n in np.unique(by):
            every = np.flatnonzero(by == n)
            for at in np.array_split(every, -(-len(every) * (n + 1) // 400_000)):
                m = self.matrix([words[i] for i in at])
                alpha, shift = (x[:, :, 0] for x in self.forward(m, w))
                whole = np.log(alpha[-1]) + shift[-1]
                beta, back = np.zeros_like(alpha), 0.0       # back: log of what the betas in use were divided by
                beta[-1] = 1.0
                for start in range(m.shape[1] - 1, -1, -1):
                    if (m.shape[1] - start) % EVERY == 0:
                        back = back + rescale(beta[start + 1:start + 1 + self.depth])
                    share = counts[at] * np.exp(np.minimum(shift[start] + back - whole, 700.0))
                    for rows, end, piece in self.matches(m, start):
                        through = w[piece, 0] * beta[end, rows]
                        beta[start, rows] += through
                        total += np.bincount(piece, alpha[start, rows] * through * share[rows], len(w))
        return total


def fit(labelled: DataFrame, pieces_path: str, sample: int = 400, rounds: int = 3, prior: float = 300.0,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(languages, piece probabilities) from rows with a language."""
    rows = bounded_rows(labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()),
                        id_col, lang_col, sample)

    def split(batches):
        worker_release()
        for b in batches:
            for part in slices(b):
                counts: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), as_text(part.column(1))):
                    counts.update([(lang, r) for r in letter_runs(text)])
                if counts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                         pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    words = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")) \
        .mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "lang-words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    lattice = Lattice(load_pieces(pieces_path))
    p = np.full((len(lattice.pieces), len(langs)), 1.0 / len(lattice.pieces))

    def expect(batches):
        # the lattice is rebuilt from the vocabulary file, the weights travel with the task
        lat = worker_cache("lattice " + pieces_path, lambda: Lattice(load_pieces(pieces_path)))
        totals: dict = {}
        for b in batches:
            lang, word, n = (b.column(i).to_pylist() for i in range(3))
            for k in set(lang):
                at = [i for i, x in enumerate(lang) if x == k]
                w = lat.weights(p[:, [langs.index(k)]])
                totals[k] = totals.get(k, 0) + lat.expected([word[i] for i in at], np.array([n[i] for i in at], float), w)
        for k, t in totals.items():
            used = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.string()), pa.array(used, pa.int32()),
                                              pa.array(t[used], pa.float64())], names=["lang", "piece", "n"])

    for _ in range(rounds if langs else 0):
        found = words.mapInArrow(expect, "lang string, piece int, n double") \
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros_like(p)
        for r in found:
            counts[r.piece - 1, langs.index(r.lang)] += r.n
        common = counts.sum(axis=1) + 1e-3
        common = common / common.sum()
        p = (counts + prior * common[:, None]) / (counts.sum(axis=0) + prior)
    return langs, p


def predict(docs: DataFrame, langs: list, p: np.ndarray, pieces_path: str, carry: tuple = (),
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``carry`` columns, lang_pred and score of every row."""
    src = docs.select(F.col(text_col).alias("_text"), *dict.fromkeys([id_col, *carry]))
    kept = [f.name for f in src.schema.fields[1:]]
    schema = src.drop("_text").schema.simpleString()[7:-1] + ",lang_pred:string,score:double"
    model = docs.sparkSession.sparkContext.broadcast(p)
    version = hash((tuple(langs), p.tobytes()))

    def make():
        lat = Lattice(load_pieces(pieces_path))
        return lat, lat.weights(model.value)

    def run(batches):
        lat, w = worker_cache(f"language weights {version}", make)
        known: dict[str, int] = {}
        table = np.empty((CACHE_WORDS, len(langs)))
        for whole in batches:
            for batch in slices(whole):
                runs = [letter_runs(t) for t in as_text(batch.column(0))] if langs else [[]] * batch.num_rows
                new = list(set().union(*runs).difference(known))
                if len(known) + len(new) > len(table):
                    known.clear()
                    new = list(set().union(*runs))
                    if len(new) > len(table):
                        table = np.empty((len(new), len(langs)))
                if new:
                    table[len(known):len(known) + len(new)] = lat.log_probability(new, w)
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                pred, score = [], []
                for r in runs:
                    if not r:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = table[[known[x] for x in r]].sum(axis=0)
                    total = np.exp(total - total.max())
                    pred.append(langs[int(total.argmax())])
                    score.append(float(total.max() / total.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*kept, "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def identify(docs: DataFrame, pieces_path: str, folds: int = 3, held: int = 1, sample: int = 400,
             carry: tuple = ()) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all."""
    langs, p = fit(docs.filter(fold_of("doc_id", folds) != held), pieces_path, sample)
    return predict(docs, langs, p, pieces_path, carry)
