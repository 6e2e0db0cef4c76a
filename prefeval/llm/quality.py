"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic model of
text shape. Every document of the training fold that is not a trusted positive
is unlabelled text; a label 0 is never read, so the model does not vanish where
labels cover the whole table. The class prior of the unlabelled text is
estimated first: a positive-against-unlabelled model ranks held-back
rows of both kinds, and the least ratio of their shares above a cut, with a
margin for chance, is the share of positives among the unlabelled. The final
model minimises the non-negative unbiased risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

Features: frequencies of pairs of character kinds, and how often words and
lines repeat. Text only; training takes at most ``sample`` positives and as
many unlabelled rows, whole texts, picked by a hash of the id.

Edge cases: null text is the empty text and gets a score; null labels and null
ids teach nothing; an id with several labels counts by the largest; an id with
several texts teaches by the text of the least hash; with fewer than four
positives or unlabelled rows every score is 0.5; repeated rows score alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_bytes, fold_of, list_matrix, sample_ids, slices, worker_release

# Character kinds, one string per kind; other ASCII punctuation shares the
# next to last kind, all bytes of non-ASCII letters and marks the last.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".", ",",
         "!?", "|", "#$%&*", "'\"", "()[]{}<>", "=:;", "/\\")
WIDTH = len(KINDS) + 2
SHAPE = 8


def _table() -> bytes:
    kind = [len(KINDS)] * 128 + [len(KINDS) + 1] * 128
    for k, chars in enumerate(KINDS):
        for c in chars:
            kind[ord(c)] = k
    return bytes(kind)


TABLE = _table()


def features(texts: list) -> np.ndarray:
    """One row of features per text (bytes)."""
    out = np.zeros((len(texts), WIDTH * WIDTH + SHAPE))
    for row, text in zip(out, texts):
        kinds = np.frombuffer(text.translate(TABLE), np.uint8).astype(np.int64)
        if len(kinds) > 1:
            pairs = np.bincount(kinds[:-1] * WIDTH + kinds[1:], minlength=WIDTH * WIDTH)
            row[:WIDTH * WIDTH] = np.sqrt(pairs / (len(kinds) - 1))
        words, lines = text.split(), text.splitlines()
        n = max(1, len(words))
        distinct = len(set(words))
        row[WIDTH * WIDTH:] = (
            np.log1p(len(words)) / 10, len(text) / n / 10, 1 - distinct / n,
            np.log1p(n / max(1, distinct)), sum(map(eq, words, words[1:])) / n,
            sum(map(eq, words, words[2:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
            max(map(len, words), default=0) ** 0.5 / 10)
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Logistic:
    """A linear score of standardised features."""

    def __init__(self, mean, scale, weight, bias):
        self.mean, self.scale, self.weight, self.bias = mean, scale, weight, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias


def descend(p, u, gradient, steps: int, rate: float = 0.05, decay: float = 1e-3) -> Logistic:
    """Adam on the whole sample; ``gradient(f_p, f_u)`` gives the risk's slope
    in the scores of positive and unlabelled rows."""
    both = np.vstack([p, u])
    model = Logistic(both.mean(axis=0), both.std(axis=0) + 1e-3, np.zeros(both.shape[1]), 0.0)
    p, u = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (p, u))
    m = v = np.zeros(both.shape[1] + 1)
    for t in range(1, steps + 1):
        g_p, g_u = gradient(p @ model.weight + model.bias, u @ model.weight + model.bias)
        g = np.append(g_p @ p + g_u @ u + decay * model.weight, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        model.weight, model.bias = model.weight - step[:-1], model.bias - step[-1]
    return model


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 200, sure: float = 0.1) -> float:
    """Share of positives among the unlabelled, from held-back halves."""
    def against(f_p, f_u):
        return -sigmoid(-f_p) / len(f_p), sigmoid(f_u) / len(f_u)
    model = descend(p[::2], u[::2], against, steps)
    f_p, f_u = np.sort(model(p[1::2])), np.sort(model(u[1::2]))
    cuts = np.quantile(f_p, np.linspace(0, 0.95, 96))
    over_p = 1 - np.searchsorted(f_p, cuts) / len(f_p)
    over_u = 1 - np.searchsorted(f_u, cuts) / len(f_u)
    margin = np.sqrt(np.log(4 / sure) / 2) * (len(f_p) ** -0.5 + len(f_u) ** -0.5)
    best = np.argmin((over_u + margin) / over_p)
    return float(np.clip(over_u[best] / over_p[best], 0.02, 0.98))


def risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of the scores, with the logistic loss."""
    negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    return float(prior * np.logaddexp(0, -f_p).mean() + max(0.0, negative))


def risk_slope(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the risk in the scores; where the negative part has fallen below
    zero, the slope that lifts it back."""
    negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    as_positive = -prior * sigmoid(-f_p) / len(f_p)
    as_negative_p, as_negative_u = -prior * sigmoid(f_p) / len(f_p), sigmoid(f_u) / len(f_u)
    if negative < 0:
        return -as_negative_p, -as_negative_u
    return as_positive + as_negative_p, as_negative_u


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400) -> Logistic:
    """Minimise the non-negative risk."""
    return descend(p, u, lambda f_p, f_u: risk_slope(f_p, f_u, prior), steps)


def feature_rows(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    def run(batches):
        worker_release()
        for whole in batches:
            for batch in slices(whole):
                x = features(as_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "h", "x"])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(ids, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, h long, x array<double>") \
        .groupBy("doc_id").agg(F.min(F.struct("h", "x"))["x"].alias("x")).toArrow().sort_by("doc_id")
    return list_matrix(found.column("x")).reshape(found.num_rows, WIDTH * WIDTH + SHAPE)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 8000):
    """(model, prior) from documents outside the held-out fold; None without data."""
    known = labels.filter("doc_id is not null AND quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    learn = docs.select("doc_id", "text").filter(fold_of("doc_id", folds) != held)
    positive = known.filter(F.col("quality") == 1)
    trusted = sample_ids(positive.filter(fold_of("doc_id", folds) != held), sample, 17)
    unlabelled = sample_ids(learn.select("doc_id").join(positive, "doc_id", "left_anti"), sample, 17)
    p, u = feature_rows(learn, trusted), feature_rows(learn, unlabelled)
    if len(p) < 4 or len(u) < 4:
        return None, 0.5
    prior = estimate_prior(p, u)
    return fit_pu(p, u, prior), prior


def score(docs: DataFrame, model: Logistic | None, carry: tuple = ()) -> DataFrame:
    """doc_id, ``carry`` columns and score of every row."""
    src = docs.select(F.col("text").alias("_text"), *dict.fromkeys(["doc_id", *carry]))
    names = [f.name for f in src.schema.fields[1:]]

    def run(batches):
        worker_release()
        for whole in batches:
            for batch in slices(whole):
                x = features(as_bytes(batch.column(0)))
                s = sigmoid(model(x)) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, pa.float64())], names=[*names, "score"])

    return src.mapInArrow(run, src.drop("_text").schema.simpleString()[7:-1] + ",score:double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 8000, least: float = 0.3,
             carry: tuple = ()) -> DataFrame:
    """doc_id, ``carry``, held_out, score and predicted (score >= ``least``)."""
    model, _ = train(docs, labels, folds, held, sample)
    return score(docs, model, carry).withColumn("held_out", fold_of("doc_id", folds) == held) \
        .withColumn("predicted", (F.col("score") >= least).cast("int"))
