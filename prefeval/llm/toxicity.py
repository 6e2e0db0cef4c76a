"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over every word and word beginning of the labelled
examples; no term is chosen by label or frequency. Document frequencies come
from all documents. At most ``sample`` labelled rows per class, whole texts,
picked by a hash of the id, form the index. The ``k`` nearest examples are by
exact cosine: terms of few examples are added up from their postings; the
``COMMON`` terms of most examples are held densely in blocks of ``BLOCK``
examples with the largest weight per block and term, and a block is left out
when that bound proves that none of its examples can be among the nearest.
These sums are in single precision; every example that their largest possible
error (``SLACK``) leaves among the nearest is compared anew in double precision.
Each worker builds the index from the examples' terms and counts; the driver
holds those alone. Votes weighted by closeness give a raw score, which a logistic curve fitted on
the examples (each one searched without itself) turns into a probability. The
nearest examples are returned as evidence.

Edge cases: null text is the empty text; a text without a term of the
examples gets the calibrated score of no evidence; null labels and ids teach
nothing; an id with several labels counts by the largest; without both classes
every score is the share of toxic labels (0 without any); ties go to the
smaller example id; labelled copies of one text are one example; repeated
rows score alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_text, fold_of, give_back, materialize, sample_ids, slices, worker_cache

BLOCK = 64
LINE = 8                  # postings per line; those of a term fill whole lines
COMMON = 1024             # terms held densely
TOGETHER = 128            # texts searched at a time
ROWS, TEXT = 512, 1 << 21  # texts, and bytes of them, counted at a time
# Largest error of a cosine in single precision: COMMON rounded sums of weights rounded twice, 2**-24 each
SLACK = (COMMON + 16) * 2.0 ** -24
TINY = 2.0 ** -126         # the least of a cosine above 0 in single precision
CACHE_WORDS = 600_000
BEGINNINGS = (3, 4, 5, 6, 7)
letter = re.compile(r"[^\W\d_]")
# as [^\W\d_]+, with the first 65,536 code points listed: more than twice as fast
ends = [0, *np.flatnonzero(np.diff([bool(letter.match(chr(c))) for c in range(0x10000)])).tolist()]
few_letters = re.compile("[" + "".join(f"{chr(a + 1)}-{chr(b)}" for a, b in zip(ends[1::2], ends[2::2])) + "]+").findall
all_letters = re.compile(letter.pattern + "+").findall


def letters(text: str) -> list:
    """Runs of letters."""
    return few_letters(text) if len(text.encode("utf-16-le")) == 2 * len(text) else all_letters(text)


# in UTF-8 every byte of a character beyond ASCII is above 127
PARTS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def parts(text: str) -> bytes:
    """The lower-cased text, a space for each ASCII character that is no letter."""
    return text.lower().encode().translate(PARTS)


def runs(batches, column: int):
    """Runs of at most ROWS rows and, but for a single longer text, TEXT bytes of that column."""
    for whole in batches:
        begin = total = 0
        for at, size in enumerate(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy().tolist()):
            if at > begin and (at - begin == ROWS or total + size > TEXT):
                yield whole.slice(begin, at - begin)
                begin, total = at, 0
            total += size
        if begin < whole.num_rows:
            yield whole.slice(begin)


def strings(col: pa.Array) -> list:
    """As to_pylist, several times faster."""
    return col.to_numpy(zero_copy_only=False).tolist()


def terms_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a dash)."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) > n]]


class TermIds(dict):
    """part of a text -> its place in a table of the numbers of its words' terms in the vocabulary, which holds all
    beginnings of its words. A part (a run of ASCII letters and of characters beyond ASCII) holds any number of words."""

    def __init__(self, vocabulary: pa.Array):
        self.numbers = {t: n for n, t in enumerate(strings(vocabulary))}
        self.index = None                      # of the examples, once a task has asked for it
        self.forget()

    def forget(self) -> None:
        self.clear()
        # place 0: a part without terms
        self.table, self.end = np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.places, self.used, self.found, self.sizes = 1, 0, [], []

    def __missing__(self, part: str) -> int:
        get, found = self.numbers.get, []
        for word in [part] if part.isascii() else letters(part):
            for n in BEGINNINGS:
                if len(word) > n:
                    term = get(word[:n] + "-")
                    if term is None:           # no longer beginning is there, nor the word
                        break
                    found.append(term)
            else:
                term = get(word)
                if term is not None:
                    found.append(term)
        place = 0
        if found:
            place = self.places + len(self.sizes)
            self.found += found
            self.sizes.append(len(found))
        self[part] = place
        return place

    def settle(self) -> None:
        """Put the terms of new parts into the table."""
        if not self.sizes:
            return
        places, used = self.places + len(self.sizes), self.used + len(self.found)
        if used > len(self.table):
            self.table = np.concatenate([self.table, np.zeros(used, np.int32)])
        if places > len(self.end):
            self.end = np.concatenate([self.end, np.zeros(places, np.int64)])
        self.table[self.used:used] = self.found
        self.end[self.places:places] = self.used + np.cumsum(self.sizes)
        self.places, self.used, self.found, self.sizes = places, used, [], []

    def keys(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The terms of every distinct part of every text (text << 32 | term, in no order) and the part's count."""
        if len(self) >= CACHE_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(pa.array([parts(t) for t in texts], pa.large_binary()).view(pa.large_string()))
        of = split.flatten().dictionary_encode()             # each part of these texts is looked up once
        place = np.array([self[x] for x in strings(of.dictionary)], np.int64)
        self.settle()
        part = np.repeat(np.arange(len(texts)) << 32, pc.list_value_length(split).to_numpy()) + of.indices.to_numpy()
        part.sort()
        first = np.flatnonzero(np.diff(part, prepend=-1))
        n, part = np.diff(first, append=len(part)), part[first]
        text, place = part >> 32 << 32, place[part & 0xFFFFFFFF]
        text, place, n = text[place > 0], place[place > 0], n[place > 0]
        end = self.end[place]
        size = end - self.end[place - 1]
        at = np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())
        return np.repeat(text, size) + self.table[at], np.repeat(n, size)

    def held(self, texts: list) -> np.ndarray:
        """The terms of each text, each once a text."""
        key, _ = self.keys(texts)
        key.sort()
        return key[np.flatnonzero(np.diff(key, prepend=-1))] & 0xFFFFFFFF

    def counted(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, sorted within each text, their counts, and where each text's begin."""
        key, n = self.keys(texts)
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.add.reduceat(n[by], first) if len(first) else n
        key = key[first]
        start = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
        return (key & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32), start


class Lines:
    """Postings: the examples of a term, and their weights if asked for, in lines of LINE; a line is
    filled up with an example past the last and weight 0."""

    def __init__(self, uses: np.ndarray, past: int, weighted: bool):
        """uses: examples of each term, to be added."""
        self.start, self.used = np.zeros(len(uses) + 1, np.int64), np.zeros(len(uses), np.int32)
        np.cumsum(-(-uses // LINE), out=self.start[1:])
        self.doc = np.full((self.start[-1], LINE), past, np.min_scalar_type(past))
        self.more = np.zeros(self.doc.shape) if weighted else None

    def add(self, terms: np.ndarray, places: np.ndarray, more=None) -> None:
        by = np.argsort(terms, kind="stable")
        terms = terms[by]
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        n = np.diff(first, append=len(terms))
        at = self.start[terms] * LINE + self.used[terms] + np.arange(len(terms)) - np.repeat(first, n)
        self.doc.reshape(-1)[at] = places[by]
        if more is not None:
            self.more.reshape(-1)[at] = more[by]
        self.used[terms[first]] += n.astype(np.int32)


class BlockMaxIndex:
    """Unit vectors of examples: dense rows in blocks for common terms, postings of the rest.

    A weight is (1 + log count) * idf / norm. Postings leave the idf and the
    norm to the text and the example: a term's examples count 1 each, those
    with more than one use stand in a second list with the log of the count."""

    def __init__(self, ids: list, toxic: list, rows: list, idf: np.ndarray, k: int = 25):
        """rows: per example (terms, counts)."""
        self.idf, self.k, self.sums = idf, k, None
        norm, top, seen = np.zeros(len(rows)), np.full(len(rows), -1, np.int64), [np.empty(0, np.int32)]
        uses, twice = np.zeros(len(idf), np.int64), np.zeros(len(idf), np.int64)
        for row, terms, counts in self.some(rows, range(len(rows))):
            weight = (1 + np.log(counts)) * idf[terms]
            norm += np.bincount(row, weight * weight, len(rows))
            by = np.lexsort((-weight, row))                    # stable: the first of equal weights
            first = by[np.flatnonzero(np.diff(row[by], prepend=-1))]
            top[row[first]] = terms[first]
            seen.append(np.unique(counts))
            np.add.at(uses, terms, 1)
            np.add.at(twice, terms[counts > 1], 1)
        norm = np.sqrt(norm)
        # examples that share their heaviest term stand together, so block bounds are tight
        order = np.array(sorted(range(len(ids)), key=lambda i: (top[i], ids[i])), np.int64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.int64)
        self.place = {int(i): n for n, i in enumerate(self.ids)}
        self.blocks = -(-len(order) // BLOCK)
        self.scale = np.zeros(self.blocks * BLOCK)            # 1 / norm
        self.scale[:len(order)] = 1 / np.where(norm > 0, norm, 1)[order]
        self.common = np.full(len(idf), -1, np.int32)        # term -> its column in ``dense``
        most_used = np.argsort(-uses, kind="stable")[:COMMON]
        self.common[most_used] = np.arange(len(most_used))
        self.common_idf = idf[most_used]
        uses[most_used] = twice[most_used] = 0
        self.dense = np.zeros((self.blocks * BLOCK, len(most_used)), np.float32)
        # the same without idf and norm, in double precision: few values, and which of them each is
        seen = np.unique(np.concatenate(seen))
        self.level = np.concatenate([[0.0], 1 + np.log(seen)])
        self.which = np.zeros(self.dense.shape, np.min_scalar_type(len(seen)))
        self.once, self.twice = Lines(uses, len(self.scale), False), Lines(twice, len(self.scale), True)
        for place, terms, counts in self.some(rows, order.tolist()):
            more, column = np.log(counts), self.common[terms]
            held, rest = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
            at = place[held], column[held]
            self.dense[at] = (1 + more[held]) * idf[terms[held]] / norm[order[at[0]]]
            self.which[at] = np.searchsorted(seen, counts[held]) + 1
            self.once.add(terms[rest], place[rest])
            rest = rest[counts[rest] > 1]
            self.twice.add(terms[rest], place[rest], more[rest])
        self.most = self.dense.reshape(self.blocks, BLOCK, len(most_used)).max(axis=1, initial=0.0)

    def some(self, rows: list, order):
        """Place in ``order``, term and count of every use, 256 examples at a time."""
        for at in range(0, len(order), 256):
            few = [rows[i] for i in order[at:at + 256]]
            yield (np.repeat(np.arange(at, at + len(few)), [len(t) for t, _ in few]),
                   *(np.concatenate([np.asarray(r[i], np.int32) for r in few]) for i in (0, 1)))

    def nearest(self, terms, counts, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0."""
        return self.nearest_of([(terms, counts, without)])[0]

    def nearest_of(self, texts: list) -> list:
        """``nearest`` of each (terms, counts, without)."""
        return [x for at in range(0, len(texts), TOGETHER) for x in self.together(texts[at:at + TOGETHER])]

    def by_postings(self, terms, w, first) -> np.ndarray:
        """Products of texts and examples over terms that are not common; text i has terms[first[i]:first[i + 1]].
        The array is used again by the next call."""
        if self.sums is None:
            self.sums = np.empty((TOGETHER, self.blocks * BLOCK))
        out = self.sums[:len(first) - 1]
        out[:] = 0
        w, first = w * self.idf[terms], first.tolist()
        for start, doc, more in ((x.start, x.doc, x.more) for x in (self.once, self.twice)):
            begin = start[terms]
            size = start[terms + 1] - begin
            total = np.concatenate([[0], np.cumsum(size)])
            jump, of = begin - total[:-1], size * LINE
            for i, (a, b) in enumerate(zip(first, first[1:])):
                if total[a] < total[b]:
                    # the lines of all terms, one after another; "clip" saves a check, every line is there
                    at = np.repeat(jump[a:b], size[a:b])
                    at += np.arange(total[a], total[b])
                    weight = np.repeat(w[a:b], of[a:b])
                    if more is not None:
                        weight *= more.take(at, axis=0, mode="clip").ravel()
                    out[i] += np.bincount(doc.take(at, axis=0, mode="clip").ravel(), weight, out.shape[1] + 1)[:-1]
        out *= self.scale
        return out

    def least(self, cos) -> tuple[np.ndarray, np.ndarray]:
        """Largest cosine per block, and one per text that k examples reach: the k-th largest of those."""
        most, k = cos.reshape(len(cos), self.blocks, BLOCK).max(axis=2), min(self.k, cos.shape[1])
        over = most if k <= self.blocks else cos
        return most, np.partition(over, over.shape[1] - k, axis=1)[:, over.shape[1] - k]

    def together(self, texts: list) -> list:
        n = len(self.ids)
        if not n:
            return [(np.empty(0, np.int64), np.empty(0))] * len(texts)
        text = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
        terms = np.concatenate([np.asarray(t[0], np.int64) for t in texts])
        w = (1 + np.log(np.concatenate([np.asarray(t[1], np.int64) for t in texts]))) * self.idf[terms]
        w /= np.sqrt(np.bincount(text, w * w, len(texts)))[text]
        column = self.common[terms]
        held = column >= 0
        q = np.zeros((len(texts), self.dense.shape[1]))
        q[text[held], column[held]] = w[held]
        rare = self.by_postings(terms[~held], w[~held], np.searchsorted(text[~held], np.arange(len(texts) + 1)))
        without = np.array([t[2] for t in texts])
        own = np.flatnonzero(without >= 0)
        rare[own, without[own]] = -np.inf
        cos, short = rare.astype(np.float32), q.astype(np.float32)
        most, least = self.least(cos)
        bound = short @ self.most.T + most
        # in the blocks left out no example can enter; runs of the others are multiplied at once
        used = np.flatnonzero(np.repeat((bound >= least[:, None] - 2 * SLACK).any(axis=0), BLOCK))
        for run in np.split(used, np.flatnonzero(np.diff(used) > 1) + 1):
            for at in range(0, len(run), 16 * BLOCK):
                some = slice(run[at], run[min(at + 16 * BLOCK, len(run)) - 1] + 1)
                cos[:, some] += short @ self.dense[some].T
        out, q = [], q * self.common_idf
        for i, least in enumerate(self.least(cos)[1].tolist()):
            rows = np.flatnonzero(cos[i] >= max(least - 2 * SLACK, TINY))
            if len(rows) > self.k:
                some = cos[i, rows]
                rows = rows[some >= np.partition(some, len(rows) - self.k)[len(rows) - self.k] - 2 * SLACK]
            some = np.flatnonzero(q[i])
            level = self.level.take(self.which.take(rows, axis=0).take(some, axis=1))
            sure = rare[i, rows] + level @ q[i, some] * self.scale[rows]
            best = np.lexsort((self.ids[rows], -np.round(sure, 12)))[:self.k]
            out.append((rows[best], sure[best]))
        return out


class Votes:
    """Distance-weighted votes with class weights, then a logistic curve."""

    def __init__(self, toxic: np.ndarray, share: float, doubt: float = 0.1, curve: tuple = (1.0, 0.0)):
        self.toxic, self.share, self.doubt, self.curve = toxic, share, doubt, curve
        seen = toxic.mean() if len(toxic) else 0.5
        self.value = np.where(toxic == 1, share / max(seen, 1e-9), (1 - share) / max(1 - seen, 1e-9))

    def raw(self, rows: np.ndarray, cos: np.ndarray) -> float:
        """Log odds of the votes; ``doubt`` is the weight of the plain share."""
        w = self.value[rows] * cos / (1.02 - np.minimum(cos, 1.0))
        yes, no = w[self.toxic[rows] == 1].sum(), w[self.toxic[rows] == 0].sum()
        return float(np.log((yes + self.doubt * self.share) / (no + self.doubt * (1 - self.share))))

    def probability(self, raw: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * raw + b, -500, 500))))

    def calibrate(self, raw: np.ndarray, steps: int = 60) -> None:
        """Weighted logistic fit by Newton steps, a little held to the identity."""
        y, a = self.toxic.astype(float), np.array([1.0, 0.0])
        x = np.stack([raw, np.ones(len(raw))], axis=1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            slope = x.T @ (self.value * (p - y)) + (a - [1.0, 0.0])
            bend = (x * (self.value * p * (1 - p))[:, None]).T @ x + np.eye(2)
            a = a - np.linalg.solve(bend, slope)
        self.curve = (max(float(a[0]), 1e-3), float(a[1]))


def example_terms(examples: DataFrame) -> pa.Array:
    """Every term of the examples, sorted."""
    def split(batches):
        for whole in batches:
            for batch in slices(whole):
                seen = {t for x in as_text(batch.column(0)) for w in set(letters(x.lower())) for t in terms_of(w)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["term"])

    terms = examples.select("text").mapInArrow(split, "term string").distinct().toArrow().column(0)
    terms = terms.cast(pa.large_string()).combine_chunks()
    return terms.take(pc.sort_indices(terms))


def frequencies(docs: DataFrame, vocabulary, name: str, size: int, parts: int = 64) -> np.ndarray:
    """Documents that hold each term: tasks count their own and hand on one row
    per range of terms, the ranges are summed by Spark tasks."""
    wide = -(-size // parts)
    row = "part int, t array<int>, n array<long>"

    def rows(total):
        for part in range(parts):
            used = np.flatnonzero(total[part * wide:(part + 1) * wide]) + part * wide
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([used], pa.list_(pa.int32())),
                                                  pa.array([total[used]], pa.list_(pa.int64()))], names=["part", "t", "n"])

    def count(batches):
        known, total = worker_cache(name, lambda: TermIds(vocabulary.value)), np.zeros(size, np.int64)
        for batch in runs(batches, 0):
            np.add.at(total, known.held(as_text(batch.column(0))), 1)
        yield from rows(total)

    def add(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for t, n in zip(b.column(1), b.column(2)):
                total[t.values.to_numpy()] += n.values.to_numpy()
        yield from rows(total)

    df = np.zeros(size)
    for r in docs.select("text").mapInArrow(count, row).repartition(parts, "part").mapInArrow(add, row).toArrow().to_batches():
        for t, n in zip(r.column(1), r.column(2)):
            df[t.values.to_numpy()] = n.values.to_numpy()
    return df


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = 4000,
                    k: int = 25, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the nearest examples' ids and cosines."""
    out = "doc_id {}, score double, evidence array<long>, cosines array<double>".format(
        docs.schema["doc_id"].dataType.simpleString())
    known = labels.filter("doc_id is not null AND toxic IN (0, 1)").groupBy("doc_id") \
        .agg(F.max("toxic").cast("int").alias("toxic")).filter(fold_of("doc_id", folds) != held)
    all_of = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = all_of.get(1, 0) / max(1, sum(all_of.values()))
    chosen = [sample_ids(known.filter(F.col("toxic") == y), sample, 17).withColumn("toxic", F.lit(y)) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))             # at most 2 * sample ids
    # copies of a text are one example, under their least id
    examples = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)) \
        .agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    examples = materialize(examples.dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"), "examples")
    both = examples.select("toxic").distinct().count() == 2
    terms = example_terms(examples) if both else pa.array([], pa.large_string())
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    vocabulary, name = spark.sparkContext.broadcast(terms), f"toxic terms {uuid.uuid4()}"
    df = frequencies(docs, vocabulary, name, len(terms)) if len(terms) else np.zeros(0)
    idf = np.log((1 + docs.count()) / (1 + df)) + 1
    rows_known = len(terms) > 0
    del terms, df

    def vectors(batches):
        known = worker_cache(name, lambda: TermIds(vocabulary.value))
        for batch in runs(batches, 2):
            terms, counts, start = known.counted(as_text(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x)) for x in (terms, counts))],
                names=["doc_id", "toxic", "terms", "counts"])

    ids, toxic, rows = [], [], []
    if rows_known:
        found = examples.select("doc_id", "toxic", "text").mapInArrow(
            vectors, f"doc_id {kind}, toxic int, terms array<int>, counts array<int>").toArrow()
        for b in found.to_batches():
            ids += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
            rows += zip(*([x.values.to_numpy() for x in b.column(i)] for i in (2, 3)))
        del found
    size = np.array([len(t) for t, _ in rows], np.int64)
    none = [np.empty(0, np.int32)]
    terms, counts = (np.concatenate([r[i] for r in rows] + none) for i in (0, 1))
    taught = spark.sparkContext.broadcast(
        (ids, toxic, size, terms, counts.astype(np.min_scalar_type(int(counts.max(initial=0)))), idf))
    del terms, counts
    del rows, idf

    def knowing() -> TermIds:
        """This worker's terms, with the index of the examples."""
        known = worker_cache(name, lambda: TermIds(vocabulary.value))
        if known.index is None:
            ids, toxic, size, terms, counts, idf = taught.value
            cuts = np.cumsum(size)[:-1]
            known.index = BlockMaxIndex(ids, toxic, [*zip(np.split(terms, cuts), np.split(counts, cuts))] if ids else [], idf, k)
            give_back()
        return known

    def leave_out(batches):
        index = knowing().index
        votes, (ids, _, size, terms, counts, _) = Votes(index.toxic, share), taught.value
        end = dict(zip(ids, np.cumsum(size).tolist()))
        size = dict(zip(ids, size.tolist()))
        for whole in batches:
            for batch in slices(whole):
                keys = batch.column(0).to_pylist()
                own = [slice(end[i] - size[i], end[i]) for i in keys]
                near = index.nearest_of([(terms[x], counts[x], index.place[i]) for i, x in zip(keys, own)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes.raw(*x) for x in near], pa.float64())],
                                                 names=["doc_id", "raw"])

    votes = Votes(np.array(toxic, np.int64), share)
    if rows_known:
        # each example searched without itself
        raw = examples.select("doc_id").repartition(12).mapInArrow(leave_out, f"doc_id {kind}, raw double").toArrow()
        raw = dict(zip(*(c.to_pylist() for c in raw.columns)))
        votes.calibrate(np.array([raw[i] for i in ids]))
    curve = votes.curve

    def run(batches):
        known = knowing()
        index, v = known.index, Votes(known.index.toxic, share, curve=curve)
        for batch in runs(batches, 1):
            keys = batch.column(0)
            terms, counts, start = known.counted(as_text(batch.column(1)))
            start = start.tolist()
            # a labelled example is not evidence for itself
            near = index.nearest_of([(terms[a:b], counts[a:b], index.place.get(key, -1)) for key, a, b in zip(
                keys.to_pylist(), start, start[1:])])
            score = [v.probability(v.raw(*x)) if rows_known else share for x in near]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(score, pa.float64()), pa.array([index.ids[x] for x, _ in near], pa.list_(pa.int64())),
                 pa.array([c for _, c in near], pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "cosines"])

    return docs.select("doc_id", "text").mapInArrow(run, out).withColumn("held_out", fold_of("doc_id", folds) == held) \
        .withColumn("predicted", (F.col("score") >= least).cast("int"))
