import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from prefeval.llm import toxicity
from prefeval.llm.toxicity import BlockMaxIndex, TermIds, letters, runs, score_documents, terms_of


def test_index_is_exact():
    rng = np.random.default_rng(1)
    terms = 60
    rows = []
    for _ in range(500):
        t = np.unique(rng.zipf(1.3, 8) % terms)
        rows.append((t, rng.integers(1, 5, len(t))))
    rows += [rows[3], rows[3], (np.empty(0, int), np.empty(0, int))]
    idf = rng.uniform(1, 6, terms)
    ids = rng.permutation(len(rows)) * 3
    index = BlockMaxIndex(ids.tolist(), [0] * len(rows), rows, idf, k=7)

    def unit(t, c):
        v = np.zeros(terms)
        v[t] = (1 + np.log(c)) * idf[t] if len(t) else 0
        return v / max(np.linalg.norm(v), 1e-300)
    dense = np.array([unit(*r) for r in rows])
    for n in (0, 3, 17, 99, 500, 502):
        for without in (-1, index.place[int(ids[n])]):
            cos = dense @ dense[n]
            if without >= 0:
                cos[n] = 0
            want = np.lexsort((ids, -np.round(cos, 12)))[:7]
            want = want[cos[want] > 0]
            got, sims = index.nearest(*rows[n], without)
            assert index.ids[got].tolist() == ids[want].tolist() and np.allclose(sims, cos[want])


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = score_documents(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted for r in rows if r.toxic == 1)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)
    means = [np.mean([r.score for r in rows if r.predicted == x]) for x in (0, 1)]
    rates = [np.mean([r.toxic for r in rows if r.predicted == x]) for x in (0, 1)]
    assert np.allclose(means, rates, atol=0.12)            # calibrated on either side of the cut


def test_edge_rows(spark):
    texts = ["what an idiot and a moron", "a fine day for a walk", None, "", "idiot " * 40000, "nothing known"]
    tail = lambda i: "" if i % 6 in (2, 3) else " " + chr(97 + i % 26) * (3 + i // 26)
    rows = [(i, texts[i % 6] and texts[i % 6] + tail(i), 1) for i in range(120)] + [(None, "idiot", 1), (6, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, evidence int")
    marks = [(i, 1, int(i % 6 in (0, 4))) for i in range(90)] + [(1, 1, None), (None, 1, 1), (10**9, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert by[96].predicted == by[100].predicted == by[None].predicted == 1 and by[97].predicted == by[98].predicted == 0
    assert set(by[96].evidence) <= set(range(90)) and by[0].doc_id not in by[0].evidence
    assert score_documents(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_documents(docs, labels.filter("toxic = 0")).collect()} == {0.0}


def test_no_term_is_cut(spark):
    """Telling words that each stand in one toxic example, none of them common."""
    spell = lambda n: "".join(chr(97 + int(c)) for c in f"{n:04d}")
    ids = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "we met them near a house and had " + ("tea " if k % 2 else "cake ") + spell(7919 * k % 10000), 0)
            for k, i in enumerate(ids[:300])]
    rows += [(i, f"q{spell(k)} z{spell(k)} x{spell(k)}", 1) for k, i in enumerate(ids[300:360])]
    rows += [(1000, rows[305][1], None), (1001, rows[5][1], None), (1002, "z" + spell(9) + " there", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if y is not None], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert got[1000].evidence[0] == rows[305][0] and abs(got[1000].cosines[0] - 1) < 1e-9
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1000].score > got[1001].score
    assert got[1002].evidence[0] == rows[309][0]


def test_the_driver_holds_terms_and_counts_alone(spark, monkeypatch):
    """What is sent to the workers grows with the examples' terms, not with a dense index."""
    kind, sent = type(spark.sparkContext), []
    whole = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, x: sent.append(len(pickle.dumps(x))) or whole(self, x))
    spell = lambda n: "".join(chr(97 + int(c)) for c in f"{n:05d}")
    rows = [(i, " ".join(spell(i * 7 + 113 * j) for j in range(8))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    assert score_documents(docs, labels).count() == 400
    assert 0 < sum(sent) < 500_000


def test_letters_as_before():
    odd = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 7)
    for text in (odd[:60000], odd, "abc é½² x1_y 中文 𝒳z", ""):
        assert letters(text) == re.findall(r"[^\W\d_]+", text)


def test_each_part_is_looked_up_once():
    """Words are looked up once per run of texts, not once per text; terms and counts are those of a plain loop."""
    looked = []

    class Seen(TermIds):
        def __getitem__(self, part):
            looked.append(part)
            return super().__getitem__(part)
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, n)) for n in rng.integers(1, 11, 60)]
    words += ["état", "ΑΣ", "ΑΣ'Α", "İstanbul", "naïve—café", "x1_y", "𝒳z", "中文", "é½²", "don't", " "]
    texts = ["", "  12 ", *(" ".join(rng.choice(words, 40).tolist()) for _ in range(300))]
    vocabulary = sorted({t for x in texts[::2] for w in re.findall(r"[^\W\d_]+", x.lower()) for t in terms_of(w)})
    known = Seen(pa.array(vocabulary, pa.large_string()))
    terms, counts, start = known.counted(texts)
    assert len(looked) == len(set(looked)) <= 2 * len(words)
    number = {t: n for n, t in enumerate(vocabulary)}
    for x, a, b in zip(texts, start, start[1:]):
        want = Counter(number[t] for w in re.findall(r"[^\W\d_]+", x.lower()) for t in terms_of(w) if t in number)
        assert dict(zip(terms[a:b].tolist(), counts[a:b].tolist())) == want and (np.diff(terms[a:b]) > 0).all()
    assert known.held(texts).tolist() == terms.tolist()


def test_runs_are_bounded():
    texts = ["a" * (n * 7919 % 9000) for n in range(1500)] + [None, "b" * (3 << 20), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = list(runs([batch, batch.slice(0, 0)], 0))
    assert [x for b in got for x in b.column(0).to_pylist()] == texts
    assert all(b.num_rows <= 512 and (b.num_rows == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= 1 << 21) for b in got)


def test_postings_are_exact(monkeypatch):
    """Most terms stand in postings, in lines of several examples; blocks are left out."""
    monkeypatch.setattr(toxicity, "COMMON", 12)
    rng = np.random.default_rng(2)
    terms, rows = 400, []
    for n in range(700):
        t = np.unique(np.concatenate([rng.zipf(1.2, 12) % 100, rng.integers(n // 70 * 30, n // 70 * 30 + 60, 9)]))
        rows.append((t, rng.integers(1, 5, len(t))))
    rows[5] = rows[400] = (np.empty(0, int), np.empty(0, int))
    idf, ids = rng.uniform(1, 6, terms), (rng.permutation(len(rows)) * 3).tolist()
    index = BlockMaxIndex(ids, [0] * len(rows), rows, idf, k=7)
    dense = np.zeros((len(rows), terms))
    for v, (t, c) in zip(dense, rows):
        v[t] = (1 + np.log(c)) * idf[t]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    for (got, sims), row, v in zip(index.nearest_of([(*r, -1) for r in rows]), rows, dense):
        cos = dense @ v
        want = np.lexsort((ids, -np.round(cos, 12)))[:7]
        want = want[cos[want] > 0]
        assert index.ids[got].tolist() == np.array(ids)[want].tolist() and np.allclose(sims, cos[want])
