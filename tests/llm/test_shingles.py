import random

from prefeval.llm.components import components
from prefeval.llm.shingles import near_duplicates


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int").repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_duplicates(df).collect())


def test_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocab, k=60)
    rows = []
    for base in range(12):
        words = rng.choices(vocab, k=rng.choice([5, 12, 60, 150]))
        for _ in range(rng.choice([1, 3, 14])):
            w = list(words)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w).upper() if rng.random() < .3 else "\n".join(w)))
    for _ in range(15):                  # a shared passage alone links nothing
        rows.append((len(rows), " ".join(passage + rng.choices(vocab, k=rng.choice([3, 8, 30, 60])))))
    rows += [(900, None), (901, ""), (902, " \x0b\t"), (903, "Ein Wort"), (904, "ein\twort"), (905, "ein wort!"),
             (906, "x y"), (5, rows[5][1]), (7, "other text under an id in use already, seven"),
             (None, rows[3][1]), (None, "only under no id at all, twice"), (None, "only under no id at all, twice"),
             (907, "long " * 30000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_many_near_copies(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i + 10, " ".join(w)))
    assert got(spark, rows) == brute(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (201, 200), (201, 200)]
    links = spark.createDataFrame(chain, "a long, b long")
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(links.limit(0), "a", "b").count() == 0
