import random

from prefeval.session import scratch_dir
from prefeval.streaming import ops


def test_any_batching_and_hot_null_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(40), k, "x") for k in range(300)]
    rows += rows[:9] + [("hot", None, 1, "x"), ("b", 999, None, "x"), ("few", 1, 1, "x")]
    want = sorted((repr(key), t, i) for key in {r[0] for r in rows}
                  for t, i in sorted(((r[1], r[2]) for r in rows if r[0] == key and None not in r[1:3]), reverse=True)[:7])
    for parts in (1, 3):
        base = scratch_dir(spark, "last_n")
        rng.shuffle(rows)
        for p in range(parts):
            df = spark.createDataFrame(rows[p::parts], "k string, t long, i long, version string")
            df.repartition(3).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
            out = ops.run_to_table(spark, ops.stream_last_n(stream, 7, "k", ["t", "i"]), f"{base}/out", f"{base}/ckpt")
        assert sorted((repr(r.k), r.t, r.i) for r in ops.current_last_n(out, "k").collect()) == want
        assert out.groupBy("k", "version").count().agg({"count": "max"}).first()[0] == 7
