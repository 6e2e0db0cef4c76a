"""Sources and sinks: round trips, error policies, listing."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from prefeval.plans.queries import QUERIES
from prefeval.session import ensure_checkpoint_dir
from prefeval.sinks import files as K
from prefeval.sources import files as S
from prefeval.streaming import ops as ST


def test_read_jsonl_fail_and_skip(spark):
    d = tempfile.mkdtemp(prefix="prefeval-test-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"idx": "1", "prompt": "x"}\n\n{"idx": "2", "prompt": "y"}\n{"idx": broken\n')
    schema = T.StructType([T.StructField("idx", T.StringType()), T.StructField("prompt", T.StringType())])
    rows, obs = S.read_jsonl(spark, d, schema, bad="skip")
    assert sorted(r.idx for r in rows.collect()) == ["1", "2"]
    assert obs.get["malformed"] == 1
    with pytest.raises(Exception):
        S.read_jsonl(spark, d, schema, bad="fail")[0].collect()


def test_available_languages_listing(spark):
    d = tempfile.mkdtemp(prefix="prefeval-test-")
    for lang, name in [("en", "filtered.json"), ("fr", "raw.json"), ("de", "test-00000.parquet"),
                       ("translation", "raw.json"), (".hidden", "raw.json"), ("es", "other.txt")]:
        os.makedirs(os.path.join(d, lang), exist_ok=True)
        open(os.path.join(d, lang, name), "w").write("{}")
    got = [r.language for r in S.available_languages(spark, d).collect()]
    assert got == ["de", "en", "fr"]


def test_seed_summaries_and_missing_seeds(spark):
    d = tempfile.mkdtemp(prefix="prefeval-test-")
    acc = spark.createDataFrame([(42, "b", "en", 10, 7, 0.7), (43, "b", "en", 10, 6, 0.6)],
                                "seed int, benchmark string, language string, total long, correct long, accuracy double")
    K.write_summary(acc, d)
    rows, missing = S.read_seed_results(spark, d, [42, 43, 44])
    assert sorted(r.seed for r in rows.select("seed").collect()) == [42, 43]
    assert [r.seed for r in missing.collect()] == [44]


def test_replace_dataset_keeps_old_until_success(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="prefeval-test-"), "data")
    K.replace_dataset(spark.range(3), d)
    assert spark.read.parquet(d).count() == 3
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception):
        K.replace_dataset(bad, d)
    assert spark.read.parquet(d).count() == 3
    K.replace_dataset(spark.range(5), d)
    assert spark.read.parquet(d).count() == 5


def test_replace_dataset_with_a_failing_second_move(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="prefeval-test-"), "data")
    K.replace_dataset(spark.range(3), d)
    calls = []

    def move(fs, src, dst):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no")
        K._renamed(fs, src, dst)

    with pytest.raises(OSError):
        K.replace_dataset(spark.range(5), d, move=move)
    assert spark.read.parquet(d).count() == 3


def test_no_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def _ema_rows(spark, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return sorted(map(tuple, QUERIES["st2_stream_ema"](spark, SF_SMALL).select("run", "metric", "step", "ema").collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_stream_ema_on_any_layout(spark):
    want = sorted(map(tuple, QUERIES["g1_ema"](spark, SF_SMALL).select("run", "metric", "step", "ema").collect()))
    a, b = _ema_rows(spark, 1), _ema_rows(spark, 12)
    assert a == b and [r[:3] for r in a] == [r[:3] for r in want]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in want], rel=1e-9)


def test_stream_ledger_in_one_and_five_batches(spark):
    from prefeval.plans import fixtures as FX
    rows = FX.ledger(spark, SF_SMALL).select("id", "ts", "status").orderBy("ts").collect()
    schema = "id long, ts timestamp, status string"
    out = []
    for batches in (1, 5):
        d = tempfile.mkdtemp(prefix="prefeval-test-")
        for k in range(batches):
            part = rows[k * len(rows) // batches:(k + 1) * len(rows) // batches]
            spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
            stream = spark.readStream.schema(schema).parquet(f"{d}/in")
            res = ST.run_to_table(spark, ST.stream_ledger(stream), f"{d}/out", f"{d}/ckpt")
        out.append(sorted(map(tuple, res.collect())))
    assert out[0] == out[1] and len(out[0]) > 0 and len({r[0] for r in out[0]}) == len(out[0])


def test_judgment_requests_missing_user_fails(spark):
    d = tempfile.mkdtemp(prefix="prefeval-test-")
    os.makedirs(os.path.join(d, "ds"))
    with open(os.path.join(d, "ds", "x_en_judgment_requests.jsonl"), "w") as f:
        f.write('{"custom_id": "g-en-1-goldA", "body": {"messages": [{"role": "system", "content": "s"}]}}\n')
    with pytest.raises(Exception):
        S.read_judgment_requests(spark, d).collect()
    with pytest.raises(Exception):
        S.read_judgment_requests(spark, d, datasets=["ds", "absent"], on_error="null").collect()
