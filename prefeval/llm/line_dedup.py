"""Line deduplication by a range partition with a secondary sort.

Every line whose normalised form (its key) is long enough becomes one row of
two key hashes, the document and the line's position: no text is shuffled.
Rows are range-partitioned and sorted by (hash, document from the largest,
position). A task streams its rows: the first document of a run of equal
hashes is the one that keeps its lines, and from the ``least``-th document on
the run is known to be common, so all later lines are marked as they pass and
only the lines of the first documents are held. Rows of all columns take part
in the range, so a key found in a third of all lines spreads over many tasks.
The runs that may go on in a neighbour partition (a partition's first run, and
its last while it is short) are written as open, with one summary a partition
(first and last document, number of documents); the summaries, two a partition
at most, decide them.

The result is one row per distinct (document, text): the number of lines and a
compressed bitmap of the lines to keep. ``apply_bitmaps`` joins it to the
texts.

Key hashes have 128 bits, a text is told from others of the same id by 64 bits.

Edge cases: a null or empty text is one empty line, which is kept unless
``shortest`` is 0; null ids count together as one document that ranks below
all others; rows with the same id are one document, and each row gets the
lines of its own text back; repeated rows give equal rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import as_bytes, materialize, slices

LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: bytes, shortest: int):
    """(position, key) of every line whose key has ``shortest`` code points."""
    for at, line in enumerate(text.translate(LOWER).split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= shortest and (len(key) >= 4 * shortest or key.isascii() or len(key.decode(errors="replace")) >= shortest):
            yield at, key


def hashed_lines(docs: DataFrame, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, doc_id, digest, pos of every line that can be a duplicate."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1024):
                row, at, h = [], [], []
                for k, text in enumerate(as_bytes(batch.column(2))):
                    for pos, key in line_keys(text, shortest):
                        row.append(k)
                        at.append(pos)
                        h.append(xxhash.xxh3_128_digest(key))
                if row:
                    two = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
                    row = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(two[:, 0]), pa.array(two[:, 1]), batch.column(0).take(row), batch.column(1).take(row),
                         pa.array(at, pa.int32())], names=["h1", "h2", "doc_id", "digest", "pos"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, digest long, pos int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def mark_runs(batches, least: int):
    """Lines to drop out of sorted batches of one partition.

    Yields (h1, h2, doc_id, digest, pos, state, docs, top, last) rows: state 0
    is a line to drop, 1 a line of an open run, 2 an open run's summary: how
    many documents it has here (at most ``least``), the first and the last."""
    run = None                                   # the run that the last batch ended in

    def summary(run):
        return (*run["key"], None, None, None, 2, run["docs"], run["top"], run["last"])

    def close(run, ends: bool):
        """What a run leaves when it is over; ``ends``: with the partition."""
        if run["open"]:
            return [summary(run)]
        if not ends:
            return []
        held = [(*run["key"], *r, 1, None, None, None) for r in run["held"]]
        return [*held, summary(run)]

    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        doc, digest, pos = (batch.column(k).to_pylist() for k in (2, 3, 4))
        cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]])
        # a run of one line inside a batch keeps it
        for a, z in zip(starts[(look := (ends - starts > 1) | (starts == 0) | (ends == batch.num_rows))].tolist(),
                        ends[look].tolist()):
            key = (int(h1[a]), int(h2[a]))
            if run is None or run["key"] != key:
                first = run is None
                if run:
                    out += close(run, False)
                run = {"key": key, "open": first, "docs": 0, "top": doc[a], "last": None, "held": []}
            for i in range(a, z):
                if run["docs"] < least and (not run["docs"] or doc[i] != run["last"]):
                    run["docs"] += 1
                    if run["docs"] == least and not run["open"]:
                        out += [(*key, *r, 0, None, None, None) for r in run["held"] if r[0] != run["top"]]
                        run["held"] = []
                run["last"] = doc[i]
                if run["open"]:
                    out.append((*key, doc[i], digest[i], pos[i], 1, None, None, None))
                elif run["docs"] < least:
                    run["held"].append((doc[i], digest[i], pos[i]))
                elif doc[i] != run["top"]:
                    out.append((*key, doc[i], digest[i], pos[i], 0, None, None, None))
        yield out
    if run:
        yield close(run, True)


def marked_lines(lines: DataFrame, least: int) -> DataFrame:
    """Stream the sorted lines of a *stored* table of ``hashed_lines`` with a
    row number ``copy``."""
    kind = lines.schema["doc_id"].dataType.simpleString()
    # equal lines of repeated rows differ in ``copy``: they too can be split
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "pos", "copy"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["h1", "h2", "doc_id", "digest", "pos", "state", "docs", "top", "last"]

    def run(batches):
        def watched():
            for batch in batches:
                ids.append(batch.schema.field("doc_id").type)
                yield batch
        ids = []
        for rows in mark_runs(watched(), least):
            if rows:
                types = [pa.int64(), pa.int64(), ids[-1], pa.int64(), pa.int32(), pa.int32(), pa.int32(), ids[-1], ids[-1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    marked = dealt.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, digest long, pos int, state int, docs int, "
                                   f"top {kind}, last {kind}")
    return marked.withColumn("part", F.spark_partition_id())


def dropped_lines(lines: DataFrame, least: int) -> DataFrame:
    """doc_id, digest, pos of every line to drop (some rows may repeat)."""
    marked = materialize(marked_lines(lines, least), "marked")
    # at most two summaries a partition: neighbours share a document if one
    # ends with the document that the next begins with
    w = F.array_sort(F.collect_list(F.struct("part", "docs", "top", "last")))
    runs = marked.filter("state = 2").groupBy("h1", "h2").agg(w.alias("s"))
    seams = F.size(F.filter(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")),
                                       lambda x, y: x["last"].eqNullSafe(y["top"])), lambda x: x))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["docs"]) - seams
    runs = runs.select("h1", "h2", total.alias("total"), F.col("s")[0]["top"].alias("best")).filter(F.col("total") >= least)
    still = marked.filter("state = 1").join(F.broadcast(runs), ["h1", "h2"]) \
        .filter(~F.col("doc_id").eqNullSafe(F.col("best")))
    columns = ["doc_id", "digest", "pos"]
    return marked.filter("state = 0").select(*columns).unionByName(still.select(*columns))


def keep_bitmaps(docs: DataFrame, shortest: int = 20, least: int = 3,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_lines, n_dropped, keep of every distinct document
    text: ``keep`` is the deflated bitmap of the lines to keep, the first line
    in the highest bit."""
    lines = hashed_lines(docs, shortest, id_col, text_col).withColumn("copy", F.monotonically_increasing_id())
    lines = materialize(lines, "lines")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    all_lines = _keyed(docs, id_col, text_col).select("doc_id", "digest", (breaks + 1).cast("long").alias("n_lines"))
    found = dropped_lines(lines, least).withColumn("n_lines", F.lit(None).cast("long")) \
        .unionByName(all_lines.withColumn("pos", F.lit(None).cast("int"))) \
        .groupBy("doc_id", "digest").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drop"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, drop = batch.column("n_lines").to_pylist(), batch.column("drop").to_pylist()
            maps = []
            for size, gone in zip(n, drop):
                keep = np.ones(size, bool)
                keep[gone] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), batch.column("n_lines"),
                 pa.array([len(g) for g in drop], pa.int64()), pa.array(maps, pa.binary())],
                names=["doc_id", "digest", "n_lines", "n_dropped", "keep"])

    return found.mapInArrow(run, f"doc_id {kind}, digest long, n_lines long, n_dropped long, keep binary")


def kept_text(text: bytes, n_lines: int, keep: bytes) -> bytes:
    """The lines of a text that its bitmap keeps, joined by line ends."""
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    if flags.all():
        return text
    return b"\n".join(line for line, flag in zip(text.split(b"\n"), flags.tolist()) if flag)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest_only: bool = False,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row (with
    ``digest_only`` its sha256 in its place, so that no text is written)."""
    kind = docs.schema[id_col].dataType.simpleString()
    name = "kept_sha256" if digest_only else "text"
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_lines", "n_dropped", "keep")
    joined = _keyed(docs, id_col, text_col).join(b, F.expr("doc_id <=> _id and digest = _digest")) \
        .select("doc_id", "text", "n_lines", "n_dropped", "keep")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1024):
                kept = [kept_text(t, n, k) for t, n, k in zip(as_bytes(batch.column("text")),
                                                              batch.column("n_lines").to_pylist(),
                                                              batch.column("keep").to_pylist())]
                kept = [hashlib.sha256(t).hexdigest() if digest_only else t.decode() for t in kept]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"),
                                                  pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", name])

    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, {name} string")
