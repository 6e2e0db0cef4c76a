"""One registered query per training-data operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from prefeval.llm import clusters, fim, line_dedup, secrets
from prefeval.llm.bpe import digest_documents
from prefeval.llm.chat import digests, format_conversations
from prefeval.llm.common import fold_of, read_table
from prefeval.llm.langid import identify
from prefeval.llm.lsh import near_vectors
from prefeval.llm.packing import pack_documents
from prefeval.llm.quality import classify
from prefeval.llm.shingles import near_duplicates
from prefeval.llm.topk import top_k
from prefeval.llm.toxicity import score_documents


def op1_chat_formatting(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return digests(format_conversations(turns.unionByName(extra)))


def op2_best_fit_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), capacity=2048, separator=0)


def op3_exact_topk_search(spark, sf_dir):
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, scale=256, k=5)


def op4_quality_classifier(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                    folds=5, held=0, least=0.3).select("doc_id", "held_out", "score", "predicted")


def op5_language_id(spark, sf_dir):
    return identify(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                    folds=3, held=1).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(docs, secrets.train(docs)))


def op8_toxicity(spark, sf_dir):
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                           folds=4, held=2, least=0.3).select("doc_id", "held_out", "score", "predicted", "evidence")


def op9_embedding_near_dedup(spark, sf_dir):
    return near_vectors(read_table(spark, sf_dir, "embeddings"), least=0.98)


def op10_bpe_coding(spark, sf_dir):
    return digest_documents(read_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.digests(fim.fill_in_middle(read_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))


def op12_centroid_clustering(spark, sf_dir):
    return clusters.summary(*clusters.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64,
                                                      dims=64, seed=1))


def op13_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, shortest=20, least=3), digest_only=True)


LLM_QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_topk_search": op3_exact_topk_search,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_secret_scans": op7_secret_scans,
    "op8_toxicity": op8_toxicity,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_bpe_coding": op10_bpe_coding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_line_dedup": op13_line_dedup,
}
_ESCAPED = r"""replace(replace(replace(replace(replace({0}, '\', '\\'),
    '<s>', '<\s>'), '</s>', '<\/s>'), '[INST', '[\INST'), '[/INST]', '[\/INST]')"""


def _kmeans_sql(rounds: int) -> str:
    """Assignment and update of every round as common table expressions."""
    parts = ["""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
         list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1)::INTEGER AS cluster, q AS c
       FROM v QUALIFY cluster < 16)"""]
    for k in range(rounds + 1):
        parts.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, vec_id, q, cluster, c, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v CROSS JOIN c{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if k < rounds:
            parts.append(f"""
m{k} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (
  SELECT cluster, i, floor(sum(x) / count(*))::BIGINT AS m
  FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster),
c{k + 1} AS (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"""


LLM_ORACLE: dict[str, str] = {
    "op1_chat_formatting": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST ' || {_ESCAPED.format("role")} || ']' || chr(10) || {_ESCAPED.format("text")}
      || chr(10) || '[/INST]</s>'))::BIGINT AS formatted_chars,
  -1::INTEGER AS rewrites_at
FROM turns GROUP BY conv_id""",
    "op3_exact_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
         GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
          UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x)
SELECT x AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(y) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         label IS NOT NULL AND coalesce(len(embedding), 0) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE ok),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings
          UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
root AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM root LEFT JOIN deg USING (vec_id)""",
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
    ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d),
cut AS (
  SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
piece AS (
  SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM piece""",
    "op12_centroid_clustering": _kmeans_sql(3),
    "op13_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM s),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT r, k.doc_id, line, i, f.key IS NULL OR k.doc_id = top AS keep FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
FROM j GROUP BY r, doc_id""",
}
