"""Training-corpus pipeline over ``documents``.

Stages, each applying one training-data operator to all rows its predecessor
kept: language identification (rows without a language go), quality (rows
scored under the cut go), near-duplicates (one row of each component stays),
secrets (every span found is replaced in the text), packing. All but the last
return the columns of ``documents``; the last returns packed token pieces.

Null texts carry no language and go in the first stage; null ids and repeated
rows are handled as the operators' docstrings say; further columns of the
input are not carried on.
"""

from __future__ import annotations

import public_tokenizers

from prefeval.llm import langid, packing, quality, secrets, shingles
from prefeval.llm.common import materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark, docs, sf_dir):
    found = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), folds=3, held=1, carry=COLUMNS)
    return found.filter("lang_pred <> 'und'").select(*COLUMNS)


def quality_classifier(spark, docs, sf_dir):
    scored = quality.classify(docs, read_table(spark, sf_dir, "labels"), folds=5, held=0, least=0.3, carry=COLUMNS)
    return scored.filter("predicted = 1").select(*COLUMNS)


def ngram_jaccard_join(spark, docs, sf_dir):
    return shingles.keep_one(docs.select(*COLUMNS))


def secret_scans(spark, docs, sf_dir):
    return secrets.redact(docs.select(*COLUMNS), secrets.train(docs))


def best_fit_packing(spark, docs, sf_dir):
    # executors still hold what the stages before took: a small word cache
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, separator=0,
                                  cache_words=200_000)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

# The trained stages (language, quality, secrets) have no SQL form; the tests
# compare each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
