"""Training-data operators: chat formatting, packing, search, quality and
language models, similarity joins, secret and toxicity scans, BPE coding."""
