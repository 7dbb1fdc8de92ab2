"""Training-data operators: language, extraction, ids, packing, copies, shards, leaks, quality, licences, personal data,
language models, clusters, divergence of sources."""
