"""Training-data operators: language, duplicates, tokens, hosts, shards, packing, personal data, search."""
