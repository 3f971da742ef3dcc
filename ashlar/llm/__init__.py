"""Training-data operators: language, quality, HTML, packing, sharding, dedup, rules, toxicity, search, tokens."""
