"""Training-data operators: quality, tokens, near copies, packing, search, contamination, secrets, repeats, language."""
