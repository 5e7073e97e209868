"""Operators for large text corpora: quality, toxicity, near copies, licences, tokens, URL lists, repeats, mixing, search."""
