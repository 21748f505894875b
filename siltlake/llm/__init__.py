"""Training-data operators: search, token files, quality, mixing, sharding,
near-duplicates, toxicity, BPE, language identification and URL rules.

Nothing outside this subpackage imports it.
"""
