"""Training-data operators: tokenising, chat repair, scoring, packing, search, fingerprints and deduplication.

Nothing outside this subpackage imports it.
"""
