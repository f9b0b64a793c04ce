"""Operators that prepare a training corpus: shards, tokens, duplicates, filters, packing.

Nothing outside this package imports it.
"""
