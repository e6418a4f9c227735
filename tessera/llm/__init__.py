"""Training-data operators: filtering, deduplication, tokenisation and packing of a text corpus.

Nothing outside this subpackage imports it.
"""
