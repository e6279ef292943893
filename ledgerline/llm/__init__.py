"""Training-data operators: deduplication, quality, packing, tokens, search and extraction.

Nothing else in the library imports this subpackage.
"""
