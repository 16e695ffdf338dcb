"""Training-data operators: deduplication, filtering, tokenising and mixing of document tables.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
