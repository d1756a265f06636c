"""Operators for preparing training text: deduplication, packing, filtering and media columns.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
