"""Training-data operators: deduplication, tokenisation, packing, mixing, archives, chat formatting.

Nothing outside this subpackage imports it. ``queries.py`` registers one query
per operator and the corpus pipeline.
"""
