"""Training-data operators: search, mixing, quality, decontamination, dedup,
token counts, HTML extraction, URL filters.

Nothing else in the library imports this subpackage.
"""
