"""Training-data operators: URL filters, token counts, mixing, decontamination, deduplication,
quality scoring, main-text extraction, pseudonyms and web archives.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
