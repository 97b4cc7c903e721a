"""Training-data operators: deduplication, search, scoring, scanning and tokenising of documents.

Nothing else in the library imports this subpackage.
"""
