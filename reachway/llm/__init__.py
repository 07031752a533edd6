"""Training-data operators: cleaning, deduplication, filtering and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
