"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this package; ``queries.py`` registers
one query per operator and ``corpus_pipeline.py`` (repository top) chains
five of them."""
