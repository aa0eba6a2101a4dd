"""Operators for preparing large text corpora (ten operators, one module each).

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
registered queries and ``corpus_pipeline.py`` (repository top) chains five of
the operators.
"""
