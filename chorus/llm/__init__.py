"""Operators for preparing text corpora for model training, one module per operator.

Nothing outside this folder imports it. ``queries.py`` names the registered queries and
``oracles.py`` their DuckDB statements; the corpus pipeline is ``corpus_pipeline.py`` at the top of
the repository.
"""
