"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage.  ``QUERIES`` and
``ORACLE_SQL`` in :mod:`strandline.llm.queries` hold what the entry module adds.
"""
