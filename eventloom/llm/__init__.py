"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` in
:mod:`eventloom.llm.queries` are what the entry module adds when the folder is there.
"""
