"""Training-data operators: ten document operators and the queries that apply them.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()``
in :mod:`cellweave.llm.entries` are picked up by ``__spark_entry__`` when present.
"""
