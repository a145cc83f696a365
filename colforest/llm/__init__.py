"""Training-data operators: deduplication, screening, mixing, search, archives, encoding.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list what it offers.
"""
