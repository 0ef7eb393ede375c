"""Training-data operators: packing, tokenising, de-duplication, screening.

Nothing outside this subpackage imports it.  Each module holds one operator
with a DataFrame-in, DataFrame-out interface; ``queries`` holds the thin
queries that are registered in ``__spark_entry__``.
"""
