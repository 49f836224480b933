"""Training-data operators: search, quality, near-duplicates, sharding, tokens, mixing.

Nothing else in the library imports this subpackage. Functions that run inside Python
workers are pickled by value, so executors need pyspark and its public dependencies,
but no copy of this package.
"""
