"""Training-data operators over document and embedding tables.

Nothing else in the package imports this subpackage; ``registry`` lists its
queries for ``__spark_entry__``.
"""
