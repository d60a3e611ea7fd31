"""Operators for large text corpora: joins, sharding, filters, classifiers, tokenisers.

Nothing else in the library imports this subpackage.  Each operator is a set of
Spark jobs over a DataFrame; numpy or Arrow code runs inside tasks only, on rows
that Spark has partitioned.
"""
