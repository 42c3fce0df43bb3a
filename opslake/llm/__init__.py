"""Operators of large-scale training-data preparation.

Every operator is ``f(spark, df, ...) -> DataFrame`` with its production parameters as defaults; the
thin queries that the entry file registers are in :mod:`opslake.llm.queries`.
"""
