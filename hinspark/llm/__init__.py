"""Operations on training text: filters, extraction, deduplication, archives, tokens.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to DataFrames; :mod:`hinspark.llm.queries` registers
one query for each of them.
"""
