"""Training-data operators: sampling, overlap search, splits, chunking, mixing.

Nothing outside this folder imports it; every operator takes and returns
DataFrames and is registered as a query in :mod:`palimpsest.llm.queries`.
"""
