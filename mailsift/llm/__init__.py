"""Training-data operators: tokenizing, deduplication, decontamination, sharding, filtering.

Every operator is a function of DataFrames. The module ``queries`` registers one query per
operator; nothing outside this package imports it, apart from the entry module and the
corpus pipeline.
"""
