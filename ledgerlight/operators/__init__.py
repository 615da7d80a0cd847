"""Operators on DataFrames: catalog building, search, ranking, questions, conversations, evaluation, corpora."""
