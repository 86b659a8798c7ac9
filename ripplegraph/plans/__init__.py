"""Compositions of operators: a whole analysis, the registered queries, their SQL."""
