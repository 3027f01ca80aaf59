"""Operators: DataFrame in, DataFrame out, keyed by analysis and run kind."""
