"""Relational operators: DataFrame in, DataFrame out, every trade date at once."""
