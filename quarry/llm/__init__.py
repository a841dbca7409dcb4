"""Operators that prepare training data: one module per operator, all of them DataFrame in, DataFrame out."""
