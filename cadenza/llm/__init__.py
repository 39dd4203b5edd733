"""Operators for large text-corpus preparation, each ``f(df, ..., id_col, text_col) -> DataFrame``."""
