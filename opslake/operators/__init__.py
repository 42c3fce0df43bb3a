"""Table operators: f(df, ...) -> DataFrame."""
