"""Navigation operators. Each returns a DataFrame: a batch form for all symbols, and a form for one question."""
