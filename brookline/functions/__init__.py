"""Types, scalar functions and the compilation of expressions to columns."""
