"""The language: tokens, trees, and their compilation to DataFrame plans."""
