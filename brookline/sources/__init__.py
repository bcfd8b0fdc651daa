"""Models and tables."""
