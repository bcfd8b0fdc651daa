"""A typed pipeline query language compiled to DataFrame plans, and operators for training data."""
