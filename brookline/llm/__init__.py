"""Training-data operators: near-duplicate joins, scoring, tokenizing, filtering, packing and licence scans.

Nothing else in the library imports this subpackage.
"""
