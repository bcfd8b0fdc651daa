"""Operators of pipelines, and of mutations."""
