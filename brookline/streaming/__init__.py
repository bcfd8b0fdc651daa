"""Pipelines over streams."""
