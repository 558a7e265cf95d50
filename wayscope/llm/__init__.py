"""Operators for large training-data pipelines; nothing else in wayscope imports this subpackage."""
