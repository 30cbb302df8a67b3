"""Operators for training-data pipelines.

Nothing else in helixframe imports this subpackage.
"""
