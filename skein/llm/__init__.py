"""Operators for large training-corpus pipelines, beside the topology engine."""
