"""Operators for large training-corpus pipelines (documents in, documents or decisions out)."""
