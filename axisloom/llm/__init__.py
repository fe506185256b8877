"""Operators for large-scale training-data pipelines (nothing else imports this)."""
