"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
