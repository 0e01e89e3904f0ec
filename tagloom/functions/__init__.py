"""XPath 1.0: syntax, evaluation on one tree, and column helpers."""
