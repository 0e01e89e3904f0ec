"""Operators over trees: rules, matches, merged metadata, segmentation, conversion."""
