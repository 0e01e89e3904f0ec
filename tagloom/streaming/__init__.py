"""Structured Streaming over incoming documents: an extension beyond batch files."""
