"""Operators that prepare text corpora at scale. Nothing outside imports this."""
