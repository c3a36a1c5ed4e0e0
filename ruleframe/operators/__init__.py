"""Operators for long, narrow observation tables at scale."""
