"""Operators over text collections and for model training data. Nothing outside this subpackage imports it."""
