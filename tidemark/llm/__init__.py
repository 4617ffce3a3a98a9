"""Operators for building training data from a text corpus. Nothing else in the library imports them."""
