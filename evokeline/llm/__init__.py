"""Operators for the preparation of text corpora; nothing else in the library imports them."""
