"""Operators for building training data from text, one module each; nothing else in the library imports them."""
