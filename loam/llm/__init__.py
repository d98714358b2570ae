"""Operators for preparing language-model training text; nothing else in loam imports them."""
